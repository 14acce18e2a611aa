"""Queries on contexts, boundaries and test discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import boundary
from palimpsest.operators import context as X
from palimpsest.operators import parse as P
from palimpsest.plans.graph_queries import _BASE, _edges, _plan_and_edges
from palimpsest.sources import corpus

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_BASE}, u AS (SELECT file FROM plan WHERE decision = 'MIGRATE') SELECT u.file, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS dependencies FROM u LEFT JOIN edges e ON e.source = u.file GROUP BY 1")
def context_dependencies(spark, d):
    p, e = _plan_and_edges(spark, d)
    r = X.relations(p.where("decision = 'MIGRATE'"), e)
    return r.select("file", F.coalesce(F.array_join("relations.file", ","), F.lit("")).alias("dependencies"))


@query(f"WITH {_BASE}, u AS (SELECT file FROM plan WHERE decision = 'MIGRATE') SELECT u.file, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS dependents FROM u LEFT JOIN edges e ON e.target = u.file GROUP BY 1")
def context_dependents(spark, d):
    p, e = _plan_and_edges(spark, d)
    r = X.relations(p.where("decision = 'MIGRATE'"), e, False)
    return r.select("file", F.coalesce(F.array_join("relations.file", ","), F.lit("")).alias("dependents"))


@query()
def dependency_source(spark, d):
    return X.dependency_source(_edges(spark, d), corpus.files(spark, d))


@query(f"WITH {corpus.FILES_SQL} SELECT CASE WHEN count(*) FILTER (WHERE path LIKE '%/tests/%' AND content LIKE '%unittest%') > 0 THEN 'unittest' ELSE 'none' END AS framework FROM files")
def test_framework(spark, d):
    return X.test_framework(corpus.files(spark, d))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+', ''), '\\s+$', '') AS text FROM documents")
def normalised_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.normalised_text(F.col("text")).alias("text"))


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) + value AS score FROM events")
def safe_numbers(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", (X.safe_float(F.col("event_type")) + F.col("value")).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Python 2' ELSE 'Python 3' END AS label FROM documents")
def version_labels(spark, d):
    v = F.when(F.col("doc_id") % 2 == 0, "2").otherwise("Python 3")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.version_label(F.lit("Python "), v).alias("label"))


@query()
def hashed_embeddings(spark, d):
    return corpus.files(spark, d).select("doc_id", boundary.hashed_embedding(F.col("content")).alias("embedding"))


_MIGRATED = [
    (0, "import os\nfrom pkg{hg}.m{half} import helper{half}\n\ndef helper{id}(items):\n    for i in range(len(items)):\n        print(items[i])\n    return helper{half}(items)\n"),
    (1, "import urllib.request\nimport pkg{hg}.m{half}\n\nclass Loader{id}(Base{half}):\n    def fetch(self, url):\n        return urllib.request.urlopen(url).read()\n\nclass Base{id}(object):\n    pass\n\ndef helper{id}(x):\n    return x\n"),
    (2, "from pkg{hg}.m{half} import helper{half} as up\nimport json\n\ndef helper{id}(data):\n    if 'a' in data:\n        raise ValueError('bad')\n    for k, v in data.items():\n        up(v)\n    return json.dumps(data)\n\nclass Base{id}(object):\n    pass\n"),
    (3, corpus.TEMPLATES[3][1]),
    (4, "import unittest\nfrom pkg{hg}.m{half} import helper{half}\n\nclass Test{id}(unittest.TestCase):\n    def test_it(self):\n        self.assertEqual(helper{half}([1]), 1)\n"),
    (5, "from pkg{hg}.m{half} import (\n    helper{half},\n    Base{half},\n)\n\ndef helper{id}(text):\n    try:\n        name = input('name')\n    except IOError as e:\n        print('failed', e)\n    return isinstance(text, str) and helper{half}(u'x')\n"),
    (6, corpus.TEMPLATES[6][1]),
    (11, "import ConfigParser\nimport cPickle\nfrom cStringIO import StringIO\n\ndef helper{id}(n):\n    total = int(0)\n    while n != 0:\n        total += n\n        n -= 1\n    return helper{half}(total)\n"),
]


@query(corpus.by_template(["migrated", "success"], [(*r, True) for r in _MIGRATED], path_as=None))
def rule_migration(spark, d):
    units = corpus.files(spark, d).where(F.col("path").endswith(".py")).select("doc_id", F.col("content").alias("source"))
    return boundary.migrate(units).select("doc_id", "migrated", "success")


_CONSTRUCTED = [
    (0, "Box.__init__", "constructor", "self,size,unit{id}"), (0, "Box.area", "instance_method", "self,size,unit{id}"), (0, "Plain.run", "instance_method", None), (0, "free", "function", None),
    (1, "Late.__init__", "constructor", "self,second{half}"), (1, "Late.__init__", "constructor", "self,second{half}"), (1, "Late.go", "staticmethod", "self,second{half}"),
]
_CLASSES = [
    "class Box(object):\n    def __init__(self, size, unit{id}):\n        pass\n    def area(self):\n        return 1\n\nclass Plain:\n    def run(self):\n        pass\n\ndef free(x):\n    return x\n",
    "class Late:\n    def __init__(self, first):\n        pass\n    def __init__(self, second{half}):\n        pass\n    @staticmethod\n    def go(x):\n        print x\n",
]


@query(corpus.by_template(["qualified_name", "kind", "constructor"], _CONSTRUCTED))
def constructor_join(spark, d):
    k = len(corpus.TEMPLATES)
    files = corpus.files(spark, d).where(F.col("doc_id") % k < 2).withColumn("content", corpus.filled(F.when(F.col("doc_id") % k == 0, _CLASSES[0]).otherwise(_CLASSES[1]), F.col("doc_id")))
    return X.with_constructors(P.callables(files)).select("file", "qualified_name", "kind", F.array_join("constructor_parameters", ",").alias("constructor"))
