"""A code corpus derived from the documents table, and its SQL twin for oracles.

Each document becomes one source file: a template chosen by its id, with its own number and that
of its parent (id div 2) filled in, so imports and calls form a deep dependency graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES: list[tuple[str, str]] = [
    ("pkg{g}/m{id}.py", "import os\nfrom pkg{hg}.m{half} import helper{half}\n\ndef helper{id}(items):\n    for i in xrange(len(items)):\n        print items[i]\n    return helper{half}(items)\n"),
    ("pkg{g}/m{id}.py", "import urllib2\nimport pkg{hg}.m{half}\n\nclass Loader{id}(Base{half}):\n    def fetch(self, url):\n        return urllib2.urlopen(url).read()\n\nclass Base{id}(object):\n    pass\n\ndef helper{id}(x):\n    return x\n"),
    ("pkg{g}/m{id}.py", "from pkg{hg}.m{half} import helper{half} as up\nimport json\n\ndef helper{id}(data):\n    if data.has_key('a'):\n        raise ValueError, 'bad'\n    for k, v in data.iteritems():\n        up(v)\n    return json.dumps(data)\n\nclass Base{id}(object):\n    pass\n"),
    ("pkg{g}/m{id}.py", "import asyncio\n\nasync def helper{id}(name: str) -> str:\n    await asyncio.sleep(0)\n    return f'{name}!'\n\nclass Base{id}(Base{half}):\n    pass\n"),
    ("pkg{g}/tests/test_m{id}.py", "import unittest\nfrom pkg{hg}.m{half} import helper{half}\n\nclass Test{id}(unittest.TestCase):\n    def test_it(self):\n        self.assertEquals(helper{half}([1]), 1)\n"),
    ("pkg{g}/m{id}.py", "from pkg{hg}.m{half} import (\n    helper{half},\n    Base{half},\n)\n\ndef helper{id}(text):\n    try:\n        name = raw_input('name')\n    except IOError, e:\n        print 'failed', e\n    return isinstance(text, basestring) and helper{half}(u'x')\n"),
    ("pkg{g}/m{id}.py", "import six\nimport pkg{hg}.m{half} as parent\n\ndef helper{id}(value):\n    print(value)\n    return parent.helper{half}(six.text_type(value))\n\nclass Base{id}(six.Iterator, Base{half}):\n    pass\n"),
    ("scripts/run{id}", "#!/usr/bin/env python\nprint 'run {id}'\n"),
    ("conf/app{id}.yaml", "name: app{id}\nversion: 2\n"),
    ("docs/page{id}.md", "# Page {id}\n\nSee helper{half}(x) in m{half}.\n"),
    ("vendor/node_modules/lib{id}.js", "function f{id}() { return 1; }\n"),
    ("pkg{g}/m{id}.py", "import ConfigParser\nimport cPickle\nfrom cStringIO import StringIO\n\ndef helper{id}(n):\n    total = long(0)\n    while n <> 0:\n        total += n\n        n -= 1\n    return helper{half}(total)\n"),
]
PAIRS: list[tuple[str, str]] = [
    ("def f(d):\n    for k, v in d.iteritems():\n        use(k)\n", "def f(d):\n    for k, v in d.items():\n        use(k)\n"),
    ("def f(n):\n    return [x for x in xrange(n)]\n", "def f(n):\n    return [x for x in range(n)]\n"),
    ("def f(d):\n    return d.has_key('a')\n", "def f(d):\n    return 'a' in d\n"),
    ("def f(s):\n    return isinstance(s, basestring)\n", "def f(s):\n    return isinstance(s, str)\n"),
    ("def f(u):\n    import urllib2\n    return urllib2.urlopen(u)\n", "def f(u):\n    import urllib.request\n    return urllib.request.urlopen(u)\n"),
    ("def f(self):\n    self.assertEquals(1, 1)\n", "def f(self):\n    self.assertEqual(1, 1)\n"),
    ("def f(x):\n    print x\n", "def f(x):\n    print(x)\n"),
    ("def f(x):\n    return six.text_type(x)\n", "def f(x):\n    return six.text_type(str(x))\n"),
    ("def f(x):\n    return unicode(x)\n", "def f(x):\n    return unicode(x, 'utf-8')\n"),
    ("def f(x):\n    return x + 1\n", "def f(x):\n    return x + 1\n"),
    ("def f(x):\n    return long(x)\n", "def f(x):\n    return int(x)\n"),
    ("def f(x):\n    a = 1\n    return a + x\n", "def f(x):\n    y = x * 3\n    return y\n"),
]


def filled(template: Column, doc: Column) -> Column:
    half = F.expr("doc_id div 2")
    for mark, value in (("{id}", doc), ("{half}", half), ("{g}", F.pmod(doc, F.lit(5))), ("{hg}", F.pmod(half, F.lit(5)))):
        template = F.replace(template, F.lit(mark), value.cast("string"))
    return template


def _chosen(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("doc_id"), F.lit(len(values))) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, path, content, size_bytes: one file for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("repo"))
    doc = F.col("doc_id")
    out = docs.withColumn("path", filled(_chosen([p for p, _ in TEMPLATES]), doc)).withColumn("content", filled(_chosen([c for _, c in TEMPLATES]), doc))
    return out.withColumn("size_bytes", F.octet_length("content").cast("long"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, function_name, original_code, migrated_code: one before/after pair for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("repo"))
    return docs.withColumn("function_name", F.concat(F.lit("f"), F.pmod(F.col("doc_id"), F.lit(40)).cast("string"))).withColumn(
        "original_code", _chosen([a for a, _ in PAIRS])
    ).withColumn("migrated_code", _chosen([b for _, b in PAIRS]))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_chosen(values: list[str]) -> str:
    return f"([{', '.join(map(_literal, values))}])[CAST(doc_id % {len(values)} AS INTEGER) + 1]"


def _sql_filled(x: str) -> str:
    for mark, value in (("{id}", "doc_id"), ("{half}", "doc_id // 2"), ("{g}", "doc_id % 5"), ("{hg}", "(doc_id // 2) % 5")):
        x = f"replace({x}, '{mark}', CAST({value} AS VARCHAR))"
    return x


def by_template(columns: list[str], rows: list[tuple], path_as: str | None = "file") -> str:
    """SQL of rows that every file of a template has: (template, values...), texts with the templates' marks."""
    values = ", ".join("(" + ", ".join("NULL" if x is None else _literal(x) if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    filled = [f"{_sql_filled(f'v.{c}')} AS {c}" if any(isinstance(r[k + 1], str) for r in rows) else f"v.{c}" for k, c in enumerate(columns)]
    first = f"{_sql_filled(_sql_chosen([p for p, _ in TEMPLATES]))} AS {path_as}" if path_as else "doc_id"
    return f"SELECT {first}, {', '.join(filled)} FROM documents JOIN (VALUES {values}) v(template, {', '.join(columns)}) ON doc_id % {len(TEMPLATES)} = v.template"


FILES_SQL = (
    f"files AS (SELECT *, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM (SELECT doc_id, source AS repo, {_sql_filled(_sql_chosen([p for p, _ in TEMPLATES]))} AS path, "
    f"{_sql_filled(_sql_chosen([c for _, c in TEMPLATES]))} AS content FROM documents))"
)
PAIRS_SQL = (
    f"pairs AS (SELECT doc_id, source AS repo, 'f' || CAST(doc_id % 40 AS VARCHAR) AS function_name, {_sql_chosen([a for a, _ in PAIRS])} AS original_code, "
    f"{_sql_chosen([b for _, b in PAIRS])} AS migrated_code FROM documents)"
)
