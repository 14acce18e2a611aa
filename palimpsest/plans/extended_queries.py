"""Queries on grammars, mining, recorded runs, replies and results, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import context as X
from palimpsest.operators import execution as E
from palimpsest.operators import parse as P
from palimpsest.operators import retrieval as R
from palimpsest.operators import scan as S
from palimpsest.sources import corpus
from palimpsest.streaming import log_stages as L

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _python(spark, d):
    return corpus.files(spark, d).where(F.col("path").endswith(".py"))


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


_AFTER = "regex_heuristic_after_inconclusive_parso"
_VERSIONS = [
    (0, "2", "high", "parso_grammar", "parses cleanly as Python 2 only"), (1, "2", "medium", _AFTER, "import urllib2 (merged into urllib in Py3)"), (2, "2", "high", "parso_grammar", "parses cleanly as Python 2 only"),
    (3, "3", "high", "parso_grammar", "parses cleanly as Python 3 only"), (4, "unknown", "low", _AFTER, ""), (5, "2", "high", "parso_grammar", "parses cleanly as Python 2 only"),
    (6, "3", "medium", _AFTER, "print() function call"), (11, "2", "high", "parso_grammar", "parses cleanly as Python 2 only"),
]


@query(corpus.by_template(["version", "confidence", "method", "signals"], _VERSIONS))
def version_grammar(spark, d):
    return S.grammar_version(_python(spark, d)).select(F.col("path").alias("file"), "version", F.col("version_confidence").alias("confidence"), "method", F.array_join("signals", "; ").alias("signals"))


_MINED = [  # files that Python 3 can't parse have none
    (1, "Loader{id}.fetch", "def fetch(self, url):\n        return urllib2.urlopen(url).read()"), (1, "helper{id}", "def helper{id}(x):\n    return x"),
    (3, "helper{id}", "async def helper{id}(name: str) -> str:\n    await asyncio.sleep(0)\n    return f'{name}!'"), (4, "Test{id}.test_it", "def test_it(self):\n        self.assertEquals(helper{half}([1]), 1)"),
    (6, "helper{id}", "def helper{id}(value):\n    print(value)\n    return parent.helper{half}(six.text_type(value))"),
]
_IMPORTS = [
    (1, 0, "import urllib2"), (1, 1, "import pkg{hg}.m{half}"), (3, 0, "import asyncio"), (4, 0, "import unittest"), (4, 1, "from pkg{hg}.m{half} import helper{half}"), (6, 0, "import six"),
    (6, 1, "import pkg{hg}.m{half} as parent"),
]


@query(corpus.by_template(["name", "text"], _MINED))
def miner_functions(spark, d):
    return P.functions_to_mine(_python(spark, d))


@query(corpus.by_template(["position", "text"], _IMPORTS))
def miner_imports(spark, d):
    return P.imports_to_mine(_python(spark, d))


_INVENTORY = [
    (0, "4 helper{id} function"), (1, "5 Loader{id}.fetch instance_method; 11 helper{id} function"), (2, "4 helper{id} function"), (3, "3 helper{id} function"), (5, "6 helper{id} function"), (6, "4 helper{id} function"), (11, "5 helper{id} function"),
]


@query(corpus.by_template(["callables"], _INVENTORY))
def inventory_by_file(spark, d):
    said = F.transform("callables", lambda c: F.concat_ws(" ", c["line"].cast("string"), c["qualified_name"], c["kind"]))
    return P.by_file(P.callables(_python(spark, d))).select("file", F.array_join(said, "; ").alias("callables"))


@query("SELECT 'tests/h' || CAST(doc_id AS VARCHAR) || '.py' AS file, 'f' AS name FROM documents WHERE doc_id % 4 = 1 AND doc_id % 3 <> 0 UNION ALL SELECT 'a/tests/h' || CAST(doc_id AS VARCHAR) || '.py', 'f' FROM documents WHERE doc_id % 4 = 2 AND doc_id % 3 <> 0")
def test_symbols(spark, d):
    i = F.col("doc_id")
    folder = F.element_at(F.array(F.lit("src/"), F.lit("tests/"), F.lit("a\\tests\\"), F.lit("contest/")), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    files = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(folder, F.lit("h"), i.cast("string"), F.lit(".py")).alias("file"))
    symbols = files.select("file", F.explode(F.array(F.struct(F.lit("function").alias("type"), F.lit("f").alias("name")), F.struct(F.lit("class").alias("type"), F.lit("C").alias("name")))).alias("s")).select("file", "s.*")
    return P.test_symbols(symbols, files.where(i % 3 == 0)).select(F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), "name")


_TAGGED = {
    "({0}, 'a')": '{"__type__": "tuple", "items": [{0}, "a"]}', "{'b': {0}, 'a': [1.5, None]}": '{"__type__": "dict", "items": [["a", [1.5, null]], ["b", {0}]]}',
    "{{0}}": '{"__type__": "set", "items": [{0}]}', "[True, {0}]": "[true, {0}]", "b'x'": '{"__type__": "bytes"}', "f({0})": None,
}
_PLACES = "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in _TAGGED.values()) + "]"


@query(f"SELECT event_id, replace(({_PLACES})[CAST(event_id % {len(_TAGGED)} AS INTEGER) + 1], '{{0}}', CAST(event_id AS VARCHAR)) AS value FROM events")
def type_tags(spark, d):
    i = F.col("event_id")
    literal = F.element_at(F.array(*[F.lit(x) for x in _TAGGED]), (F.pmod(i, F.lit(len(_TAGGED))) + 1).cast("int"))
    return _events(spark, d).select("event_id", E.tagged_literal(F.replace(literal, F.lit("{0}"), i.cast("string"))).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'TIMEOUT' WHEN event_id % 3 = 0 THEN 'EXECUTION_FAILED' WHEN event_id % 2 = 0 THEN 'SUCCESS' WHEN event_id % 7 = 0 THEN 'EXECUTION_FAILED' ELSE 'EXCEPTION' END AS status FROM events")
def differential_status(spark, d):
    i = F.col("event_id")
    result = F.when(i % 2 == 0, '{"status": "ok", "value": 1}').when(i % 7 != 0, '{"status": "exception", "type": "ValueError"}')
    return _events(spark, d).select("event_id", E.call_status(F.when(i % 3 == 0, 2).otherwise(0), result, i % 5 == 0).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 3 THEN 2 WHEN event_id % 5 = 0 THEN -1 ELSE CAST(event_id % 3 AS INTEGER) END AS code FROM events")
def suite_codes(spark, d):
    i = F.col("event_id")
    framework = F.element_at(F.array(F.lit("none"), F.lit("pytest"), F.lit("unittest"), F.lit("unknown")), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    return _events(spark, d).select("event_id", E.suite_code(framework, (i % 3).cast("int"), i % 5 == 0).alias("code"))


@query("SELECT event_id AS test, CASE WHEN event_id % 3 <> 0 THEN 'PASS' ELSE 'FAIL' END AS original_status, CASE WHEN event_id % 5 > 1 THEN 'PASS' ELSE 'FAIL' END AS migrated_status, event_id % 3 <> 0 AND event_id % 5 > 1 AS equivalent FROM events WHERE event_id % 45 <> 0")
def same_tests(spark, d):
    i = F.col("event_id")
    e = _events(spark, d).select(i.alias("test"), i)
    original, migrated = e.where(i % 9 != 0).withColumn("return_code", (i % 3 == 0).cast("int")), e.where(i % 5 != 0).withColumn("return_code", (i % 5 == 1).cast("int"))
    return E.same_tests(original, migrated)


@query("SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN event_id WHEN 3 THEN event_id + 0.5 ELSE 0 END AS DOUBLE) AS number FROM events")
def safe_json_numbers(spark, d):
    i = F.col("event_id").cast("string")
    text = F.element_at(F.array(F.lit("true"), F.lit("false"), i, F.concat(i, F.lit(".5")), F.concat(F.lit('"'), i, F.lit('"')), F.lit("[1]")), (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int"))
    return _events(spark, d).select("event_id", X.safe_number(text).alias("number"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x = ' || CAST(turn AS VARCHAR) WHEN 1 THEN 'y' WHEN 2 THEN 'PYTHON' || chr(10) || 'z' ELSE 'a ```python b' END AS code FROM conversations")
def fenced_code_exact(spark, d):
    t = F.col("turn")
    reply = F.when(t % 4 == 0, F.concat(F.lit("Here:\n```\nno\n```\n```python\nx = "), t.cast("string"), F.lit("\n```\n"))).when(t % 4 == 1, " ```python y```").when(t % 4 == 2, "```PYTHON\nz\n``` end").otherwise(" a ```python b ")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", R.fenced_code_exact(reply).alias("code"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END DESC, coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END, 0) DESC, CAST(event_id % 5 AS DOUBLE) DESC, event_id) AS rank FROM events")
def example_ranking(spark, d):
    i = F.col("event_id")
    examples = _events(spark, d).select(
        "user_id", "event_id", F.when(i % 3 == 0, "Primary").when(i % 3 == 1, "generic").alias("retrieval_source"), F.when(i % 4 != 0, (i % 7).cast("double")).alias("final_score"), (i % 5).cast("string").alias("similarity")
    )
    return R.ranked_examples(examples, "user_id", "event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS n_queries, count(*) FILTER (WHERE event_id % 3 <> 0) AS n_successful FROM events")
def retrieval_counts(spark, d):
    return R.retrieval_counts(_events(spark, d).withColumn("retrieval", F.when(F.col("event_id") % 3 != 0, F.struct("value"))))


@query(f"WITH {corpus.FILES_SQL} SELECT r.file, coalesce(content, '') AS source_code FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'gone/' || path END AS file FROM files) r LEFT JOIN files ON files.path = r.file")
def results_with_source(spark, d):
    files = corpus.files(spark, d)
    results = files.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), "path")).alias("file"))
    return R.with_source(results, files).select("file", "source_code")


@query("SELECT user_id, CAST(min(event_id) AS DOUBLE) AS number FROM events WHERE event_id % 2 = 0 GROUP BY user_id")
def log_first_number(spark, d):
    i = F.col("event_id")
    lines = _events(spark, d).select("user_id", "event_id", F.when(i % 2 == 0, F.concat(F.lit("Found "), i.cast("string"), F.lit(" files"))).otherwise("nothing 7").alias("line"))
    return L.first_number(lines, "user_id", "event_id", "line", "Found ([0-9]+) files")


@query(f"""WITH {corpus.FILES_SQL}, u AS (SELECT path AS file, regexp_extract(path, '([^/]*)\\.py$', 1) AS s FROM files WHERE doc_id % 24 = 0),
t AS (SELECT path AS test, lower(path) AS p, lower(content) AS c FROM files WHERE path LIKE '%/tests/%')
SELECT u.file, t.test FROM u JOIN t ON contains(p, s) OR contains(c, s)""")
def inferred_tests(spark, d):
    files = corpus.files(spark, d)
    units, tests = files.where(F.col("doc_id") % 24 == 0).select(F.col("path").alias("file")), files.where(F.col("path").contains("/tests/")).select("path", "content")
    return X.inferred_tests(units, tests, units.limit(0))
