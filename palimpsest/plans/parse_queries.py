"""Parsing queries over the corpus; the ones that plain SQL cannot express have no oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.paths import module_name
from palimpsest.operators import parse as P
from palimpsest.sources import corpus

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _python(spark, d):
    return corpus.files(spark, d).where(F.col("path").endswith(".py"))


_FUNCTIONS = [
    (0, "helper{id}", 4, 7, "items", "helper{half},len,print,xrange", 4, 2, 1, True), (1, "Loader{id}.fetch", 5, 6, "self,url", "", 2, 1, 0, False), (1, "helper{id}", 11, 12, "x", "", 2, 1, 0, False),
    (2, "helper{id}", 4, 9, "data", "ValueError,up", 6, 3, 1, True), (3, "helper{id}", 3, 5, "name,str", "", 3, 1, 0, False), (4, "Test{id}.test_it", 5, 6, "self", "helper{half}", 2, 1, 0, False),
    (5, "helper{id}", 6, 11, "text", "helper{half},isinstance,print,raw_input", 6, 3, 1, False), (6, "helper{id}", 4, 6, "value", "print", 3, 1, 0, False), (11, "helper{id}", 5, 10, "n", "helper{half},long", 6, 2, 1, True),
]
_CALLABLES = [
    (0, "helper{id}", "function", 4, "items"), (1, "Loader{id}.fetch", "instance_method", 5, "url"), (1, "helper{id}", "function", 11, "x"), (2, "helper{id}", "function", 4, "data"),
    (3, "helper{id}", "function", 3, "name"), (5, "helper{id}", "function", 6, "text"), (6, "helper{id}", "function", 4, "value"), (11, "helper{id}", "function", 5, "n"),
]
_SYMBOLS = [
    (0, "function", "helper{id}", 4, None), (1, "class", "Loader{id}", 4, None), (1, "method", "fetch", 5, "Loader{id}"), (1, "class", "Base{id}", 8, None), (1, "function", "helper{id}", 11, None),
    (2, "function", "helper{id}", 4, None), (2, "class", "Base{id}", 11, None), (3, "function", "helper{id}", 3, None), (3, "class", "Base{id}", 7, None), (4, "class", "Test{id}", 4, None),
    (4, "method", "test_it", 5, "Test{id}"), (5, "function", "helper{id}", 6, None), (6, "function", "helper{id}", 4, None), (6, "class", "Base{id}", 8, None), (11, "function", "helper{id}", 5, None),
]
_BLOCKS = [
    (0, "def helper{id}(items):\n    for i in xrange(len(items)):\n        print items[i]\n    return helper{half}(items)"), (1, "def helper{id}(x):\n    return x"),
    (2, "def helper{id}(data):\n    if data.has_key('a'):\n        raise ValueError, 'bad'\n    for k, v in data.iteritems():\n        up(v)\n    return json.dumps(data)"),
    (3, "async def helper{id}(name: str) -> str:\n    await asyncio.sleep(0)\n    return f'{name}!'"),
    (4, "import unittest\nfrom pkg{hg}.m{half} import helper{half}\n\nclass Test{id}(unittest.TestCase):\n    def test_it(self):\n        self.assertEquals(helper{half}([1]), 1)\n"),
    (5, "def helper{id}(text):\n    try:\n        name = raw_input('name')\n    except IOError, e:\n        print 'failed', e\n    return isinstance(text, basestring) and helper{half}(u'x')"),
    (6, "def helper{id}(value):\n    print(value)\n    return parent.helper{half}(six.text_type(value))"), (11, "def helper{id}(n):\n    total = long(0)\n    while n <> 0:\n        total += n\n        n -= 1\n    return helper{half}(total)"),
]


@query(corpus.by_template(["function_full_name", "start_line", "end_line", "params", "calls", "loc", "cyclomatic_complexity", "nesting_depth", "has_loop"], _FUNCTIONS))
def function_features(spark, d):
    return P.functions(_python(spark, d)).select(
        "file", "function_full_name", "start_line", "end_line", F.array_join("params", ",").alias("params"), F.array_join("calls", ",").alias("calls"), "loc", "cyclomatic_complexity", "nesting_depth", "has_loop"
    )


@query(corpus.by_template(["qualified_name", "kind", "line", "parameters"], _CALLABLES))
def callable_inventory(spark, d):
    c = P.callables(_python(spark, d))
    return c.select("file", "qualified_name", "kind", "line", F.array_join(P.effective_parameters(F.col("kind"), F.col("parameters")), ",").alias("parameters"))


@query(corpus.by_template(["type", "name", "line", "class_name"], _SYMBOLS))
def enclosing_symbols(spark, d):
    return P.context_symbols(_python(spark, d))


@query(corpus.by_template(["source"], _BLOCKS, path_as=None))
def relevant_blocks(spark, d):
    names = F.array(F.concat(F.lit("helper"), F.col("doc_id").cast("string")))
    return _python(spark, d).select("doc_id", P.blocks_of("content", names).alias("source"))


@query(f"WITH {corpus.FILES_SQL} SELECT path AS file, NOT (regexp_matches(content, '(?m)^\\s*print\\s+[^(]') OR content LIKE '%raise ValueError, %' OR content LIKE '%<>%') AS valid FROM files WHERE path LIKE '%.py'")
def syntax_check(spark, d):
    return _python(spark, d).select(F.col("path").alias("file"), P.syntax_check("content").alias("c")).select("file", "c.valid")


@query(f"WITH {corpus.FILES_SQL}, v AS (SELECT NOT (regexp_matches(content, '(?m)^\\s*print\\s+[^(]') OR content LIKE '%raise ValueError, %' OR content LIKE '%<>%') AS valid FROM files WHERE path LIKE '%.py') SELECT count(*) AS files_checked, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid, CASE WHEN bool_and(valid) THEN 'PASS' ELSE 'FAIL' END AS status FROM v")
def syntax_rollup(spark, d):
    return P.syntax_rollup(_python(spark, d).select(P.syntax_check("content").alias("check")))


@query(
    f"""WITH {corpus.FILES_SQL}, ok AS (SELECT * FROM files WHERE path LIKE '%.py' AND NOT (regexp_matches(content, '(?m)^\\s*print\\s+[^(]') OR content LIKE '%raise ValueError, %' OR content LIKE '%<>%')),
i AS (SELECT DISTINCT path AS file, unnest(regexp_extract_all(content, '(?m)^\\s*(?:import|from)\\s+([A-Za-z_]\\w*)', 1)) AS module FROM ok)
SELECT file, module, CASE WHEN module LIKE 'pkg%' THEN 'local' WHEN module IN ('six', 'urllib2', 'ConfigParser', 'cPickle', 'cStringIO') THEN 'missing' ELSE 'stdlib' END AS kind FROM i"""
)
def import_verify(spark, d):
    f = _python(spark, d)
    local = f.select(F.regexp_extract(module_name(F.col("path")), r"^(\w+)", 1).alias("module"))
    return P.verified_imports(f, local)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS INTEGER) END AS n_tests, CASE WHEN event_id % 2 = 0 THEN '{\"status\":\"ok\"}' END AS result FROM events")
def runner_output(spark, d):
    i = F.col("event_id")
    out = F.concat(F.lit("noise\n"), F.when(i % 3 == 0, F.concat(F.lit("Ran 1 test\nRan "), i.cast("string"), F.lit(" tests in 1s\n"))).otherwise("Ran 1 test\n"), F.when(i % 2 == 0, '{"status":"ok"}\n').otherwise('{"x":1}\n'))
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", out.alias("out"))
    return e.select("event_id", P.tests_run(F.col("out")).alias("n_tests"), P.result_line(F.col("out")).alias("result"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[' || CAST(event_id AS VARCHAR) || ']' ELSE '[]' END AS items FROM events")
def json_array_reply(spark, d):
    i = F.col("event_id")
    reply = F.when(i % 2 == 0, F.concat(F.lit("Here: ["), i.cast("string"), F.lit("] done"))).otherwise("none [x")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", P.json_array(reply).alias("items"))
