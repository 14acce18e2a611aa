"""Operators on small hand-made inputs, with nulls, ties and empty tables."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.functions import boundary, paths, rules
from palimpsest.operators import compare as C
from palimpsest.operators import context as X
from palimpsest.operators import graph as G
from palimpsest.operators import pairs as P
from palimpsest.operators import parse as A
from palimpsest.operators import plan as M
from palimpsest.operators import reports as Z
from palimpsest.operators import retrieval as R
from palimpsest.operators import scan as S
from palimpsest.sources import readers, writers
from palimpsest.streaming import log_stages as L


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classification(spark):
    rows = [("a/B.PY", ""), (".gitignore", ""), (".env", ""), ("x/Makefile", ""), ("run", "#!/bin/bash\n"), ("run2", "#!/usr/bin/ruby"), ("a.tar.md", None), ("noext", None), ("a/.git/x.py", "")]
    got = {r.path: (r.language, r.category, r.detection_method, r.confidence) for r in paths.classified(files(spark, rows)).collect()}
    assert got["a/B.PY"] == ("Python", "code", "extension", "high")
    assert got[".gitignore"] == got[".env"] == ("Unknown", "unknown", "none", "low")
    assert got["x/Makefile"] == ("Makefile", "config", "filename", "high")
    assert got["run"] == ("Shell", "code", "shebang", "medium") and got["run2"][0] == "Ruby"
    assert got["a.tar.md"][0] == "Documentation" and got["noext"][1] == "unknown"
    assert S.scan(files(spark, rows)).where("path = 'a/.git/x.py'").count() == 0


def test_selection_routes(spark):
    spec = S.JobSpec(include_ambiguous=False)
    rows = [
        ("code", "Python", "2", "medium", "targets", None), ("code", "Python", "2", "low", "needs_review", "low_detection_confidence"), ("code", "Go", None, None, "skipped", "wrong_language"),
        ("code", "Python", None, None, "skipped", "no_version_detection_available"), ("code", "Python", "3", "high", "skipped", "already_on_target_version"),
        ("code", "Python", "unknown", "low", "skipped", "version_unknown_excluded"), ("code", "Python", "1", "high", "skipped", "version_1_not_in_job_scope"), ("config", "YAML", None, None, "skipped", "not_code"),
    ]
    df = spark.createDataFrame(rows, "category string, language string, version string, version_confidence string, b string, r string")
    for r in S.select_files(df, spec).collect():
        assert (r.bucket, r.reason) == (r.b, r.r)


def test_paths(spark):
    df = spark.createDataFrame([("pkg/sub/__init__.py",), ("a/b.pyw",), ("./././x.py",), ("/abs\\y.py",)], "p string")
    got = [(r.m, r.v, r.n) for r in df.select(paths.module_name(F.col("p")).alias("m"), paths.module_variants(F.col("p")).alias("v"), paths.normalised(F.col("p")).alias("n")).collect()]
    assert got[0][:2] == ("pkg.sub", ["pkg.sub", "sub"]) and got[1][:2] == ("a.b", ["a.b", "b"])
    assert got[2][2] == "x.py" and got[3][2] == "abs/y.py"
    # one dot resolves against the module itself unless corrected
    assert one(spark, paths.resolve_relative(F.lit("a.b"), F.lit(1), F.lit("c"))) == "a.b.c"
    assert one(spark, paths.resolve_relative(F.lit("a.b"), F.lit(1), F.lit("c"), False)) == "a.c"


def test_risk_scores_of_the_known_plan(spark):
    rows = [("utils", 2, 0, 2, False, 8, 46), ("billing", 2, 2, 2, True, 5, 61), ("main", 1, 2, 0, False, 0, 20)]
    df = spark.createDataFrame(rows, "f string, r int, t int, s int, test boolean, e int, want int")
    for r in df.withColumn("got", M.risk_score(F.col("r"), F.col("t"), F.col("s"), F.col("test"), F.col("e"))).collect():
        assert r.got == r.want


def test_levels_and_cycles(spark):
    rng = random.Random(5)
    for _ in range(2):
        n = 12
        pairs = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(16)}
        e = spark.createDataFrame(sorted(pairs), "source string, target string")
        nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n)], "file string")
        got = {r.file: r.level for r in G.dependency_levels(nodes, e).collect()}
        left, level, want = {f"n{i:02}" for i in range(n)}, 0, {}
        while left:
            ready = [v for v in left if not any(a == v and b in left and a != b for a, b in pairs)] or [min(left)]
            want |= dict.fromkeys(ready, level)
            left -= set(ready)
            level += 1
        assert got == want
        reach = {v: {v} for v in want}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
        sccs = {tuple(sorted(w for w in want if w in reach[v] and v in reach[w])) for v in want}
        assert sorted(tuple(r.members) for r in G.cycles(e).collect()) == sorted(s for s in sccs if len(s) > 1)


def test_graph_of_a_small_tree(spark):
    tree = files(spark, [
        ("pkg/__init__.py", ""), ("pkg/a.py", "from pkg.b import (  # names\n    f,\n    g as h,\n)\nimport os, pkg.c as c\n\nclass A(c.Base):\n    def m(self):\n        return h(1) + c.k() + f (2)\n"),
        ("pkg/b.py", "def f(x):\n    return x\n\ndef g(y):\n    return f(y)\n"), ("pkg/c.py", "class Base(object):\n    pass\n\ndef k():\n    return helper()\n"), ("pkg/d.py", "def helper():\n    pass\n"), ("empty.py", None),
    ])
    got = {(r.source, r.target, r.type, r.name, r.line) for r in G.edges(tree).collect()}
    assert got == {
        ("pkg/a.py", "pkg/b.py", "from_import", "f", 1), ("pkg/a.py", "pkg/b.py", "from_import", "g", 1), ("pkg/a.py", "pkg/c.py", "import", "pkg.c", 5), ("pkg/a.py", "pkg/b.py", "function_call", "h", 9),
        ("pkg/a.py", "pkg/c.py", "function_call", "k", 9), ("pkg/a.py", "pkg/b.py", "function_call", "f", 9), ("pkg/c.py", "pkg/d.py", "function_call", "helper", 5),
        ("pkg/a.py", "pkg/c.py", "inheritance", "Base", 7),
    }
    assert G.edges(tree.limit(0)).count() == 0


def test_pair_labels(spark):
    rows = [
        ("def f(: x", "def g(", "likely_noise"), ("print x\n", "print(x)\n", "high_confidence"), ("xrange(1)", "range(1)", "high_confidence"), ("six.text_type(x)", "str(x)", "high_confidence"),
        ("x = 1", "x = unicode(1)", "needs_review"), ("a = 1", "a = 1", "likely_noise"), ("a = 1", "zzz = [q for q in w]", "needs_review"),
    ]
    df = spark.createDataFrame(rows, "original_code string, migrated_code string, want string")
    assert all(r.label == r.want for r in P.graded(df).collect())


def test_pairs_helpers(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in P.first_of_each(df, "k", "o").collect()} == {("a", 1, "y"), ("b", 3, None)}
    assert P.hashed_sample(df, 2, "o").count() == 2 and P.hashed_sample(df, 2, "o").collect() == P.hashed_sample(df, 2, "o").collect()
    assert [r.percent for r in P.percentages(df, "k").orderBy("k").collect()] == [66.7, 33.3]


def test_parse_python2_and_3(spark):
    src = "class A(B):\n    def f(self, x=dflt, *a):\n        for i in x:\n            if i:\n                g(i)\n        try:\n            pass\n        except E, e:\n            print e\n        def inner():\n            yield 1\n        return 0777\n"
    rows = {r.function_full_name: r for r in A.functions(files(spark, [("m.py", src), ("bad.py", "def (("), ("n.py", None)])).collect()}
    assert set(rows) == {"A.f", "A.inner"}
    f = rows["A.f"]
    assert f.params == ["self", "x", "dflt", "a"] and f.bases == ["B"] and f.calls == ["g", "print"] and (f.start_line, f.end_line, f.loc) == (2, 12, 11)
    assert f.branch_count == 4 and f.cyclomatic_complexity == 5 and f.nesting_depth == 2 and f.nested_function_count == 1 and f.has_yield and f.has_return
    calls = A.callables(files(spark, [("m.py", "class O:\n    class I:\n        @staticmethod\n        def s(a, *b, c=1, **d): pass\n    def __init__(self, z): pass\nasync def t(): pass\n"), ("tests/x.py", "def no(): pass")]))
    got = {r.qualified_name: (r.kind, r.parameters, r.p) for r in calls.withColumn("p", A.effective_parameters(F.col("kind"), F.col("parameters"))).collect()}
    assert got == {"O.I.s": ("staticmethod", ["a", "*b", "c", "**d"], ["a", "*b", "c", "**d"]), "O.__init__": ("constructor", ["self", "z"], ["z"]), "t": ("function", [], [])}


def test_context_scanners(spark):
    src = "class A:\n    def f(self):\n        def g(): pass\n\n    class B:\n        def h(self): pass\ndef k():\n    return 1\n"
    got = [(r.type, r.name, r.line, r.class_name) for r in A.context_symbols(files(spark, [("m.py", src)])).orderBy("line").collect()]
    assert got == [("class", "A", 1, None), ("method", "f", 2, "A"), ("method", "g", 3, "A"), ("class", "B", 5, None), ("method", "h", 6, "B"), ("function", "k", 7, None)]
    assert A.relevant_blocks(src, ["k"]) == "def k():\n    return 1" and A.relevant_blocks(src, ["nope"], 5) == "class" and A.relevant_blocks(None, []) == ""


def test_values(spark):
    cases = [("1", "1.0", True), ("true", "1", False), ("null", "0", False), ("[1,2]", "[1,2]", True), ('{"a":1,"b":2}', '{"b":2,"a":1}', True), ('{"a":1}', '{"c":1}', False), ('"x"', '"y"', False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", C.same_value(F.col("a"), F.col("b"))).collect())
    nan = spark.createDataFrame([Row(k=1, v=float("nan"), s=None), Row(k=2, v=1.0, s="x")], "k int, v double, s string")
    assert [r.equivalent for r in C.compare(nan, nan, ["k"], ["v", "s"]).collect()] == [True, True]
    kinds = [("return_value", "1", "2.5", "numeric_value_change"), ("return_value", '"a"', '"b"', "string_value_change"), ("return_value", "[1]", "1", "collection_value_change"), ("status", "A", "B", "execution_status_change"),
             ("return_value", '{"__type__":"C","attributes":{}}', '{"__type__":"C","attributes":{"x":1}}', "object_state_change"), ("return_value", "true", "1", "value_change"), ("stderr", "a", "b", "execution_difference")]
    df = spark.createDataFrame(kinds, "f string, a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", C.explain_difference(F.col("f"), F.col("a"), F.col("b"))).collect())


def test_known_confusion(spark):
    rows = [(0, 0)] * 52 + [(0, 1)] * 3 + [(1, 0)] * 8 + [(1, 1)] * 41
    m = C.binary_metrics(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert (m.tn, m.fp, m.fn, m.tp) == (52, 3, 8, 41)
    assert [round(x, 4) for x in (m.accuracy, m.precision, m.recall, m.f1)] == [0.8942, 0.9318, 0.8367, 0.8817]


def test_isolation(spark):
    df = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") == 299, 500.0).otherwise(1.0).alias("b"))
    got = {r.id: r.anomaly_score for r in C.isolation_scores(df, ["a", "b"], "id", 40).collect()}
    assert min(got, key=got.get) == 299 and got[299] < 0 and all(-0.5 <= x <= 0.5 for x in got.values())
    assert C.isolation_scores(df.limit(1), ["a", "b"], "id").first().anomaly_score == 0


def test_retrieval_edges(spark):
    kb = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, None, 1), (4, [1.0], 1), (5, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.similarity) for r in R.vector_topk(kb.where("vec_id = 0"), kb, 5, -1.0).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0), (5, 0.0)]
    assert R.vector_topk(kb.limit(0), kb, 5, 0.0).count() == 0
    with pytest.raises(ValueError):
        R.vector_topk(kb, kb, 0, 0.0)
    c = spark.createDataFrame([(1, 1, 10, 5000), (1, 2, 11, 5000), (1, 3, 12, 4000), (2, 1, 13, 9001)], "query_id long, rank int, vec_id long, cost long")
    assert {(r.query_id, r.vec_id) for r in R.pack_greedy(c, F.col("cost")).collect()} == {(1, 10), (1, 12)}


def test_stream_equals_batch(spark, tmp_path):
    titles = [*L.STAGE_TITLES, "[PASS] STAGE 3 - SYNTAX VERIFICATION", "[FAIL] STAGE 5 - DIFFERENTIAL / SEMANTIC VERIFICATION", "GROQ REQUEST", "Behavioral cases", "noise", "[3/4] Migrating: x"]
    rng = random.Random(2)
    rows = [(j, k, rng.choice(titles)) for k in range(60) for j in ("a", "b")]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "job_id string, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {r.job_id: r.status for r in L.fold(spark.read.parquet(str(tmp_path / "in"))).collect()}
    want = {}
    for j in ("a", "b"):
        state = {}
        for r in sorted(x for x in rows if x[0] == j):
            L.advance(state, r[2])
        want[j] = ",".join(f"{s}={state[s]}" for s in L.STAGES if s in state)
    assert batch == want
    src = spark.readStream.schema("job_id string, seq long, line string").parquet(str(tmp_path / "in"))
    q = L.stream(src).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job_id: r.status for r in spark.sql("select * from states").collect()} == want
    assert L.finished({"scan": "running"}, False)["version"] == "not_completed"


def test_sources(spark, tmp_path):
    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "r/a").mkdir()
    (tmp_path / "r/a/x.py").write_bytes(b"ok \xff\n")
    (tmp_path / "r/.git/y.py").write_text("no")
    assert [(r.path, r.content) for r in readers.repository(spark, str(tmp_path / "r")).collect()] == [("a/x.py", "ok \n")]
    (tmp_path / "l.jsonl").write_text('﻿{"a":1}\n\n{bad\n{"a":2}\n', encoding="utf-8")
    good, bad = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["{bad"]
    assert readers.json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "d.json").write_text('{"a": 7}')
    assert readers.json_document(spark, str(tmp_path / "d.json"), "a int").first().a == 7
    docs = spark.createDataFrame([('[{"original_code":"x"},{"b":1}]',), ('{"functions":[{"original_code":"y"}]}',)], "d string")
    assert [len(r.f) for r in docs.select(readers.function_records(F.col("d")).alias("f")).collect()] == [1, 1]
    (tmp_path / "p.csv").write_text('id,original_code,migrated_code,label,split\n1,"a\nb","c ""q""",equivalent,train\n')
    assert readers.labelled_pairs(spark, str(tmp_path / "p.csv"), "train").first().migrated_code == 'c "q"'
    with pytest.raises(ValueError):
        readers.labelled_pairs(spark, str(tmp_path / "p.csv"), "test")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("top/a.py", "1")
        z.writestr("__MACOSX/x", "2")
    arch = spark.createDataFrame([("u/up.zip", bytearray(buf.getvalue()))], "path string, content binary")
    assert [(r.archive, r.path) for r in readers.unrooted(readers.unzipped(arch)).collect()] == [("up.zip", "a.py")]
    (tmp_path / "prs").mkdir()
    (tmp_path / "prs/page-1.json").write_text(json.dumps([{"repo": "o/r", "pr_number": 3, "path": "a.py", "encoding": "base64", "content": "YQ=="}, {"repo": "o/r", "content": "/w==", "encoding": "base64"}]))
    spark.dataSource.register(readers.PullRequestSource)
    assert sorted((r.content or "") for r in spark.read.format("pull_requests").option("path", str(tmp_path / "prs")).load().collect()) == ["", "a"]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("r", "s", "a/b.py", "x=1"), ("r", "s", "c.py", None)], "repo string, sha string, path string, content string")
    cache = str(tmp_path / "cache")
    writers.cache_contents(f, cache)
    writers.cache_contents(f, cache)
    assert spark.read.parquet(cache).count() == 2
    writers.materialise(f, str(tmp_path / "tree"))
    assert (tmp_path / "tree/a/b.py").read_text() == "x=1" and (tmp_path / "tree/c.py").read_text() == ""
    data = writers.zipped(f).first().archive
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == ["a/b.py", "c.py"]
    writers.json_lines(f, str(tmp_path / "j"))
    writers.csv(f, str(tmp_path / "c"))
    writers.json_document(f.limit(1), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_boundaries(spark):
    units = spark.createDataFrame([("for i in xrange(3):\n    print i\n",), ("",), (None,)], "source string")
    got = [(r.migrated, r.success) for r in boundary.migrate(units).collect()]
    assert got == [("for i in range(3):\n    print(i)\n", True), (None, False), (None, False)]
    e = one(spark, boundary.hashed_embedding(F.lit("alpha beta alpha"), 8))
    assert abs(sum(x * x for x in e) - 1) < 1e-6 and one(spark, boundary.hashed_embedding(F.lit(None), 8)) == [0.0] * 8
    pairs = spark.createDataFrame([("xrange(1)", "range(1)", 1.0), ("xrange(1)", "xrange(1)", 0.0)] * 10, "original_code string, migrated_code string, label double")
    model = boundary.train_pair_classifier(pairs, validation=pairs)
    assert {(r.label, r.equivalent) for r in boundary.classify_pairs(model, pairs).collect()} == {(1.0, 1), (0.0, 0)}


def test_text_helpers(spark):
    assert one(spark, R.fenced_code(F.lit("a ```Python\nx\n``` b"))) == "x\n" or one(spark, R.fenced_code(F.lit("a ```Python\nx\n``` b"))) == "x"
    assert one(spark, R.explanation(F.lit("a ```x``` b "))) == "a\nb" and one(spark, R.explanation(F.lit("plain"))) == ""
    assert one(spark, X.normalised_text(F.lit(" a\r\nb \n"))) == "a\nb"
    assert one(spark, A.json_array(F.lit("say [1, 2] ok"))) == "[1, 2]" and one(spark, A.json_array(F.lit("none"))) == "[]"
    assert one(spark, A.tests_run(F.lit("Ran 1 test\nRan 12 tests in 1s"))) == 12
    assert one(spark, X.version_label(F.lit("Python"), F.lit("Python 2"))) == "Python 2"
    assert one(spark, rules.hits(F.lit(None).cast("string"), rules.PY2_VOTES)) == []


def test_reports(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    symbols = spark.createDataFrame([("a", "function", "x", 1), ("a", "class", "y", 2)], "file string, type string, name string, line int")
    edges = spark.createDataFrame([("b", "a"), ("c", "a")], "source string, target string")
    results = spark.createDataFrame([("a", True, "k"), ("b", False, "k"), ("b", False, "k"), ("b", True, "k")], "file string, equivalent boolean, key string")
    failed = spark.createDataFrame([("c",)], "file string")
    got = {r.file: r for r in Z.risk_report(f, symbols, edges, results, failed, keep_quirk=False).collect()}
    assert got["a"].dependent_count == 2 and got["a"].reasons == ["File has dependent modules"] and got["c"].risk == "HIGH"
    assert got["b"].risk == "HIGH" and got["b"].unique_semantic_differences == 1 and got["b"].reasons == ["Semantic differences detected", "High semantic difference rate"]
    assert {r.dependent_count for r in Z.risk_report(f, symbols, edges, results, failed).collect()} == {0}
    assert one(spark, Z.without_null_words(F.lit('["None", {"a": "null"}, "nullx"]'))) == '[null, {"a": null}, "nullx"]'
    assert one(spark, Z.changed_keys(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("3")))) == ["b", "c"]
    assert one(spark, Z.percent(F.lit(1), F.lit(3))) == "33.3%" and one(spark, Z.title(F.lit("risk_analysis x"))) == "Risk Analysis X"
    e = Z.evidence(spark.createDataFrame([("a", ["xrange"])], "file string, reasons array<string>"), f.where("file = 'z'"), results, spark.createDataFrame([("a", "LOW")], "file string, risk string"))
    assert e.first().evidence == ["issues: xrange", "cases equal: 1/1", "risk: low"]


def test_recorded_runs(spark):
    from palimpsest.operators import execution as E

    jobs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, n int")

    def runner(job):
        if job["name"] == "c":
            raise RuntimeError("no interpreter")
        return job["n"] - 1, f"ran {job['name']}", "", job["name"] == "b"

    got = {r.name: (r.n, r.return_code, r.stdout, r.stderr, r.timed_out) for r in E.recorded(jobs, runner).collect()}
    assert got == {"a": (1, 0, "ran a", "", False), "b": (2, 1, "ran b", "", True), "c": (3, 1, "", "RuntimeError: no interpreter", False)}
    assert E.recorded(jobs.limit(0), runner).count() == 0


def test_tagged_values():
    from palimpsest.operators.execution import tagged

    class Box:
        def __init__(self):
            self.size, self.me = 3, self

    ring = [1]
    ring.append(ring)
    assert tagged(ring) == [1, {"__type__": "list", "__recursive__": True}]
    assert tagged(Box()) == {"__type__": "Box", "attributes": {"__type__": "dict", "items": [["me", {"__type__": "Box", "__recursive__": True}], ["size", 3]]}}
    shared = [2]
    assert tagged([shared, shared]) == [[2], [2]]  # seen twice, but not within itself
    assert tagged({"b", "a"}) == {"__type__": "set", "items": ["a", "b"]} and tagged(bytearray(b"\xff")) == {"__type__": "bytearray"} and tagged(bytearray(b"k")) == {"__type__": "bytearray", "value": "k"}
    assert tagged(3 + 2j) == {"__type__": "complex"}


def test_null_words_within_quotes(spark):
    from palimpsest.operators import reports as Z
    from pyspark.sql import functions as F

    text = r'{"null": "None", "said": "he wrote \"null\", \"None\" there", "x": [ "null" , "nulls", null], "y": {"None" : "None"}}'
    want = r'{"null": null, "said": "he wrote \"null\", \"None\" there", "x": [ null , "nulls", null], "y": {"None" : null}}'
    rows = spark.createDataFrame([(text,), ('"null"',), (None,), ("",)], "t string").select(Z.without_null_words(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == [want, "null", None, ""]


def test_grammars_of_two_versions(spark):
    from palimpsest.operators import parse as P
    from pyspark.sql import functions as F

    sources = ["print 'x'\n", "print('x')\n", "def f(a: int): pass\n", "x = f'{1}'\n", "exec 'a'\n", "class A(B, metaclass=C): pass\n", "raise E from x\n", "a, *b = c\n", "f(*c)\n", "(((", "x = 0777\n", ""]
    got = [tuple(r.g) for r in spark.createDataFrame(list(enumerate(sources)), "i int, s string").select("i", P.grammars("s").alias("g")).orderBy("i").collect()]
    assert got == [(True, False), (True, True), (False, True), (False, True), (True, False), (False, True), (False, True), (False, True), (True, True), (False, False), (True, False), (True, True)]


def test_many_prefix_lengths(spark):
    from palimpsest.operators import pairs as P

    prefixes = spark.createDataFrame([("a" * n, f"s{n}") for n in range(1, 1300)], "prefix string, split string")
    rows = spark.createDataFrame([("a" * 1250 + "b",), ("a",), ("b",), (None,)], "id string")
    got = {(r.id or "")[:1] + str(len(r.id or "")): r.split for r in P.split_of_prefix(rows, prefixes).collect()}
    assert got == {"a1251": "s1250", "a1": "s1", "b1": None, "0": None}


def test_auc_of_wide_scores(spark):
    from palimpsest.operators import compare as C

    rows = [(k % 2, float((k * 37) % 101) * 1e6 - 5e7) for k in range(400)]
    wins = sum((p > n) + 0.5 * (p == n) for a, p in rows if a for b, n in rows if not b)
    got = C.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().roc_auc
    assert abs(got - wins / 200 / 200) < 1e-12
    assert C.roc_auc(spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double"), "y", "s").first().roc_auc == 0.5
