"""Comparison, risk, metric and log queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import compare as C
from palimpsest.plans.graph_queries import _BASE, _edges
from palimpsest.streaming import log_stages as L

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FIELDS = ["status", "return_value", "stdout"]


def _sides(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    left = o.select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"), k.cast("string").alias("return_value"), F.col("o_orderpriority").alias("stdout"))
    right = o.select(
        "o_orderkey", F.when(k % 11 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 5 == 0, (k + 1).cast("string")).when(k % 7 == 0, F.lit("x")).otherwise(k.cast("string")).alias("return_value"),
        F.when(k % 13 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("stdout"),
    )
    return left, right


_SIDES = """s AS (SELECT o_orderkey, o_orderpriority, o_orderstatus AS s1, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS s2, CAST(o_orderkey AS VARCHAR) AS r1,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS r2, o_orderpriority AS t1, CASE WHEN o_orderkey % 13 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS t2 FROM orders),
cmp AS (SELECT *, list_filter([CASE WHEN s1 IS DISTINCT FROM s2 THEN 'status' END, CASE WHEN r1 IS DISTINCT FROM r2 THEN 'return_value' END, CASE WHEN t1 IS DISTINCT FROM t2 THEN 'stdout' END], lambda x: x IS NOT NULL) AS diff FROM s)"""


def _compared(spark, d):
    left, right = _sides(spark, d)
    out = C.compare(left, right, ["o_orderkey"], _FIELDS)
    return out.join(left.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query(f"WITH {_SIDES} SELECT o_orderkey, array_to_string(diff, ',') AS fields, len(diff) = 0 AS equivalent FROM cmp")
def compare_results(spark, d):
    return _compared(spark, d).select("o_orderkey", F.array_join("differences.field", ",").alias("fields"), "equivalent")


@query(f"""WITH {_SIDES} SELECT o_orderkey, CASE WHEN r2 = 'x' THEN 'value_change' ELSE 'numeric_value_change' END AS category, CASE WHEN r2 <> 'x' THEN CAST(r2 AS DOUBLE) - CAST(r1 AS DOUBLE) END AS delta FROM cmp WHERE r1 <> r2""")
def diff_explain(spark, d):
    rows = _compared(spark, d).select("o_orderkey", F.explode("differences").alias("x")).where("x.field = 'return_value'")
    a, b = F.col("x.original"), F.col("x.migrated")
    return rows.select("o_orderkey", C.explain_difference(F.col("x.field"), a, F.when(b == "x", F.lit('"x"')).otherwise(b)).alias("category"), C.numeric_delta(a, b).alias("delta"))


def _behaviour(spark, d):
    return C.behaviour(_compared(spark, d).withColumn("key", C.canonical_key("differences")), "o_orderpriority")


_BEHAVIOUR = f"""{_SIDES}, beh AS (SELECT o_orderpriority, count(*) AS n_cases, count(*) FILTER (WHERE len(diff) > 0) AS n_differences,
 count(DISTINCT CASE WHEN len(diff) > 0 THEN [CAST(diff AS VARCHAR), CASE WHEN s1 IS DISTINCT FROM s2 THEN s1 END, CASE WHEN r1 <> r2 THEN r1 || r2 END, CASE WHEN t1 <> t2 THEN t1 END] END) AS n_distinct FROM cmp GROUP BY 1)"""


@query(f"WITH {_BEHAVIOUR} SELECT *, round(n_differences / n_cases, 6) AS rate FROM beh")
def behavioural_rollup(spark, d):
    return _behaviour(spark, d).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_SIDES} SELECT count(*) AS n_cases, count(*) FILTER (WHERE len(diff) = 0) AS n_equivalent, count(*) FILTER (WHERE len(diff) > 0) AS n_differences, CASE WHEN count(*) FILTER (WHERE len(diff) > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM cmp")
def behavioural_status(spark, d):
    return C.overall(_compared(spark, d))


def _risk_inputs(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    return c.select("c_custkey", (k % 17 == 0).alias("failed"), ((k % 10) / 10.0).alias("rate"), (k % 3).alias("n"), (F.col("c_acctbal") / 10000.0).alias("anomaly"))


_RISKS = "r AS (SELECT c_custkey, c_custkey % 17 = 0 AS failed, (c_custkey % 10) / 10.0 AS rate, c_custkey % 3 AS n, c_acctbal / 10000.0 AS anomaly FROM customer)"


@query(f"WITH {_RISKS} SELECT c_custkey, CASE WHEN failed OR rate >= 0.5 THEN 'HIGH' WHEN n > 0 THEN CASE WHEN anomaly < -0.1 THEN 'HIGH' ELSE 'MEDIUM' END WHEN anomaly < 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r")
def risk_label(spark, d):
    return _risk_inputs(spark, d).select("c_custkey", C.risk(F.col("failed"), F.col("rate"), F.col("n"), F.col("anomaly")).alias("risk"))


@query(f"WITH {_RISKS} SELECT c_custkey, coalesce(nullif(concat_ws('; ', CASE WHEN n > 0 THEN 'Semantic differences detected' END, CASE WHEN failed THEN 'Existing tests failed' END, CASE WHEN c_custkey % 4 > 0 THEN 'File has dependent modules' END, CASE WHEN rate >= 0.5 THEN 'High semantic difference rate' END), ''), 'No major verification issues detected') AS reasons FROM r")
def risk_reasons(spark, d):
    return _risk_inputs(spark, d).select("c_custkey", F.array_join(C.risk_reasons(F.col("failed"), F.col("rate"), F.col("n"), F.col("c_custkey") % 4), "; ").alias("reasons"))


@query()
def iforest_scores(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return C.isolation_scores(c.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], "c_custkey")


def _predictions(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    score = F.least(F.lit(1.0), F.col("n_chars") / 3000.0)
    return spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id").select("quality", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


_PRED = "p AS (SELECT quality, least(1.0, n_chars / 3000.0) AS score, CASE WHEN least(1.0, n_chars / 3000.0) >= 0.3 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (WHERE quality = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND predicted = 1) AS tp FROM p)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def binary_metrics(spark, d):
    out = C.binary_metrics(_predictions(spark, d), "quality", "predicted")
    return out.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {_PRED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p), n AS (SELECT sum(quality) AS n1, count(*) - sum(quality) AS n0 FROM p) SELECT round((sum(r) FILTER (WHERE quality = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS roc_auc FROM r, n GROUP BY n1, n0")
def roc_auc(spark, d):
    return C.roc_auc(_predictions(spark, d), "quality", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {_PRED}, k AS (SELECT unnest([0, 1]) AS c), per AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(count(*) FILTER (WHERE quality = c AND predicted = c) / nullif(count(*) FILTER (WHERE predicted = c), 0), 0) AS precision,
 coalesce(count(*) FILTER (WHERE quality = c AND predicted = c) / nullif(count(*) FILTER (WHERE quality = c), 0), 0) AS recall, count(*) FILTER (WHERE quality = c) AS support FROM k, p GROUP BY c),
f AS (SELECT class, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, d):
    out = C.class_report(_predictions(spark, d), "quality", "predicted")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


_LINES = [*L.STAGE_TITLES, "[PASS] STAGE 3 - SYNTAX VERIFICATION", "[FAIL] STAGE 5 - DIFFERENTIAL / SEMANTIC VERIFICATION", "GROQ REQUEST 1", "Behavioral cases: 3", "[SUCCESS] done", "noise"]


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.element_at(F.array(*[F.lit(x) for x in _LINES]), (F.pmod(F.col("event_id"), F.lit(len(_LINES))) + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"), "event_type")


@query()
def log_stage_state(spark, d):
    return L.fold(_log(spark, d))


@query("SELECT user_id, event_id, from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events) WHERE from_end <= 5")
def log_tail(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id")
    return L.tail(e, "user_id", ("ts", "event_id"), 5).select("user_id", "event_id", F.col("from_end").cast("long").alias("from_end"))


@query("SELECT user_id, string_agg(t, ' | ' ORDER BY event_id) AS failures FROM (SELECT user_id, event_id, 'Error: ' || CAST(event_id AS VARCHAR) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 5 GROUP BY user_id")
def failure_lines(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), F.col("event_id").cast("string"))).otherwise("ok")
    return L.failure_lines(e.select("user_id", "event_id", text.alias("line")), "user_id", ("event_id",), "line")


_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'not_completed' END"


@query(f"SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {_STATE} = '{k}') AS n_{k}" for k in ("completed", "running", "failed", "pending", "not_completed")) + " FROM events GROUP BY user_id")
def stage_counts(spark, d):
    return L.stage_counts(spark.read.parquet(f"{d}/events.parquet").withColumn("state", F.expr(_STATE)), "user_id", "state")


@query("SELECT (SELECT count(*) FROM documents) AS n_files, (SELECT count(*) FROM orders) AS n_cases, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM conversations) AS n_queries")
def job_statistics(spark, d):
    n = {"n_files": "documents", "n_cases": "orders", "n_vectors": "embeddings", "n_queries": "conversations"}
    out = None
    for name, t in n.items():
        one = spark.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out


@query(f"WITH {_BASE}, u AS (SELECT DISTINCT source, target, type FROM edges) SELECT count(*) AS n_edges, count(*) FILTER (WHERE contains(type, 'import')) AS n_import, count(*) FILTER (WHERE type = 'from_import') AS n_from_import, count(*) FILTER (WHERE type = 'function_call') AS n_call, count(*) FILTER (WHERE type = 'inheritance') AS n_inheritance FROM u")
def ui_edge_dedup(spark, d):
    t = F.col("type")
    return _edges(spark, d).select("source", "target", "type").distinct().agg(
        F.count("*").alias("n_edges"), F.count_if(t.contains("import")).alias("n_import"), F.count_if(t == "from_import").alias("n_from_import"), F.count_if(t == "function_call").alias("n_call"), F.count_if(t == "inheritance").alias("n_inheritance")
    )


@query("SELECT label, count(*) AS n_records, max(len(embedding)) AS dimension FROM embeddings GROUP BY label")
def embedding_summary(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n_records"), F.max(F.size("embedding")).cast("long").alias("dimension"))


@query("SELECT user_id, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, time_bucket(INTERVAL 1 HOUR, ts)")
def ext_tumbling(spark, d):
    out = L.tumbling(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 hour")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session(spark, d):
    out = L.sessions(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
