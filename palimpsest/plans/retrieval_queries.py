"""Retrieval and prompt queries, each beside its SQL. Searches take every row whose id is divisible by 100 as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import retrieval as R
from palimpsest.operators.graph import import_names
from palimpsest.plans.scan_queries import _AFTER
from palimpsest.sources import corpus

QUERIES, ORACLE_SQL = {}, {}
FLOOR, FINAL = 0.1, 0.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _kb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _queries(spark, d):
    return _kb(spark, d).where("vec_id % 100 = 0")


def _facts(spark, d):
    p = corpus.pairs(spark, d)
    lib = F.when(F.col("doc_id") % 3 == 0, "urllib2").otherwise("six")
    return p.select(F.col("doc_id").alias("vec_id"), "original_code", "migrated_code", "function_name", lib.alias("lib"), import_names(F.col("original_code")).alias("imports"), (F.col("doc_id") % 4 == 0).alias("verified"))


def _query_facts(spark, d):
    f = _facts(spark, d).where("vec_id % 100 = 0")
    return f.select(F.col("vec_id").alias("query_id"), F.col("original_code").alias("code"), "function_name", "lib", "imports")


_SIM = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, e.vec_id, q.label = e.label AS same, round(list_cosine_similarity(q.v, e.v), 9) AS similarity FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)"""


def _top(k: int, where: str) -> str:
    return f"SELECT * FROM (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims WHERE {where}) WHERE rank <= {k}"


def _out(df):
    return df.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


_ROUND = "SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM"


@query(f"WITH {_SIM} {_ROUND} ({_top(20, 'similarity >= -1')})")
def vector_topk(spark, d):
    return _out(R.vector_topk(_queries(spark, d), _kb(spark, d), 20, -1.0))


@query(f"WITH {_SIM} {_ROUND} ({_top(20, 'similarity >= 0.25')})")
def vector_threshold(spark, d):
    return _out(R.vector_topk(_queries(spark, d), _kb(spark, d), 20, 0.25))


@query(f"WITH {_SIM} {_ROUND} ({_top(20, 'same AND similarity >= 0.1')})")
def pool_filtered_topk(spark, d):
    return _out(R.vector_topk(_queries(spark, d), _kb(spark, d), 20, 0.1, True, pool_col="label"))


_FACTS = f"""{corpus.PAIRS_SQL},
facts AS (SELECT doc_id AS vec_id, function_name, CASE WHEN doc_id % 3 = 0 THEN 'urllib2' ELSE 'six' END AS lib, doc_id % 4 = 0 AS verified, {_AFTER} AS after, {rules.rules_sql('original_code', rules.QUERY_PATTERNS)} AS qp,
 list_distinct(list_transform(regexp_extract_all(original_code, '(?m)^\\s*(?:import|from)\\s+([A-Za-z_][\\w.]*)', 1), lambda x: lower(x))) AS imports FROM pairs),
evidence AS (SELECT q.vec_id AS query_id, k.vec_id, round(CASE WHEN len(q.qp) > 0 AND len(k.after) > 0 THEN len(list_intersect(q.qp, k.after)) / len(q.qp) ELSE 0 END, 4) AS pattern_score,
 CASE WHEN q.function_name = k.function_name THEN 1.0 WHEN contains(q.function_name, k.function_name) OR contains(k.function_name, q.function_name) THEN 0.5 ELSE 0.0 END AS function_score,
 round(greatest(CASE WHEN q.lib = k.lib THEN 1.0 ELSE 0.0 END, CASE WHEN len(q.imports) > 0 THEN len(list_intersect(q.imports, list_concat([k.lib], k.imports))) / len(q.imports) ELSE 0 END), 4) AS library_score, k.verified
 FROM facts q JOIN facts k ON q.vec_id % 100 = 0)"""
_FINAL = "round(least(1.0, similarity + 0.15 * pattern_score + 0.05 * function_score + 0.05 * library_score + CASE WHEN verified THEN 0.03 ELSE 0.0 END), 4)"


@query(f"WITH {_SIM}, {_FACTS} SELECT query_id, vec_id, pattern_score, CAST(function_score AS DOUBLE) AS function_score, library_score FROM ({_top(20, 'similarity >= -1')}) JOIN evidence USING (query_id, vec_id)")
def evidence_scores(spark, d):
    c = R.vector_topk(_queries(spark, d), _kb(spark, d), 20, -1.0)
    out = R.rerank(c.drop("rank"), _query_facts(spark, d), _facts(spark, d), 20, -1.0, -1.0)
    return out.select("query_id", "vec_id", "pattern_score", "function_score", "library_score")


def _reranked(spark, d, same):
    c = R.vector_topk(_queries(spark, d), _kb(spark, d), 20, FLOOR, same, pool_col="label" if same is not None else None)
    return R.rerank(c.drop("rank"), _query_facts(spark, d), _facts(spark, d), 5, FLOOR, FINAL)


def _rerank_sql(where: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, similarity DESC, vec_id) AS rank FROM (
 SELECT query_id, vec_id, similarity, pattern_score, function_score, library_score, {_FINAL} AS final_score FROM ({_top(20, where)}) JOIN evidence USING (query_id, vec_id)) WHERE final_score >= {FINAL}) WHERE rank <= 5"""


@query(f"WITH {_SIM}, {_FACTS} SELECT query_id, vec_id, round(similarity, 6) AS similarity, pattern_score, CAST(function_score AS DOUBLE) AS function_score, library_score, final_score, rank FROM ({_rerank_sql(f'similarity >= {FLOOR}')})")
def rerank_topk(spark, d):
    return _out(_reranked(spark, d, None))


_TIERS = f"""{_SIM}, {_FACTS}, prim AS ({_rerank_sql(f'same AND similarity >= {FLOOR}')}), sec AS ({_rerank_sql(f'NOT same AND similarity >= {FLOOR}')}),
short AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query_id FROM prim GROUP BY 1 HAVING count(*) >= 3)),
tiers AS (SELECT query_id, vec_id, final_score, 'primary' AS source FROM prim UNION ALL SELECT query_id, vec_id, round(final_score * 0.9, 4), 'secondary' FROM sec WHERE query_id IN (SELECT query_id FROM short)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, source, vec_id) AS rank FROM tiers) WHERE rank <= 5)"""


def _tiered(spark, d):
    q = _queries(spark, d).select(F.col("vec_id").alias("query_id"))
    return q, R.two_tier(q, _reranked(spark, d, True), _reranked(spark, d, False))


@query(f"WITH {_TIERS} SELECT query_id, vec_id, final_score, source, rank FROM ranked")
def two_tier_retrieval(spark, d):
    return _tiered(spark, d)[1].select("query_id", "vec_id", "final_score", "source", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TIERS} SELECT q.vec_id AS query_id, count(*) FILTER (WHERE source = 'primary') AS n_primary, count(*) FILTER (WHERE source = 'secondary') AS n_secondary, count(source) > 0 AS rag_used FROM embeddings q LEFT JOIN ranked r ON r.query_id = q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1")
def retrieval_statistics(spark, d):
    return R.retrieval_statistics(*_tiered(spark, d))


@query("WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS v FROM x GROUP BY 1, 2) SELECT label, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m")
def mean_pool_l2(spark, d):
    return R.mean_pool(_kb(spark, d), "label", "embedding").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


_PACK = f"""{_SIM.replace('e AS (', 'e AS (', 1)}, cand AS (SELECT query_id, c.vec_id, rank, 850 + n_chars AS cost FROM ({_top(20, 'similarity >= -1')}) c JOIN documents ON doc_id = c.vec_id),
seq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM cand),
fold AS (SELECT query_id, i, vec_id, rank, cost, CASE WHEN cost <= 9000 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 9000 THEN 1 ELSE 0 END AS n, cost <= 9000 AS took FROM seq WHERE i = 1
 UNION ALL SELECT s.query_id, s.i, s.vec_id, s.rank, s.cost, CASE WHEN f.n < 10 AND f.used + s.cost <= 9000 THEN f.used + s.cost ELSE f.used END, CASE WHEN f.n < 10 AND f.used + s.cost <= 9000 THEN f.n + 1 ELSE f.n END, f.n < 10 AND f.used + s.cost <= 9000 FROM seq s JOIN fold f ON s.query_id = f.query_id AND s.i = f.i + 1)"""


@query(f"WITH RECURSIVE {_PACK} SELECT query_id, vec_id, rank, cost, max(used) OVER (PARTITION BY query_id) AS used FROM fold WHERE took")
def rag_pack_greedy(spark, d):
    c = R.vector_topk(_queries(spark, d), _kb(spark, d), 20, -1.0)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "n_chars")
    return R.pack_greedy(c.join(docs, "vec_id"), 850 + F.col("n_chars")).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT * FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM conversations) WHERE total <= 600")
def prompt_prefix_budget(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return R.prefix_budget(c, "conv_id", ("turn", "role", "text"), F.length("text"), 600).select("conv_id", "turn", "total")


@query("WITH p AS (SELECT doc_id, text || chr(10) || 'CODE TO MIGRATE' || chr(10) || source AS prompt FROM documents) SELECT doc_id, sha256(CASE WHEN length(prompt) <= 500 THEN prompt ELSE substr(prompt, 1, CAST(greatest(0, least(position('CODE TO MIGRATE' IN prompt) - 1, 500 - length(substr(prompt, position('CODE TO MIGRATE' IN prompt), 500)))) AS BIGINT)) || substr(prompt, position('CODE TO MIGRATE' IN prompt), 500) END) AS prompt_sha FROM p")
def prompt_fit(spark, d):
    p = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("text", F.lit("\nCODE TO MIGRATE\n"), "source").alias("prompt"))
    return p.select("doc_id", F.sha2(R.fitted_prompt(F.col("prompt"), "CODE TO MIGRATE", 500).cast("binary"), 256).alias("prompt_sha"))


@query(f"WITH {corpus.FILES_SQL}, r AS (SELECT *, array_to_string(list_sort({rules.rules_sql('content', rules.PY2_VOTES)}), ', ') AS issues FROM files) SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), '## ROLE' || chr(10) || 'Migrate the file.', CASE WHEN issues <> '' THEN '## ISSUES' || chr(10) || issues END, '## PATH' || chr(10) || path, '## CODE TO MIGRATE' || chr(10) || content)) AS prompt_sha FROM r")
def prompt_assemble(spark, d):
    f = corpus.files(spark, d)
    issues = F.array_join(F.array_sort(rules.hits(F.col("content"), rules.PY2_VOTES)), ", ")
    prompt = R.assembled_prompt([("ROLE", F.lit("Migrate the file.")), ("ISSUES", issues), ("PATH", F.col("path")), ("CODE TO MIGRATE", F.col("content"))])
    return f.select("doc_id", F.sha2(prompt.cast("binary"), 256).alias("prompt_sha"))


def _replies(spark, d):
    c, t = spark.read.parquet(f"{d}/conversations.parquet"), F.col("text")
    fence = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Intro\n```Python\n"), t, F.lit("\n```\nOutro"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(t)
    return c.select("conv_id", "turn", fence.alias("reply"))


_REPLY = "r AS (SELECT conv_id, turn, text, turn % 3 AS m FROM conversations)"


@query(f"WITH {_REPLY} SELECT conv_id, turn, trim(CASE WHEN m = 2 THEN text ELSE regexp_replace(CASE WHEN m = 1 THEN chr(10) || text || chr(10) ELSE regexp_replace(text || chr(10), '^[ \\t\\n\\f\\r]+', '') END, '^(?i:python)\\s*', '') END, ' ') AS code FROM r")
def fenced_code(spark, d):
    return _replies(spark, d).select("conv_id", "turn", R.fenced_code(F.col("reply")).alias("code"))


@query(f"WITH {_REPLY} SELECT conv_id, turn, CASE WHEN m = 0 THEN 'Intro' || chr(10) || 'Outro' ELSE '' END AS explanation FROM r")
def explanation(spark, d):
    return _replies(spark, d).select("conv_id", "turn", R.explanation(F.col("reply")).alias("explanation"))


@query("SELECT event_id, regexp_matches(event_type || ' ' || CAST(event_id AS VARCHAR), '503|UNAVAILABLE|429|RESOURCE_EXHAUSTED|500|INTERNAL') AS retry FROM events")
def retryable_errors(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", R.retryable(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("retry"))
