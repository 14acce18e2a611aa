"""Vector retrieval, evidence-based reranking, tiered fallback, packing and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import rules

#: Weights of the evidence on top of the similarity.
PATTERN_WEIGHT, FUNCTION_WEIGHT, LIBRARY_WEIGHT, VERIFIED_WEIGHT = 0.15, 0.05, 0.05, 0.03
SECONDARY_WEIGHT, LEAST_PRIMARY = 0.9, 3


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right width as rows, and which rows have one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(-1).to_pylist(), dtype=np.int64)
    good = lengths == width
    values = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(values.reshape(-1, width)), good


def _block_topk(held, k: int, least: float, same_pool: bool | None):
    """Each batch's k best rows for each query of a block: what leaves a task is bounded by queries x k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pools, q = held.value
        best = [[np.zeros(0), np.zeros(0, np.int64)] for _ in ids]
        for batch in batches:
            x, good = _matrix(batch.column(1), q.shape[1])
            own = batch.column(0).to_numpy(zero_copy_only=False)[good]
            pool = np.array(batch.column(2).to_pylist(), dtype=object)[good]
            scores = np.round(_unit(x) @ q.T, 9)
            for j in range(len(ids)):
                keep = (scores[:, j] >= least) & (own != ids[j])
                if same_pool is not None:
                    keep &= (pool == pools[j]) == same_pool
                s, i = np.r_[best[j][0], scores[keep, j]], np.r_[best[j][1], own[keep]]
                order = np.lexsort((i, -s))[:k]
                best[j] = [s[order], i[order]]
        out = [(ids[j], i, s) for j in range(len(ids)) for s, i in zip(*best[j], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
            names=["query_id", "vec_id", "similarity"],
        )

    return run


def vector_topk(
    queries: DataFrame, kb: DataFrame, k: int = 20, least: float = 0.6, same_pool: bool | None = None, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pool_col: str | None = None
) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k rows of kb most cosine-similar to each query, at least `least`.

    Exact: every query meets every row, in blocks of at most `block` queries that go to the tasks as
    one matrix; each task returns its own k best. same_pool asks for rows of the query's pool (True)
    or of other pools (False). A query never finds its own id; a row whose vector has another width
    or is null is skipped.
    """
    if k <= 0 or not -1 <= least <= 1:
        raise ValueError("k must be positive and the threshold a cosine")
    spark = queries.sparkSession
    pool = F.col(pool_col) if pool_col else F.lit(0)
    rows = kb.select(F.col(id_col).cast("long"), F.col(vector_col), pool)
    schema, found, held = "query_id long, vec_id long, similarity double", [], []

    def search() -> DataFrame:
        ids = np.array([r[0] for r in held])
        matrix = _unit(np.array([r[1] for r in held], dtype=np.float64))
        return rows.mapInArrow(_block_topk(spark.sparkContext.broadcast((ids, [r[2] for r in held], matrix)), k, least, same_pool), schema)

    for r in queries.select(F.col(id_col).cast("long"), F.col(vector_col), pool).where(F.col(vector_col).isNotNull()).toLocalIterator():
        held.append(r)
        if len(held) == block:
            found.append(search())
            held = []
    if held:
        found.append(search())
    if not found:
        return spark.createDataFrame([], schema + ", rank int")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return ranked(every, "similarity", k)


def ranked(rows: DataFrame, score: str, k: int, ties: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k best of each query by score, ties in the given order, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pattern_score(query_patterns: Column, pair_patterns: Column) -> Column:
    n = F.size(query_patterns)
    return F.when((n > 0) & (F.size(pair_patterns) > 0), F.size(F.array_intersect(query_patterns, pair_patterns)) / n).otherwise(0.0)


def function_score(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.5).otherwise(0.0)


def library_score(query_lib: Column, lib: Column, query_imports: Column, imports: Column) -> Column:
    exact = F.when(F.lower(F.trim(query_lib)) == F.lower(F.trim(lib)), 1.0).otherwise(0.0)
    n = F.size(query_imports)
    return F.greatest(exact, F.when(n > 0, F.size(F.array_intersect(query_imports, imports)) / n).otherwise(0.0))


def candidate_imports(source_lib: Column, imports: Column) -> Column:
    """Lower-case names a candidate brings: its comma-separated libraries and its import statements as they stand."""
    listed = F.filter(F.transform(F.split(F.coalesce(source_lib, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_union(listed, F.transform(F.coalesce(imports, F.array().cast("array<string>")), lambda x: F.lower(x)))


def final_score(similarity: Column, pattern: Column, function: Column, library: Column, verified: Column) -> Column:
    bonus = PATTERN_WEIGHT * pattern + FUNCTION_WEIGHT * function + LIBRARY_WEIGHT * library + F.when(verified.eqNullSafe(True), VERIFIED_WEIGHT).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), similarity + bonus), 4)


def rerank(candidates: DataFrame, query_facts: DataFrame, kb_facts: DataFrame, k: int = 5, least_similarity: float = 0.7, least_final: float = 0.78) -> DataFrame:
    """candidates(query_id, vec_id, similarity) with evidence scores; the k best of each query over both thresholds.

    facts: code, function_name, lib, imports by query_id; original_code, migrated_code, function_name,
    lib, imports, verified by vec_id. The raw similarity is tested before any text is looked at.
    """
    q = query_facts.select("query_id", rules.hits(F.col("code"), rules.QUERY_PATTERNS).alias("q_patterns"), F.col("function_name").alias("q_function"), F.col("lib").alias("q_lib"), F.col("imports").alias("q_imports"))
    rows = candidates.where(F.col("similarity") >= least_similarity).join(kb_facts, "vec_id").join(q, "query_id")
    rows = rows.withColumns(
        {
            "pattern_score": F.round(pattern_score(F.col("q_patterns"), rules.before_after(F.col("original_code"), F.col("migrated_code"))), 4),
            "function_score": function_score(F.col("q_function"), F.col("function_name")),
            "library_score": F.round(library_score(F.col("q_lib"), F.col("lib"), F.col("q_imports"), candidate_imports(F.col("lib"), F.col("imports"))), 4),
        }
    )
    rows = rows.withColumn("final_score", final_score(F.col("similarity"), F.col("pattern_score"), F.col("function_score"), F.col("library_score"), F.col("verified")))
    scored = rows.where(F.col("final_score") >= least_final).select("query_id", "vec_id", "similarity", "pattern_score", "function_score", "library_score", "final_score")
    return ranked(scored, "final_score", k, (F.col("similarity").desc(), "vec_id"))


def two_tier(queries: DataFrame, primary: DataFrame, secondary: DataFrame, k: int = 5) -> DataFrame:
    """Primary results, and for queries with fewer than three of them the secondary ones at 0.9 of their score; the k best."""
    short = queries.select("query_id").join(primary.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < LEAST_PRIMARY).select("query_id")
    second = secondary.join(short, "query_id", "left_semi").withColumn("final_score", F.round(F.col("final_score") * SECONDARY_WEIGHT, 4)).withColumn("source", F.lit("secondary"))
    both = primary.withColumn("source", F.lit("primary")).unionByName(second).drop("rank")
    return ranked(both, "final_score", k, ("source", "vec_id"))


def retrieval_statistics(queries: DataFrame, results: DataFrame) -> DataFrame:
    n = results.groupBy("query_id").agg(F.count_if(F.col("source") == "primary").alias("n_primary"), F.count_if(F.col("source") == "secondary").alias("n_secondary"))
    out = queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["n_primary", "n_secondary"])
    return out.withColumn("rag_used", F.col("n_primary") + F.col("n_secondary") > 0)


def mean_pool(tokens: DataFrame, by: str, vector: str, mask: Column | None = None) -> DataFrame:
    """(by, dim, value): the masked mean of vectors by group, scaled to unit length."""
    m = (mask if mask is not None else F.lit(1.0)).cast("double")
    rows = tokens.select(by, m.alias("m"), F.posexplode(vector).alias("dim", "x"))
    mean = rows.groupBy(by, "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("v"))
    norm = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return mean.join(norm, by).select(by, "dim", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("value"))


def pack_greedy(candidates: DataFrame, cost: Column, most: int = 10, budget: int = 9000) -> DataFrame:
    """Per query, in rank order: an item joins if it fits in what is left of the budget; one that doesn't is skipped and the next is tried."""
    per = candidates.withColumn("cost", cost.cast("long")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "cost"))).alias("items"))
    start = F.expr("named_struct('used', 0L, 'taken', cast(array() AS array<struct<rank:int,vec_id:bigint,cost:bigint>>))")
    fits = "size(acc.taken) < {m} AND acc.used + x.cost <= {b}".format(m=most, b=budget)
    fold = F.expr(
        f"aggregate(items, start, (acc, x) -> CASE WHEN {fits} THEN named_struct('used', acc.used + x.cost, 'taken', concat(acc.taken, array(named_struct('rank', x.rank, 'vec_id', x.vec_id, 'cost', x.cost)))) ELSE acc END)"
    )
    return per.withColumn("start", start).select("query_id", fold.alias("p")).select("query_id", "p.used", F.explode("p.taken").alias("t")).select("query_id", "used", "t.rank", "t.vec_id", "t.cost")


def prefix_budget(chunks: DataFrame, by: str, order: tuple[str, ...], size: Column, budget: int) -> DataFrame:
    """Chunks of each group up to the first that would pass the budget; nothing after it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def fitted_prompt(prompt: Column, marker: str, budget: int) -> Column:
    """A prompt within a budget: whole, else its head and its marked section each cut to size, else its head."""
    at = F.instr(prompt, marker)
    tail = F.substring(prompt, at, F.lit(budget))
    head = F.substring(prompt, F.lit(1), F.greatest(F.lit(0), F.least(at - 1, F.lit(budget) - F.length(tail))))
    return F.when(F.length(prompt) <= budget, prompt).when(at > 0, F.concat(head, tail)).otherwise(F.substring(prompt, 1, budget))


def assembled_prompt(sections: list[tuple[str, Column]]) -> Column:
    """Titled sections in order; one whose body is null or empty is left out."""
    part = lambda t, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {t}\n"), c))
    return F.concat_ws("\n\n", *[part(t, c) for t, c in sections])


def fenced_code(reply: Column) -> Column:
    """The first python fence, else the first fence, else the whole reply."""
    named = F.regexp_extract(reply, r"(?is)```python\s*(.*?)```", 1)
    plain = F.regexp_replace(F.regexp_extract(reply, r"(?s)```(.*?)```", 1), r"^(?i:python)\s*", "")
    return F.trim(F.coalesce(F.nullif(named, F.lit("")), F.nullif(plain, F.lit("")), reply))


def fenced_code_exact(reply: Column) -> Column:
    """The second client's reading: a fence named in lower case, else the text between the first two fences, else all; each trimmed."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = trim(F.coalesce(reply, F.lit("")))
    named, pieces = F.regexp_extract_all(text, F.lit(r"(?s)```python(.*?)```"), 1), F.split(text, "```")
    return F.when(F.size(named) > 0, trim(F.get(named, F.lit(0)))).when(F.size(pieces) >= 3, trim(F.regexp_replace(F.get(pieces, F.lit(1)), "^python", ""))).otherwise(text)


def ranked_examples(examples: DataFrame, by: str, order: str) -> DataFrame:
    """Examples with their rank: those of the primary source first, then by final score and similarity; equal ones in their order."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    primary = F.coalesce((F.lower("retrieval_source") == "primary").cast("int"), F.lit(0))
    w = Window.partitionBy(by).orderBy(primary.desc(), number("final_score").desc(), number("similarity").desc(), order)
    return examples.withColumn("rank", F.row_number().over(w))


def retrieval_counts(results: DataFrame) -> DataFrame:
    """Queries made, and those that gave a result."""
    return results.agg(F.count("*").alias("n_queries"), F.count_if(F.col("retrieval").isNotNull()).alias("n_successful"))


def with_source(results: DataFrame, files: DataFrame) -> DataFrame:
    """Each model result beside the source text of its file; empty where the repository has none."""
    text = files.select(F.col("path").alias("file"), F.col("content").alias("source_code"))
    return results.join(text, "file", "left").fillna("", ["source_code"])


def explanation(reply: Column) -> Column:
    """The text between fences: every other piece, trimmed and joined by lines; empty without a whole fence."""
    pieces = F.split(reply, "```")
    kept = F.filter(F.transform(F.filter(pieces, lambda x, i: i % 2 == 0), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(pieces) < 3, "").otherwise(F.array_join(kept, "\n"))


def retryable(message: Column) -> Column:
    return F.coalesce(message.rlike("503|UNAVAILABLE|429|RESOURCE_EXHAUSTED|500|INTERNAL"), F.lit(False))
