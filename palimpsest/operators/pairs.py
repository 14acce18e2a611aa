"""Before/after pairs: mining, quality, deduplication and enrichment."""

from __future__ import annotations

import ast
import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from palimpsest.functions import rules


@pandas_udf(T.BooleanType())
def parses_as_py3(code: pd.Series) -> pd.Series:
    def ok(x: str | None) -> bool:
        try:
            ast.parse(x or "")
        except (SyntaxError, ValueError):
            return False
        return True

    return code.map(ok)


@pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, to three places as Python rounds."""
    return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 3) for x, y in zip(a, b, strict=True)])


def changed_functions(original: DataFrame, migrated: DataFrame, keys: tuple[str, ...] = ("repo", "file", "name"), least: int = 2, most: int = 120) -> DataFrame:
    """Functions in both versions whose texts differ and whose new text has least..most lines."""
    both = original.select(*keys, F.col("text").alias("original_code")).join(migrated.select(*keys, F.col("text").alias("migrated_code")), list(keys))
    lines = F.size(F.split(F.regexp_replace("migrated_code", r"\n$", ""), "\n"))
    return both.where((F.col("original_code") != F.col("migrated_code")) & lines.between(least, most))


def content_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(a, F.lit("")), F.lit("\0"), F.coalesce(b, F.lit(""))).cast("binary"), 256)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first in `order`; a map-side minimum, so copies never meet in one task."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("r"))
    return first.select(key, "r.*").select(rows.columns)


def markers(pairs: DataFrame) -> DataFrame:
    """Marker lists of both sides; compatibility calls are reported apart."""
    return pairs.withColumns(
        {
            "markers_in_original": rules.hits(F.col("original_code"), rules.PAIR_MARKERS),
            "markers_remaining": rules.hits(F.col("migrated_code"), rules.PAIR_MARKERS),
            "six_in_original": rules.hits(F.col("original_code"), rules.SIX_MARKERS),
        }
    )


def quality_label(original_parses: Column, migrated_parses: Column, ratio: Column) -> Column:
    """The label of a pair from its parses, marker lists (see markers) and similarity."""
    some = lambda c: F.size(c) > 0
    return (
        F.when(~migrated_parses, "likely_noise")
        .when(~original_parses, "high_confidence")
        .when(some("markers_in_original") & ~some("markers_remaining"), "high_confidence")
        .when(some("six_in_original") & ~some("markers_remaining"), "high_confidence")
        .when(some("markers_remaining"), "needs_review")
        .when(ratio > 0.97, "likely_noise")
        .otherwise("needs_review")
    )


def graded(pairs: DataFrame) -> DataFrame:
    """Pairs with markers, parses, similarity_ratio and label."""
    out = markers(pairs).withColumns(
        {"original_parses": parses_as_py3("original_code"), "migrated_parses": parses_as_py3("migrated_code"), "similarity_ratio": similarity("original_code", "migrated_code")}
    )
    return out.withColumn("label", quality_label(F.col("original_parses"), F.col("migrated_parses"), F.col("similarity_ratio")))


def percentages(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, percent) with one decimal place."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select(label, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def deterministic_id(prefix: str, *fields: Column) -> Column:
    text = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *text).cast("binary"), 256), 1, 16))


#: Fixed value: prefix of the ids of mined pairs.
ID_PREFIX = "github_py23_"


def enriched(pairs: DataFrame) -> DataFrame:
    """Retrieval-ready columns; what is unknown is null, never guessed."""
    repo, path, sha = F.col("repo"), F.col("file_path"), F.col("base_sha")
    given = lambda c: F.when(c != "", c)
    url = F.concat(F.lit("https://github.com/"), given(repo))
    name = F.col("function_name")
    context = F.map_filter(
        F.create_map(F.lit("repo"), given(repo), F.lit("file_path"), given(path), F.lit("function_name"), given(name)), lambda k, v: v.isNotNull()
    )
    return pairs.select(
        "*",
        deterministic_id(ID_PREFIX, repo, F.col("pr_number"), path, name, sha, F.col("head_sha")).alias("id"),
        F.when(F.instr(repo, "/") > 0, F.regexp_extract(repo, "^[^/]*/(.*)$", 1)).alias("project_name"),
        url.alias("repo_url"),
        F.concat(url, F.lit("/blob/"), given(sha), F.lit("/"), given(path)).alias("source_url"),
        F.concat(url, F.lit("/blob/"), given(F.col("head_sha")), F.lit("/"), given(path)).alias("target_url"),
        F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).alias("class_name"),
        F.when(F.size(context) > 0, context).alias("context"),
    )


def hashed_sample(rows: DataFrame, n: int, key: str) -> DataFrame:
    """A reproducible sample of n rows without replacement: the feature is the limit."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def split_of_prefix(rows: DataFrame, prefixes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the split of the longest prefix of their key among prefixes(prefix, split); an equi-join on the key's own prefixes of the lengths that occur."""
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row, as many as there are lengths
    cut = F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.length(key))), lambda n: F.substring(F.col(key), F.lit(1), n))
    probed = rows.join(F.broadcast(lengths)).withColumn("prefix", F.explode(cut)).drop("lengths")
    found = probed.join(prefixes.dropDuplicates(["prefix"]), "prefix").groupBy(key).agg(F.max_by("split", F.length("prefix")).alias("split"))
    return rows.join(found, key, "left")


def high_confidence(graded_pairs: DataFrame) -> DataFrame:
    """The pairs whose quality label lets them into the knowledge base."""
    return graded_pairs.where(F.col("label") == "high_confidence")


def leaking(rows: DataFrame, text: str, split: str) -> DataFrame:
    """Texts that stand in more than one split."""
    return rows.groupBy(text).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("case_number", F.row_number().over(Window.partitionBy(by).orderBy(order)))
