"""Composed reports: the risk report, the lenient comparator, job evidence and display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import compare as C

#: The forest sees seven features; distinct differences are reported but not modelled unless corrected.
MODEL_FEATURES = ("function_count", "class_count", "dependent_count", "behavioral_cases", "semantic_differences", "semantic_difference_rate", "existing_test_failed")


def risk_report(files: DataFrame, symbols: DataFrame, edges: DataFrame, results: DataFrame, failed: DataFrame, keep_quirk: bool = True) -> DataFrame:
    """One row for each file(file): features, anomaly score, risk and reasons.

    results(file, equivalent, key) are the compared cases, failed(file) the files whose own tests
    fail. With the quirk, dependents count as 0, as they always did; without it they are counted
    from the edges.
    """
    counts = symbols.groupBy("file").agg(F.count_if(F.col("type") == "function").alias("function_count"), F.count_if(F.col("type") == "class").alias("class_count"))
    dependents = edges.groupBy(F.col("target").alias("file")).agg(F.countDistinct("source").alias("dependents"))
    b = C.behaviour(results).select(
        "file", F.col("n_cases").alias("behavioral_cases"), F.col("n_differences").alias("semantic_differences"), F.col("n_distinct").alias("unique_semantic_differences"), F.col("rate").alias("semantic_difference_rate")
    )
    rows = files.select("file").distinct().join(counts, "file", "left").join(dependents, "file", "left").join(b, "file", "left")
    rows = rows.join(failed.select("file", F.lit(1).alias("existing_test_failed")).distinct(), "file", "left").na.fill(0)
    rows = rows.withColumn("dependent_count", F.lit(0).cast("long") if keep_quirk else F.col("dependents")).drop("dependents")
    rows = rows.join(C.isolation_scores(rows, list(MODEL_FEATURES), "file"), "file")
    test, rate, n = F.col("existing_test_failed") > 0, F.col("semantic_difference_rate"), F.col("semantic_differences")
    return rows.withColumn("risk", C.risk(test, rate, n, F.col("anomaly_score"))).withColumn("reasons", C.risk_reasons(test, rate, n, F.col("dependent_count")))


def lenient_differences(fields: list[str], left: str = "o", right: str = "m") -> Column:
    """Differences with a flag: the return type alone is recorded, but is no semantic difference."""
    plain = C.differences([*fields, "return_type"], left, right)
    return F.transform(plain, lambda x: F.struct(x["field"].alias("field"), x["original"].alias("original"), x["migrated"].alias("migrated"), (x["field"] != "return_type").alias("semantic")))


def changed_keys(original: Column, migrated: Column) -> Column:
    """Sorted keys of two string maps whose values differ or that only one has."""
    keys = F.array_union(F.map_keys(original), F.map_keys(migrated))
    return F.array_sort(F.filter(keys, lambda k: ~original[k].eqNullSafe(migrated[k]) | (F.array_contains(F.map_keys(original), k) != F.array_contains(F.map_keys(migrated), k))))


def without_null_words(value: Column) -> Column:
    """JSON text whose string values "null" and "None" are nulls, at any depth; keys and longer strings stay as they are, whatever they quote."""
    string = r'"(?:[^"\\]|\\.)*+"'
    strings, between = F.regexp_extract_all(value, F.lit(string), 0), F.split(value, string, -1)

    parts = F.transform(F.array(F.struct(strings.alias("strings"), between.alias("between"))), lambda s: F.array_join(F.transform(s["between"], lambda p, k: _filled_piece(s, p, k)), ""))
    return parts[0]


def _filled_piece(s: Column, piece: Column, k: Column) -> Column:
    own, after = F.get(s["strings"], k), F.get(s["between"], k + 1)
    return F.concat(piece, F.coalesce(F.when(own.isin('"null"', '"None"') & ~after.rlike(r"^\s*:"), "null").otherwise(own), F.lit("")))


def evidence(plan: DataFrame, retrieved: DataFrame, compared: DataFrame, risks: DataFrame) -> DataFrame:
    """For each planned file a list of what speaks for its migration, in fixed order."""
    rows = plan.select("file", "reasons").join(retrieved.groupBy("file").agg(F.count("*").alias("n_examples")), "file", "left")
    rows = rows.join(compared.groupBy("file").agg(F.count("*").alias("n_cases"), F.count_if("equivalent").alias("n_equal")), "file", "left").join(risks.select("file", "risk"), "file", "left")
    parts = F.array(
        F.when(F.size("reasons") > 0, F.concat(F.lit("issues: "), F.array_join("reasons", ", "))), F.when(F.col("n_examples") > 0, F.concat(F.lit("examples: "), F.col("n_examples").cast("string"))),
        F.when(F.col("n_cases") > 0, F.concat(F.lit("cases equal: "), F.col("n_equal").cast("string"), F.lit("/"), F.col("n_cases").cast("string"))), F.when(F.col("risk").isNotNull(), F.concat(F.lit("risk: "), F.lower("risk"))),
    )
    return rows.select("file", F.filter(parts, lambda x: x.isNotNull()).alias("evidence"))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.format_number(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 1), F.lit("%"))


def title(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"[_\s]+", " ")))
