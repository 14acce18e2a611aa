"""Migration plans: triage, risk, order, related tests, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import file_name


# Texts of plans and manifests.
PRESERVE_REASONS = (
    "Already compatible with the target Python version.",
    "Required by one or more migrated production files and preserved unchanged because it does not require automatic migration.",
)
SKIP_REASONS = ("Python 2 file.", "Already compatible with Python 3.", "Python version is ambiguous; requires manual review.")
AUTOMATIC = "AUTOMATIC_NON_MIGRATED_FILE"


def triage(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files(file, version, is_test) with decision MIGRATE, PRESERVE or SKIP and reason."""
    production = ~F.col("is_test")
    migrate = production & (F.col("version") == "Python 2")
    needed = edges.join(files.where(migrate).select(F.col("file").alias("source")), "source", "left_semi").select(F.col("target").alias("file")).distinct().withColumn("needed", F.lit(True))
    out = files.join(needed, "file", "left").withColumn("needed", F.coalesce("needed", F.lit(False)))
    decision = F.when(migrate, "MIGRATE").when(production & ((F.col("version") == "Python 3") | F.col("needed")), "PRESERVE").otherwise("SKIP")
    preserved = F.when(F.col("version") == "Python 3", PRESERVE_REASONS[0]).otherwise(PRESERVE_REASONS[1])
    skipped = F.when(F.col("version") == "Python 2", SKIP_REASONS[0]).when(F.col("version") == "Python 3", SKIP_REASONS[1]).otherwise(SKIP_REASONS[2])
    reason = F.when(decision == "PRESERVE", preserved).when(decision == "SKIP", skipped)
    return out.withColumn("decision", decision).withColumn("reason", reason)


def risk_score(n_reasons: Column, n_targets: Column, n_sources: Column, any_test: Column, edges_in: Column) -> Column:
    return F.least(
        F.lit(100),
        F.least(10 * n_reasons, F.lit(40)) + F.least(5 * n_targets, F.lit(20)) + F.least(8 * n_sources, F.lit(25)) + F.when(any_test, 5).otherwise(0) + F.when(edges_in >= 5, 10).otherwise(0),
    )


def risk_label(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")


def required_by(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files that some wanted file depends on."""
    return edges.join(wanted.select(F.col("file").alias("source")), "source", "left_semi").select(F.col("target").alias("file")).distinct()


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def related_tests(units: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, test): tests that depend on a unit, or whose stem holds the unit's stem.

    "Holds" is an equi-join on the substrings of test stems of the lengths that unit stems have,
    so no pair of unrelated names ever meets.
    """
    direct = edges.select(F.col("target").alias("file"), F.col("source").alias("test")).join(units.select("file"), "file", "left_semi").join(tests.select(F.col("file").alias("test")), "test", "left_semi")
    named = units.select("file", stem(F.col("file")).alias("stem"))
    lengths = F.sort_array(F.collect_set(F.length("stem")))
    most = named.agg(lengths.alias("lengths"))  # a few dozen lengths at most: file names are short
    own = stem(F.col("file"))
    subs = F.flatten(F.transform("lengths", lambda n: F.when(F.length("own") >= n, F.transform(F.sequence(F.lit(1), F.length("own") - n + 1), lambda i: F.substring(F.col("own"), i, n))).otherwise(F.array().cast("array<string>"))))
    parts = tests.select(F.col("file").alias("test"), own.alias("own")).join(F.broadcast(most)).select("test", F.explode(F.array_distinct(subs)).alias("stem"))
    by_name = parts.join(named, "stem").select("file", "test").where("file <> test")
    return direct.select("file", "test").union(by_name).distinct()


def neighbours(ordered: DataFrame, by: str, order: tuple[str, ...], item: str) -> DataFrame:
    """Position, number of items, previous and next item within each group."""
    w = Window.partitionBy(by).orderBy(*order)
    return ordered.withColumns(
        {
            "position": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy(by)), "previous": F.lag(item).over(w), "next": F.lead(item).over(w),
        }
    )


def before_and_after(ordered: DataFrame, by: str, order: tuple[str, ...], item: str) -> DataFrame:
    """All items before and after each within its group, as ordered lists; for groups of plan size."""
    w = Window.partitionBy(by).orderBy(*order)
    return ordered.withColumn("done", F.collect_list(item).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "pending", F.collect_list(item).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


def assemble(files: DataFrame, plan: DataFrame, outputs: DataFrame) -> DataFrame:
    """file, decision, source, status, reason: what becomes of every file of a repository; MIGRATE wins over PRESERVE over SKIP."""
    rank = F.array_position(F.array(F.lit("MIGRATE"), F.lit("PRESERVE"), F.lit("SKIP")), F.upper("decision"))
    one = plan.groupBy("file").agg(F.min_by(F.upper("decision"), rank).alias("planned"))
    out = files.join(one, "file", "left").join(outputs.select("file", F.lit(True).alias("has_output")).distinct(), "file", "left")
    decision = F.coalesce("planned", F.lit("PRESERVE"))
    made = F.coalesce("has_output", F.lit(False))
    return out.select(
        "file", decision.alias("decision"),
        F.when((decision == "MIGRATE") & made, "LLM").when(decision != "SKIP", "ORIGINAL").alias("source"),
        F.when(decision == "SKIP", "SKIPPED").when((decision == "MIGRATE") & ~made, "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(F.col("planned").isNull(), AUTOMATIC).when((decision == "MIGRATE") & ~made, "no migrated output").alias("reason"),
    )


def missing_outputs(plan: DataFrame, outputs: DataFrame) -> DataFrame:
    return plan.where(F.upper("decision") == "MIGRATE").select("file").distinct().join(outputs.select("file"), "file", "left_anti")


def assembly_statistics(assembled: DataFrame) -> DataFrame:
    d, s = F.col("decision"), F.col("status")
    out = assembled.agg(
        F.count("*").alias("n_files"), F.count_if((d == "MIGRATE") & (s == "SUCCESS")).alias("n_migrated"), F.count_if(d == "PRESERVE").alias("n_preserved"),
        F.count_if(F.col("reason") == AUTOMATIC).alias("n_automatic"), F.count_if(d == "SKIP").alias("n_skipped"), F.count_if(s == "FAILED").alias("n_failed"),
    )
    return out.withColumn("final_status", F.when(F.col("n_failed") > 0, "FAILED").otherwise("SUCCESS"))


def split_by_decision(plan: DataFrame) -> DataFrame:
    d = F.upper("decision")
    return plan.agg(*[F.array_sort(F.collect_list(F.when(d == x, F.col("file")))).alias(x.lower()) for x in ("MIGRATE", "PRESERVE", "SKIP")])
