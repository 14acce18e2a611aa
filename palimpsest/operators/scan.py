"""Scanning, version detection and selection of source files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators.parse import grammars
from palimpsest.functions.paths import classified, excluded

CATEGORIES = ("code", "config", "non_code", "unknown")
CONFIDENCE = ("low", "medium", "high")


def scan(files: DataFrame) -> DataFrame:
    """The manifest: files outside excluded folders, classified."""
    return classified(files.where(~excluded(F.col("path"))))


def scan_summary(manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, n): counts by language and by category, categories without files included as 0."""
    spark = manifest.sparkSession
    domain = spark.createDataFrame([("category", c) for c in CATEGORIES], "kind string, name string")
    rows = manifest.select(F.explode(F.array(F.struct(F.lit("language").alias("kind"), F.col("language").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")))).alias("x"))
    counted = rows.groupBy("x.kind", "x.name").count().withColumnRenamed("count", "n")
    zero = domain.join(counted.select("kind", "name"), ["kind", "name"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(zero)


def languages(manifest: DataFrame) -> DataFrame:
    return manifest.where("language <> 'Unknown'").select("language").distinct()


def version_signals(files: DataFrame, content: str = "content") -> DataFrame:
    """files with version, confidence, method and signals by the heuristic rule tables; null outside Python code."""
    two, three = rules.hits(F.col(content), rules.PY2_SIGNALS), rules.hits(F.col(content), rules.PY3_SIGNALS)
    is_code = (F.col("category") == "code") & (F.col("language") == "Python") if "category" in files.columns else F.lit(True)
    version = F.when((F.size("_two") > 0) & (F.size("_three") > 0), "ambiguous").when(F.size("_two") > 0, "2").when(F.size("_three") > 0, "3").otherwise("unknown")
    out = files.withColumn("_two", two).withColumn("_three", three).withColumn("version", F.when(is_code, version))
    out = out.withColumn("version_confidence", F.when(F.col("version").isin("2", "3"), "medium").when(F.col("version").isNotNull(), "low"))
    out = out.withColumn("method", F.when(F.col("version").isNotNull(), "regex_heuristic_no_parso"))
    return out.withColumn("signals", F.when(F.col("version").isNotNull(), F.concat("_two", "_three"))).drop("_two", "_three")


def grammar_version(files: DataFrame, content: str = "content") -> DataFrame:
    """files with version, confidence, method and signals: the grammars decide where exactly one of them accepts a source, else the rule tables do."""
    two, three = F.col("_clean.two"), F.col("_clean.three")
    out = version_signals(files, content).withColumn("_clean", grammars(content))
    sure, told = F.col("version").isNotNull() & (two != three), F.when(three, "3").otherwise("2")
    rules_method = F.when(F.col("version").isNotNull(), "regex_heuristic_after_inconclusive_parso")
    return out.withColumns({
        "signals": F.when(sure, F.array(F.concat(F.lit("parses cleanly as Python "), told, F.lit(" only")))).otherwise(F.col("signals")),
        "version_confidence": F.when(sure, "high").otherwise(F.col("version_confidence")), "method": F.when(sure, "parso_grammar").otherwise(rules_method),
        "version": F.when(sure, told).otherwise(F.col("version")),
    }).drop("_clean")


def version_vote(content: Column) -> Column:
    """The verdict of the vote between the two vote tables."""
    two, three = rules.votes(content, rules.PY2_VOTES), rules.votes(content, rules.PY3_VOTES)
    return F.when(two > three, "Python 2").when(three > two, "Python 3").otherwise("Ambiguous")


def migration_reasons(content: Column) -> Column:
    return F.array_sort(rules.hits(content, rules.PY2_VOTES))


def version_counts(versioned: DataFrame) -> DataFrame:
    v = F.col("version")
    return versioned.agg(
        F.count_if(v == "2").alias("n_version_2"), F.count_if(v == "3").alias("n_version_3"), F.count_if(v.isin("ambiguous", "unknown")).alias("n_unclear")
    )


@dataclass(frozen=True)
class JobSpec:
    """What a migration job asks for."""

    language: str = "Python"
    from_version: str = "2"
    to_version: str = "3"
    min_confidence: str = "medium"
    include_ambiguous: bool = True


def select_files(versioned: DataFrame, spec: JobSpec = JobSpec()) -> DataFrame:
    """versioned with bucket (targets, needs_review, skipped) and reason (null for targets)."""
    v = F.col("version")
    unclear = v.isin("unknown", "ambiguous")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("version_confidence")), F.lit(0)) - 1
    low = rank < CONFIDENCE.index(spec.min_confidence)
    cases: list[tuple[Column, str, Column]] = [
        (F.col("category") != "code", "skipped", F.lit("not_code")),
        (F.col("language") != spec.language, "skipped", F.lit("wrong_language")),
        (v.isNull(), "skipped", F.lit("no_version_detection_available")),
        (v == spec.to_version, "skipped", F.lit("already_on_target_version")),
        (unclear, "needs_review" if spec.include_ambiguous else "skipped", F.concat(F.lit("version_"), v, F.lit("" if spec.include_ambiguous else "_excluded"))),
        (v != spec.from_version, "skipped", F.concat(F.lit("version_"), v, F.lit("_not_in_job_scope"))),
        (low, "needs_review", F.lit("low_detection_confidence")),
    ]
    bucket, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, where, why in cases[1:]:
        bucket, reason = bucket.when(test, where), reason.when(test, why)
    return versioned.withColumn("bucket", bucket.otherwise("targets")).withColumn("reason", reason)


def bucket_counts(selected: DataFrame) -> DataFrame:
    b = F.col("bucket")
    return selected.agg(*[F.count_if(b == x).alias(f"n_{x}") for x in ("targets", "needs_review", "skipped")])
