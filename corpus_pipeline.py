"""Corpus pipeline: documents through quality rules, near-dedup, decontamination, masking and packing.

Each stage reads what its predecessor wrote. The first four return the columns of documents, the
last one the packed pieces.

Defined results, for every stage: rows are known by their text, not by doc_id, so a null or repeated
doc_id loses no row and no decision; a null text counts as empty; rows that repeat are treated
alike; null lang, source and n_chars pass as they are; texts of any length are read whole; further
columns, whatever their names, are dropped; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, decontaminate, near_dedup, packing, pii, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TEXT_KEY = "xxhash64(coalesce(text, ''))"


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (null and empty texts among them); the others lose their frequent lines, and n_chars follows."""
    return quality_rules.cleaned(docs.select(COLUMNS))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id, null last, then of the smallest text hash; of equal rows one."""
    return near_dedup.first_of_classes(docs.select(COLUMNS))


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their doc_id; null and empty texts hold none."""
    keyed = docs.select(COLUMNS).withColumn("text_key", F.expr(TEXT_KEY))
    held = decontaminate.contaminated(keyed, common.table(spark, sf_dir, "benchmark"), id_col="text_key").select("text_key").distinct()
    return keyed.join(held, "text_key", "left_anti").select(COLUMNS)


def _mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, overlapping spans by the first one's; n_chars follows a changed text."""
    found = pii.find_pii(docs.select("doc_id", "text")).where("size(spans) > 0").groupBy("text_key").agg(F.first("spans").alias("spans"))  # a text has its spans wherever it stands
    keyed = docs.select(COLUMNS).withColumn("text_key", F.expr(TEXT_KEY))
    masked = keyed.join(found, "text_key", "left").withColumn("masked", F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.mask("text", "spans")))
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("masked").cast("long"))
    return masked.select("doc_id", F.col("masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 2048 tokens; an empty text is one token."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", _quality), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("pii", _mask_pii), ("packing", _pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
