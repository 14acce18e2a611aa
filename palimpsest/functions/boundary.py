"""Pluggable boundaries with deterministic offline defaults: embedding, migration, equivalence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rules

_REGISTRY: dict[str, dict[str, Callable]] = {"embedder": {}, "migrator": {}, "classifier": {}, "detector": {}, "extractor": {}}


def register(kind: str, name: str, f: Callable) -> None:
    _REGISTRY[kind][name] = f


def registered(kind: str, name: str) -> Callable:
    return _REGISTRY[kind][name]


def hashed_embedding(text: Column, width: int = 64, most: int | None = None) -> Column:
    """A unit vector of hashed words (the first `most` of them, as a model with a token limit would read, or all), by the same mean-pool and scale algebra."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda t: t != "")
    tokens = F.slice(tokens, 1, most) if most else tokens
    zero = F.array_repeat(F.lit(0.0), width)

    def add(v: Column, token: Column) -> Column:
        place = F.pmod(F.xxhash64(token), F.lit(2 * width))
        return F.transform(v, lambda x, k: x + F.when(place == 2 * k, 1.0).when(place == 2 * k + 1, -1.0).otherwise(0.0))

    square = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # arrays of one element stand for names: the sum is made once, then its norm, then the unit vector
    normed = F.transform(F.array(F.aggregate(tokens, zero, add)), lambda v: F.struct(v.alias("v"), square(v).alias("n")))
    return F.transform(normed, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0).cast("float")))[0]


_REWRITES = (
    (re.compile(r"(?m)^([ \t]*)print[ \t]+([^(\n][^\n]*)$"), r"\1print(\2)"), (re.compile(r"\bxrange\s*\("), "range("), (re.compile(r"\braw_input\s*\("), "input("),
    (re.compile(r"\.iter(items|keys|values)\s*\("), r".\1("), (re.compile(r"(\w+)\.has_key\s*\(([^()]*)\)"), r"\2 in \1"), (re.compile(r"\bbasestring\b|\bunicode\b"), "str"),
    (re.compile(r"\blong\s*\("), "int("), (re.compile(r"\burllib2\b"), "urllib.request"), (re.compile(r"\.assertEquals\s*\("), ".assertEqual("), (re.compile(r"\.assertNotEquals\s*\("), ".assertNotEqual("),
    (re.compile(r"(?m)^([ \t]*except[ \t]+[\w.]+)[ \t]*,[ \t]*(\w+)[ \t]*:"), r"\1 as \2:"), (re.compile(r"(?m)^([ \t]*raise[ \t]+[\w.]+)[ \t]*,[ \t]*([^\n]+)$"), r"\1(\2)"), (re.compile(r"<>"), "!="),
)


def rule_rewriter(source: str) -> str:
    for pattern, to in _REWRITES:
        source = pattern.sub(to, source)
    return source


def migrate(units: DataFrame, migrator: str = "rules", source: str = "source") -> DataFrame:
    """units with migrated, success and error; an empty source is a failure, an exception is that unit's failure only."""
    f = registered("migrator", migrator)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b[source]:
                if not text or not text.strip():
                    out.append((None, False, "empty source"))
                    continue
                try:
                    out.append((f(text), True, None))
                except Exception as e:
                    out.append((None, False, f"{type(e).__name__}: {e}"))
            yield b.assign(**{k: [o[i] for o in out] for i, k in enumerate(("migrated", "success", "error"))})

    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes) + ", migrated string, success boolean, error string"
    return units.mapInPandas(run, schema)


def pair_features(pairs: DataFrame) -> DataFrame:
    """Numbers a pair classifier learns from: shared and lost markers, length ratio, patterns done."""
    o, m = F.col("original_code"), F.col("migrated_code")
    return pairs.select(
        "*", F.size(rules.hits(o, rules.PAIR_MARKERS)).cast("double").alias("f_before"), F.size(rules.hits(m, rules.PAIR_MARKERS)).cast("double").alias("f_after"),
        F.size(rules.before_after(o, m)).cast("double").alias("f_done"), (F.least(F.length(o), F.length(m)) / F.greatest(F.length(o), F.length(m), F.lit(1))).alias("f_ratio"),
        (o == m).cast("double").alias("f_same"),
    )


FEATURES = ("f_before", "f_after", "f_done", "f_ratio", "f_same")


def train_pair_classifier(pairs: DataFrame, label: str = "label", validation: DataFrame | None = None, ridge: tuple[float, ...] = (0.0, 0.01, 0.1)):
    """The offline equivalence classifier: logistic regression; the ridge with the best validation accuracy is kept."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    def fit(r: float):
        return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), LogisticRegression(labelCol=label, regParam=r)]).fit(pair_features(pairs))

    if validation is None:
        return fit(ridge[0])
    scored = []
    for r in ridge:
        model = fit(r)
        hit = model.transform(pair_features(validation)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0
        scored.append((hit, -r, model))
    return max(scored, key=lambda x: x[:2])[2]


def classify_pairs(model, pairs: DataFrame) -> DataFrame:
    """pairs with equivalent (0/1) and confidence (four places)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(pair_features(pairs))
    p = vector_to_array(F.col("probability"))
    return out.select(*pairs.columns, F.col("prediction").cast("int").alias("equivalent"), F.round(F.array_max(p), 4).alias("confidence"))


register("migrator", "rules", rule_rewriter)
register("embedder", "hashed", hashed_embedding)


def mean_pool(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The masked mean over the second axis, scaled to unit length."""
    m = mask[..., None].astype(np.float64)
    mean = (vectors * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
