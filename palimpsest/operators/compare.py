"""Differential comparison of recorded results, behavioural statistics, risk and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIFFERENCE = "array<struct<field:string,original:string,migrated:string>>"


def differences(fields: list[str], left: str = "o", right: str = "m") -> Column:
    """The fields of two result structs that differ; null equals only null, NaN equals NaN."""
    one = [
        F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"{left}.{f}").cast("string").alias("original"), F.col(f"{right}.{f}").cast("string").alias("migrated")))
        for f in fields
    ]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def compare(original: DataFrame, migrated: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, differences and equivalent for every case recorded on both sides."""
    o = original.select(*keys, F.struct(*fields).alias("o"))
    m = migrated.select(*keys, F.struct(*fields).alias("m"))
    return o.join(m, keys).select(*keys, differences(fields).alias("differences")).withColumn("equivalent", F.size("differences") == 0)


def same_value(a: Column, b: Column) -> Column:
    """Equality of JSON values: booleans only with booleans, numbers by value, objects whatever their key order."""
    va, vb = F.try_parse_json(a), F.try_parse_json(b)
    kind = lambda v: F.schema_of_variant(v)
    boolean = (kind(va) == "BOOLEAN") | (kind(vb) == "BOOLEAN")
    number = lambda v, k: F.when(~k.isin("STRING", "VOID") & ~k.startswith("ARRAY") & ~k.startswith("OBJECT"), F.try_variant_get(v, "$", "double"))
    na, nb = number(va, kind(va)), number(vb, kind(vb))
    plain = F.to_json(va).eqNullSafe(F.to_json(vb))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(boolean, (kind(va) == kind(vb)) & plain).when(na.isNotNull() & nb.isNotNull(), na.eqNullSafe(nb)).otherwise(plain)


# Category of a difference by the field it is in; return values are looked at more closely.
FIELD_CATEGORIES = {
    "status": "execution_status_change", "exception_type": "exception_type_change", "exception_message": "exception_message_change", "stdout": "stdout_change",
}


def explain_difference(field: Column, original: Column, migrated: Column) -> Column:
    """Category of one difference; return values are JSON texts (a tagged object has __type__ and attributes)."""
    a, b = F.try_parse_json(original), F.try_parse_json(migrated)
    ka, kb = F.schema_of_variant(a), F.schema_of_variant(b)
    tagged = lambda v: F.variant_get(v, "$.__type__", "string").isNotNull() & F.to_json(v).contains('"attributes"')
    number = lambda k: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    nested = lambda k: k.startswith("ARRAY") | k.startswith("OBJECT")
    obj = ka.startswith("OBJECT") & kb.startswith("OBJECT")
    value = (
        F.when(obj & F.when(obj, tagged(a) & tagged(b)), "object_state_change").when(number(ka) & number(kb), "numeric_value_change").when((ka == "STRING") & (kb == "STRING"), "string_value_change")
        .when(nested(ka) | nested(kb), "collection_value_change").otherwise("value_change")
    )
    other = F.create_map(*[F.lit(x) for pair in FIELD_CATEGORIES.items() for x in pair])[field]
    return F.when(field == "return_value", value).otherwise(F.coalesce(other, F.lit("execution_difference")))


def numeric_delta(original: Column, migrated: Column) -> Column:
    return migrated.try_cast("double") - original.try_cast("double")


def canonical_key(*columns: str) -> Column:
    """One string that is equal for rows equal in all columns, null-safe."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def behaviour(results: DataFrame, by: str = "file") -> DataFrame:
    """results(by, equivalent, key): cases, differences, distinct differences and rate for each file."""
    bad = ~F.col("equivalent")
    out = results.groupBy(by).agg(
        F.count("*").alias("n_cases"), F.count_if(bad).alias("n_differences"), F.countDistinct(F.when(bad, F.col("key"))).alias("n_distinct"),
    )
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_differences"), F.col("n_cases")), F.lit(0.0)))


def overall(results: DataFrame, tests_equal: bool = True) -> DataFrame:
    out = results.agg(F.count("*").alias("n_cases"), F.count_if("equivalent").alias("n_equivalent"), F.count_if(~F.col("equivalent")).alias("n_differences"))
    return out.withColumn("status", F.when(F.lit(tests_equal) & (F.col("n_differences") == 0), "PASS").otherwise("FAIL"))


def risk(test_failed: Column, rate: Column, n_differences: Column, anomaly: Column) -> Column:
    return (
        F.when(test_failed, "HIGH").when(rate >= 0.5, "HIGH").when(n_differences > 0, F.when(anomaly < -0.10, "HIGH").otherwise("MEDIUM")).when(anomaly < 0, "MEDIUM").otherwise("LOW")
    )


def risk_reasons(test_failed: Column, rate: Column, n_differences: Column, dependents: Column) -> Column:
    given = F.filter(
        F.array(
            F.when(n_differences > 0, F.lit("Semantic differences detected")), F.when(test_failed, F.lit("Existing tests failed")),
            F.when(dependents > 0, F.lit("File has dependent modules")), F.when(rate >= 0.5, F.lit("High semantic difference rate")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("No major verification issues detected")))


def _path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int):
    low, high = x.min(axis=0), x.max(axis=0)
    open_ = np.flatnonzero(high > low)
    if depth >= most or len(x) <= 1 or not len(open_):
        return depth + _path_constant(len(x))
    f = int(rng.choice(open_))
    at = rng.uniform(low[f], high[f])
    left = x[:, f] < at
    return f, at, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)


def _depths(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, a, b = tree
    out, left = np.empty(len(x)), x[:, f] < at
    out[left], out[~left] = _depths(a, x[left]), _depths(b, x[~left])
    return out


def isolation_scores(rows: DataFrame, features: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """key, anomaly_score (0.5 - 2^(-depth / c): below 0 is unusual) and anomaly_prediction.

    Every tree grows on a hash-ordered sample of at most `sample` rows, so the driver holds
    trees x sample rows of numbers at most; all rows are scored in place. Fewer than two rows score 0.
    """
    spark = rows.sparkSession
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    drawn = rows.select(F.xxhash64(F.lit(seed), key).alias("_h"), *values).orderBy("_h", *features).limit(sample * 8).toPandas()[features].to_numpy()
    rng, forest = np.random.default_rng(seed), []
    size = min(sample, len(drawn))
    for _ in range(trees if len(drawn) > 1 else 0):
        forest.append(_grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, 0, int(np.ceil(np.log2(max(size, 2))))))
    held = spark.sparkContext.broadcast((forest, _path_constant(size)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_, c = held.value
        for b in batches:
            x = b[features].to_numpy()
            s = 0.5 - 2.0 ** (-np.mean([_depths(t, x) for t in trees_], axis=0) / c) if trees_ and len(x) else np.zeros(len(x))
            yield pd.DataFrame({key: b[key], "anomaly_score": s, "anomaly_prediction": np.where(s < 0, -1, 1)})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *values).mapInPandas(score, f"{key} {kind}, anomaly_score double, anomaly_prediction int")


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return rows.agg(*[F.count_if((y == a) & (p == b)).alias(n) for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])


def binary_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    out = confusion(rows, label, predicted)
    out = out.withColumns(
        {"accuracy": zero(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": zero(c("tp"), c("tp") + c("fp")), "recall": zero(c("tp"), c("tp") + c("fn"))}
    )
    return out.withColumn("f1", zero(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts by distinct score: ties count half.

    Counts meet by score; a running total over at most 1026 ranges of equal width and one within each
    range replace a global sort in a single task.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ends = per.agg(F.min("s").cast("double").alias("lo"), F.max("s").cast("double").alias("hi"))
    placed = per.join(F.broadcast(ends)).withColumn("bin", F.coalesce(F.width_bucket(F.col("s").cast("double"), "lo", "hi", F.lit(1024)), F.lit(0))).drop("lo", "hi")
    by_bin = placed.groupBy("bin").agg(F.sum("neg").alias("bin_neg"))
    below = by_bin.withColumn("below", F.coalesce(F.sum("bin_neg").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bin", "below")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = placed.withColumn("inside", inside).join(below, "bin").select("pos", "neg", ((F.col("below") + F.col("inside") + F.col("neg") / 2) * F.col("pos")).alias("w"))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of every class, with macro and weighted averages."""
    both = rows.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is_label"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per = both.groupBy("c").agg(F.sum("hit").alias("tp"), F.sum("is_label").alias("support"), F.sum(1 - F.col("is_label")).alias("n_predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("precision", zero(F.col("tp"), F.col("n_predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", "support")
    m = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in m], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *m, "support")
    weighted = per.agg(*[zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in m], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *m, "support")
    return per.unionByName(macro).unionByName(weighted)
