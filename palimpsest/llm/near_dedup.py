"""MinHash near-dedup: BagMinHash signatures, banding, exact multiset verification, classes.

Documents are classed by the connected components of "multiset Jaccard of five-word shingles is
at least 0.8". 128 places in 32 bands of 4 rows find a pair at 0.8 with probability 1 - 5e-8.
Candidates are verified with the exact overlap of the shingle multisets.

No bucket is expanded into its pairs, and yet no pair that shares a bucket is left undecided.
Buckets are first cut into windows of sizes from s to s * 1.25 ^ 2 that overlap by half, since
similar texts lie within a factor of 1.25. The member with the most band mates is a bucket's centre;
every member is compared exactly with the centre (a star), which links most of a group of copies.
Two members X and Y that the star leaves in different classes are settled by their deviations from
the same centre O, the symmetric differences Dx and Dy of the multisets: |X ^ Y| = |Dx| + |Dy| -
2 |Dx & Dy|, so a similarity of 0.8 asks for at least t = (ex + ey) / 2 shared deviations, with
ex = |Dx| - |X| / 9, and for |Dx| - |X| / 4 of them at least. With the least ey of the star in place of
ey, and deviations ordered from rare to common, X and Y must meet in the first |D| - t + 1 of each.
Members of different classes that meet on (centre, deviation) are compared pair by pair where
they are few; where they are many they are a bucket of their own, which gets its own centre in
the next round. The number that counts as few grows fourfold by round, so rounds are few.

Keys that may be hot: a centre's members are dealt to `salts` that keep about PER_KEY of them to a
key; counts per key are made before the shuffle and kept as tables, so that Spark can split the skewed
joins with them.

A text is known by its 64-bit hash throughout (n texts hold two of one hash with probability
n^2 / 2^65); ids are only looked up at the end, so they may be null or stand on several texts.

Defined results: equal texts are one class whatever they hold; null is an empty text; a text of
fewer than five words is one shingle of all its words; texts without a word are linked to equal
texts only; class_id is the smallest doc_id of the class, null where all are null; rows that
repeat a doc_id have the class of their own text each; texts of any length are read whole; an
empty table gives an empty result; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, common

#: Rows that a salted key gets of a hot one, about; salts at most; members of a group compared pair by pair in the first round.
PER_KEY, MOST_SALTS, FEW = 4096, 4096, 512


def multisets(part_data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = common.words(part_data, offsets)
    return common.weighted_sets(*common.shingles(common.span_hashes(part_data, starts, ends), rows))


def _sign(m: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.steps(batch):
                value, owner, weight = multisets(data, offsets)
                signature = bagminhash.signatures(value, owner, weight, part.num_rows, m)
                keys = bagminhash.band_keys(signature, bands).view(np.int64)
                total = np.bincount(owner, weights=weight, minlength=part.num_rows).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.where(total > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(total), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[total > 0].ravel()))],
                    names=["id", "text_key", "n", "bands"],
                )

    return run


def _unit_keys(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Keys of the units low + 1 .. high of each element: a multiset as a set of (element, copy)."""
    n = high - low
    copy = np.repeat(low, n) + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = np.repeat(value, n)
    with np.errstate(over="ignore"):
        return np.where(copy == 1, key, common.mix(key + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _compared(deviations: bool):
    """Exact similarity of each pair (a, b), its sizes and, where asked for, the units in one of both only; a's multiset is kept while it stays the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, va, wa = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part, data, offsets in common.steps(batch, "text_b"):
                value, owner, weight = multisets(data, offsets)
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                a_ids, a_texts = part.column(0).to_pylist(), part.column(2)
                similarity, sizes, units = np.zeros(part.num_rows), np.zeros((2, part.num_rows), np.int64), []
                for i, a in enumerate(a_ids):
                    if a != last:
                        va, _, wa = multisets(*common.text_bytes(a_texts.slice(i, 1)))
                        last = a
                    vb, wb = value[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    both, in_a, in_b = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                    shared = np.minimum(wa[in_a], wb[in_b])
                    sizes[:, i] = wa.sum(), wb.sum()
                    union = sizes[:, i].sum() - shared.sum()
                    similarity[i] = shared.sum() / union if union else 0.0
                    if deviations:
                        keys = []
                        for v, w, where in ((va, wa, in_a), (vb, wb, in_b)):
                            low = np.zeros(len(v), np.int64)
                            low[where] = shared
                            keys.append(_unit_keys(v, low, w))
                        units.append(np.concatenate(keys).view(np.int64))
                columns = [part.column(0), part.column(1), pa.array(similarity), pa.array(sizes[0]), pa.array(sizes[1])]
                names = ["a", "b", "similarity", "n_a", "n_b"]
                if deviations:
                    bounds = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(units) if units else np.zeros(0, np.int64))))
                    names.append("units")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _salts(rows: int) -> int:
    return max(1, min(MOST_SALTS, -(-rows // PER_KEY)))


def compared(pairs: DataFrame, texts: DataFrame, salts: int = 1, deviations: bool = False) -> DataFrame:
    """The pairs (a, b) with their exact similarity, sizes and deviations; a's text goes once to each of its salts, or to each pair."""
    of_a, of_b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    if salts == 1:
        both = pairs.join(of_b, "b").join(of_a, "a")
    else:
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts).cast("long")))
        both = dealt.join(of_b, "b").join(dealt.select("a", "salt").distinct().join(of_a, "a"), ["a", "salt"])
    schema = "a long, b long, similarity double, n_a long, n_b long" + (", units array<long>" if deviations else "")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(common.lean(_compared(deviations)), schema)


def undecided(stars: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(key, kind, x, linked, class_id, n, d, m, members): members of different classes of one star that meet on a deviation and may be similar."""
    q = (1 - threshold) / (1 + threshold)
    linked = F.col("similarity") >= threshold
    star = stars.select(F.col("a").alias("centre"), F.col("b").alias("x"), F.col("n_b").alias("n"), linked.alias("linked"), F.size("units").alias("d"), "units")
    excess = F.col("d") - F.col("n") * q
    lows = star.groupBy("centre").agg(F.min(F.when(~F.col("linked"), excess)).alias("low_apart"), F.min(F.when(F.col("linked"), excess)).alias("low_linked"))
    lows = common.written(lows.where("low_apart IS NOT NULL"), "star-lows")  # a star of linked members is one class
    unit = star.join(lows, "centre", "left_semi").select("centre", "x", F.explode("units").alias("unit"))
    rarity = common.written(unit.groupBy("centre", "unit").agg(F.count("*").alias("df")).where("df > 1"), "rarity")
    ordered = unit.join(rarity, ["centre", "unit"]).groupBy("centre", "x").agg(F.array_sort(F.collect_list(F.struct("df", "unit"))).alias("shared"))
    member = star.drop("units").join(lows, "centre").join(classes.toDF("x", "class_id"), "x", "left").withColumn("class_id", F.coalesce("class_id", "x"))
    at_least = lambda t: F.greatest(F.lit(1), F.ceil(t - 1e-9)).cast("int")
    of_any = F.col("d") - F.col("n") * ((1 - threshold) / threshold)
    known = ordered.join(member, ["centre", "x"]).withColumn("m", F.size("shared"))
    known = known.withColumn("with_apart", at_least(F.greatest(of_any, (excess + F.col("low_apart")) / 2))).withColumn("with_linked", at_least(F.greatest(of_any, (excess + F.col("low_linked")) / 2)))
    known = common.written(known.where("m >= with_apart OR NOT linked AND m >= with_linked"), "deviations")

    def met(rows: DataFrame, t: str, kind: int) -> DataFrame:
        """Who meets whom: of kind 0 members that are apart, of kind 1 these and linked ones."""
        u = F.explode(F.expr(f"slice(shared, 1, greatest(m - {t} + 1, 0))")).alias("u")
        rows = rows.select(u, "centre", "x", "linked", "class_id", "n", "d", "m")
        return rows.select(F.xxhash64("centre", "u.unit", F.lit(kind)).alias("key"), F.lit(kind).alias("kind"), "x", "linked", "class_id", "n", "d", "m")

    apart, linked = known.where(~F.col("linked")), known.where("linked")
    rows = met(apart, "with_apart", 0).union(met(apart.where("low_linked IS NOT NULL"), "with_linked", 1)).union(met(linked, "with_apart", 1))
    groups = rows.groupBy("key").agg(
        F.count("*").alias("members"), F.count(F.when(F.col("linked"), 1)).alias("n_linked"), F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.max("kind").alias("of"),
    )
    groups = common.written(groups.where("low <> high AND (of = 0 OR n_linked > 0 AND n_linked < members)").select("key", "members"), "met-groups")
    out = common.written(rows.join(groups, "key"), "met")
    for table in (lows, rarity, known, groups):
        common.discard(table)
    return out


def fitting(met: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that meet, where sizes and deviations allow the threshold."""
    q = (1 - threshold) / (1 + threshold)
    x, y = (met.select("key", "kind", *[F.col(c).alias(f"{c}_{side}") for c in ("x", "linked", "class_id", "n", "d", "m")]) for side in "ab")
    fits = (F.col("class_id_a") != F.col("class_id_b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    fits &= (F.col("d_a") + F.col("d_b") - (F.col("n_a") + F.col("n_b")) * q) / 2 <= F.least("m_a", "m_b") + F.lit(1e-9)
    fits &= F.when(F.col("kind") == 0, F.col("x_a") < F.col("x_b")).otherwise(F.col("linked_a") & ~F.col("linked_b"))
    return x.join(y, ["key", "kind"]).where(fits).select(F.least("x_a", "x_b").alias("a"), F.greatest("x_a", "x_b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "classes") -> DataFrame:
    """(id, class_id): the smallest id connected to each id of edges (a, b), by label spreading and pointer jumping."""
    sides = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b")
    links = common.written(sides.distinct(), f"{name}-links")
    labels = common.written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("class_id")), f"{name}-labels")
    while True:
        of_neighbours = links.join(labels, links.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        spread = labels.join(of_neighbours, "id").select("id", "class_id", F.least("class_id", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("class_id").alias("beyond"))
        moved = common.written(
            spread.join(jump, "next", "left").select("id", F.least("next", F.coalesce("beyond", "next")).alias("class_id"), F.col("class_id").alias("was")),
            f"{name}-labels",
        )
        still = moved.where("class_id <> was").limit(1).count()
        common.discard(labels)
        labels = moved.select("id", "class_id")
        if not still:
            common.discard(links)
            return labels


def linked_classes(buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(id, class_id) of the texts (id, text) that are linked to others, by rounds of stars over the buckets (key, rep, members), which are discarded."""
    linked = F.col("similarity") >= threshold
    labels, few = None, FEW
    while True:
        mates = common.written(buckets.groupBy("rep").agg(F.sum("members").alias("mates")), "mates")
        ranked = buckets.join(mates, "rep")
        centres = ranked.groupBy("key").agg(F.min(F.struct((-F.col("mates")).alias("mates"), "rep")).alias("c")).select("key", F.col("c.rep").alias("a"))
        centres = common.written(centres, "centres")
        pairs = common.written(buckets.join(centres, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
        salts = _salts(pairs.count())
        stars = common.written(compared(pairs, texts, salts, deviations=True), "stars")
        labels = merged(labels, stars.where(linked).select("a", "b"))
        met = undecided(stars, labels, threshold)
        more = common.written(compared(fitting(met.where(F.col("members") <= few), threshold), texts).where(linked).select("a", "b"), "links")
        labels = merged(labels, more)
        for table in (buckets, mates, centres, pairs, stars, more):
            common.discard(table)
        buckets = met.where(F.col("members") > few)
        if not buckets.limit(1).count():
            common.discard(met)
            return labels
        buckets = common.written(buckets.select("key", F.col("x").alias("rep"), "members"), "buckets")
        common.discard(met)
        few *= 4


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes (id, class_id) after more links (a, b) between ids; the old table is discarded."""
    if labels is None:
        return components(links)
    if not links.limit(1).count():
        return labels
    of = lambda side, name: labels.toDF(side, name)
    between = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    between = common.written(between, "between")
    final = components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("class_id", "final")
    ends = between.select(F.explode(F.array("a", "b")).alias("id"), F.lit(None).cast("long").alias("class_id")).distinct()
    every = labels.union(ends.select("id", F.col("id").alias("class_id")).join(labels.select("id"), "id", "left_anti"))
    out = common.written(every.join(final, "class_id", "left").select("id", F.coalesce("final", "class_id").alias("class_id")), "classes")
    for table in (labels, between, final):
        common.discard(table)
    return out


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, band_rows: int) -> DataFrame:
    """(id, text_key, label, class_id) of each row; a class has one label, and rows of one text_key (xxhash64 of the text) one class."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    signed = common.written(plain.mapInArrow(common.lean(_sign(bands * band_rows, bands)), "id long, text_key long, n long, bands array<long>"), "signed")
    distinct = common.written(signed.groupBy("text_key").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.first("n").alias("n")), "distinct")

    rows = distinct.select(F.explode("bands").alias("key"), F.col("text_key").alias("rep"), "n")
    shared = common.written(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "shared-keys")  # a table, so that a skewed join with it can be split
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)  # a window holds two steps
    windows = rows.join(shared, "key").select(F.explode(F.array(step, step - 1)).alias("window"), "key", "rep").select(F.xxhash64("key", "window").alias("key"), "rep")
    several = common.written(windows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared-windows")
    buckets = common.written(windows.join(several, "key"), "buckets")
    # one row holds each text: the join asks for its first id too, so a text of many copies sends one
    wanted = buckets.select("rep").distinct().join(distinct.select(F.col("text_key").alias("rep"), "first_id"), "rep")
    held = plain.join(wanted, (plain.text_key == wanted.rep) & plain.id.eqNullSafe(wanted.first_id)).select(F.col("rep").alias("id"), "text")
    held = common.written(held.dropDuplicates(["id"]), "bucket-texts")
    labels = linked_classes(buckets, held, threshold)
    own = distinct.select("text_key", "first_id").join(labels.toDF("text_key", "label"), "text_key", "left").select("text_key", "first_id", F.coalesce("label", "text_key").alias("label"))
    own = common.written(own, "own-classes")
    for table in (distinct, shared, several, held, labels):
        common.discard(table)
    # a class of one text has its own first id; only classes of several texts are looked up by label
    several = own.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("label", "class_id", F.lit(True).alias("several"))
    named = own.join(several, "label", "left").select("text_key", "label", F.when(F.col("several"), F.col("class_id")).otherwise(F.col("first_id")).alias("class_id"))
    return signed.select("id", "text_key").join(named, "text_key").select("id", "text_key", "label", "class_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32, band_rows: int = 4
) -> DataFrame:
    """One row per document row: its id and class_id."""
    return classes(docs, id_col, text_col, threshold, bands, band_rows).select(F.col("id").alias(id_col), "class_id")


def first_of_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32, band_rows: int = 4
) -> DataFrame:
    """One document of each class, in its own columns: the one of the smallest id, null last, then of the smallest text_key."""
    rows = classes(docs, id_col, text_col, threshold, bands, band_rows)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("f")).select(F.col("f.id").alias("first_id"), F.col("f.text_key").alias("first_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    held = keyed.join(first, (keyed.text_key == first.first_key) & keyed.id.eqNullSafe(first.first_id), "left_semi")
    return held.dropDuplicates(["id", "text_key"]).select("doc.*")
