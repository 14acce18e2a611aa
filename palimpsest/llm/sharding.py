"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring `vnodes` times; a key belongs to the next virtual node clockwise.
A shard takes keys up to its bound - the mean, rounded so that the bounds add up to the number of
rows - and keys beyond it continue clockwise to the next virtual node whose shard has room. So
row counts differ by at most one (law `rows`) and only the overflow leaves its home shard.

The key is the doc_id, so equal texts under different ids scatter. Equal rows (same id, size and
text_crc32) are counted before anything is shuffled, however many they are; the arcs (shards x vnodes
of them, whatever the input) are settled on the driver into rank ranges, and each distinct row finds
its own ranges by the running count within its arc, in the order of position, id, text_crc32, size.

Defined results: null text has no bytes; null ids hash like any other value; rows that repeat an
id share an arc and get different slots; texts of any length are read whole; an empty table gives an
empty result; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

_U = np.uint64


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in order, and their shards."""
    with np.errstate(over="ignore"):
        at = common.mix(np.arange(shards * vnodes, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
    order = np.argsort(at)
    return at[order], (np.arange(shards * vnodes) // vnodes)[order]


def settle(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges (arc, from, to, shard, first slot, home) for the rows of each arc."""
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    plan, over = [], []

    def take(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            plan.append((arc, start, start + n, shard, used[shard], int(owner[arc])))
            used[shard] += n
        return max(n, 0)

    for arc, n in enumerate(counts.tolist()):
        if n and (done := take(arc, 0, n, int(owner[arc]))) < n:
            over.append((arc, done, n))
    for arc, start, n in over:
        step = arc
        while start < n:
            step = (step + 1) % len(counts)
            start += take(arc, start, n - start, int(owner[step]))
    return plan


def _arcs(positions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = common.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            arc = np.searchsorted(positions, key) % len(positions)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(key.view(np.int64)), pa.array(arc.astype(np.int32))], names=[*batch.schema.names[1:], "position", "arc"]
            )

    return run


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 256, chunk: int = 100_000) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under this law), home_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    distinct = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies")).select(F.xxhash64("id").alias("key"), "*")
    positions, owner = ring(shards, vnodes)
    keyed = common.written(distinct.mapInArrow(_arcs(positions), "id long, size long, text_crc32 long, copies long, position long, arc int"), "arcs")
    counts = np.zeros(len(owner), dtype=np.int64)
    for r in keyed.groupBy("arc").agg(F.sum("copies").alias("n")).collect():  # at most shards x vnodes rows
        counts[r.arc] = r.n
    plan = spark.createDataFrame(settle(counts, owner, shards), "arc int, lo long, hi long, shard int, first_slot long, home_shard int")
    in_arc = Window.partitionBy("arc").orderBy("position", "id", "text_crc32", "size")
    ranked = keyed.withColumn("end", F.sum("copies").over(in_arc)).withColumn("begin", F.col("end") - F.col("copies"))
    placed = ranked.join(F.broadcast(plan), "arc").where("begin < hi AND end > lo")
    first = F.greatest("begin", "lo")
    placed = placed.select("id", "size", "text_crc32", "shard", "home_shard", (F.col("first_slot") + first - F.col("lo")).alias("first"), (F.least("end", "hi") - first).alias("n"))
    # copies are dealt in chunks; where a row has several they are spread over tasks before they are written out
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))
    parts = placed.where(F.col("n") > chunk).withColumn("part", part).repartition("id", "part").unionByName(placed.where(F.col("n") <= chunk).withColumn("part", F.lit(0).cast("long")))
    start, stop = F.col("part") * chunk, F.least((F.col("part") + 1) * chunk, F.col("n")) - 1
    return parts.withColumn("k", F.explode(F.sequence(start, stop))).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
