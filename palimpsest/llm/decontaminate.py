"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity with the whole of it, so
documents are searched in pieces sized like the items. Items are partitioned by their number
of shingles into size classes (q, upper bound `size`); for each class the document is cut into
blocks of `size` shingles and every pair of adjacent blocks is one searched set, so that a run
of up to `size` shingles lies whole in some set. A set and an item that share the minimum of
any of `hashes` hash functions are candidates (one row a band). Sizes begin at 1 and grow by half,
so a set has at most three times the item's shingles: with 0.8 of an item inside, the Jaccard
similarity is 0.25 at least, and all 96 minima miss with probability under 1e-11. Every candidate
is verified by exact containment of the item's distinct shingles in the whole document. An item of
fewer than five words is one shingle of all its words, sought among the document's runs of as many
words (a set of one shingle is its own minimum). Items are the stated query set: they go to the
executors in blocks of at most `block_items` and `block_bytes`; documents never move.

Words are compared in lower case, so an item in capitals is still found.

Defined results: null or empty texts match nothing, items without a word or of null id match
nothing, repeated rows give repeated results, texts of any length are read whole, an empty table gives
an empty result, columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

SCHEMA = "id long, item_id long, n_shared long, n_item long"


class ItemBlock:
    """A block of items prepared for the search: shingle sets, and minima by size class."""

    def __init__(self, items: list[tuple[int, str]], hashes: int, growth: float = 1.5) -> None:
        # a shingle's hash is well mixed, so an odd factor gives each hash function its own order
        self.seeds = common.mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        data, offsets = common.text_bytes(pc.utf8_lower(pa.array([t for _, t in items], pa.string())))
        starts, ends, rows = common.words(data, offsets)
        value, owner = common.shingles(common.span_hashes(data, starts, ends), rows)
        value, owner, _ = common.weighted_sets(value, owner)
        self.sets = np.split(value, np.searchsorted(owner, np.arange(1, len(items))))[: len(items)]
        self.ids = [i for i, _ in items]
        n_words = np.bincount(rows, minlength=len(items))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, common.SHINGLE):
            members = np.flatnonzero(n_words == k)
            if len(members):
                keys = np.array([self.sets[i][0] for i in members])
                order = np.argsort(keys)
                self.short[k] = (keys[order], members[order])
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if n_words[i] >= common.SHINGLE:
                size = 1
                while size < len(s):
                    size = max(size + 1, int(size * growth))
                self.classes.setdefault(size, []).append(i)
        self.minima = {}
        for size, members in self.classes.items():
            low = np.array([[(self.sets[i] * seed).min() for i in members] for seed in self.seeds])
            order = np.argsort(low, axis=1)
            self.minima[size] = (np.take_along_axis(low, order, 1), np.array(members)[order])

    def short_hits(self, hashes: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) for the items of fewer words than a shingle that are in the row."""
        found: set[tuple[int, int]] = set()
        for k, (keys, members) in self.short.items():
            value, owner = common.shingles(hashes, rows, k)
            left, right = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
            for s in np.flatnonzero(right > left):
                found.update((int(owner[s]), int(m)) for m in members[left[s] : right[s]])
        return found

    def candidates(self, value: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) that share a minimum in some searched set."""
        if not len(value):
            return []
        found = []
        row_start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(value)) - np.repeat(row_start, np.diff(np.r_[row_start, len(value)]))
        cuts, rows = {}, {}
        for size in self.minima:
            cuts[size] = np.flatnonzero(place % size == 0)
            rows[size] = owner[cuts[size]]
        hashed = np.empty_like(value)
        for j, seed in enumerate(self.seeds):
            np.multiply(value, seed, out=hashed)
            for size, (low, who) in self.minima.items():
                blocks = np.minimum.reduceat(hashed, cuts[size])
                next_same = rows[size][1:] == rows[size][:-1]
                pairs = blocks.copy()
                pairs[:-1][next_same] = np.minimum(blocks[:-1], blocks[1:])[next_same]
                known, members = low[j], who[j]
                left = np.searchsorted(known, pairs)
                hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == pairs)
                n = np.searchsorted(known, pairs[hit], side="right") - left[hit]  # items of one minimum stand together
                item = members[np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                found.append(np.repeat(rows[size][hit], n) * len(self.ids) + item)
        if not found:
            return []
        return [divmod(x, len(self.ids)) for x in np.unique(np.concatenate(found)).tolist()]


def _search(block_of, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: ItemBlock = block_of.value
        for batch in batches:
            folded = pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_lower(batch.column(1))], names=["id", "text"])
            for part, data, offsets in common.steps(folded):
                starts, ends, rows = common.words(data, offsets)
                hashes = common.span_hashes(data, starts, ends)
                value, owner = common.shingles(hashes, rows)
                long = np.bincount(rows, minlength=part.num_rows)[owner] >= common.SHINGLE
                value, owner = value[long], owner[long]
                ids = part.column(0)
                out = [(ids[row].as_py(), block.ids[item], 1, 1) for row, item in sorted(block.short_hits(hashes, rows))]
                whole: dict[int, np.ndarray] = {}
                for row, item in block.candidates(value, owner):
                    if row not in whole:
                        a, b = np.searchsorted(owner, [row, row + 1])
                        whole[row] = np.unique(value[a:b])
                    shared = int(np.isin(block.sets[item], whole[row], assume_unique=True).sum())
                    if shared >= threshold * len(block.sets[item]):
                        out.append((ids[row].as_py(), block.ids[item], shared, len(block.sets[item])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["id", "item_id", "n_shared", "n_item"]
                )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", threshold: float = 0.8, hashes: int = 96, block_items: int = 16_384, block_bytes: int = 16_000_000,
) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment) of every item held by a document at the threshold."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").orderBy("i")
    found, block, size = None, [], 0

    def searched(rows):
        held = spark.sparkContext.broadcast(ItemBlock(rows, hashes))
        return texts.mapInArrow(common.lean(_search(held, threshold)), SCHEMA)

    for r in items.toLocalIterator():
        if block and (len(block) == block_items or size + len(r.t) > block_bytes):
            found, block, size = searched(block) if found is None else found.unionByName(searched(block)), [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block or found is None:
        found = searched(block) if found is None else found.unionByName(searched(block))
    return found.select(
        F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


ORACLE = """
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, w[i : i + k - 1] AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN bn USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
