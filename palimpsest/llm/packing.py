"""Best-fit packing: documents' token ids into sequences by bin-completion branch and bound.

Tokenizing: a token never spans white space, and never an ASCII letter, digit or punctuation
boundary (the apostrophe aside), so a text's ids are the ids of such atoms in order. Each distinct
atom of a slice is encoded once and kept by its hash, and the ids are gathered with numpy. Texts
that spell a special token are encoded whole.

Packing: pieces are dealt by hash into groups of about `group_pieces`, so tasks stay of one size
whatever the corpus. Within a group, best-fit decreasing gives the first incumbent; then bins are
completed around the largest piece left: undominated fillings of its residual space are tried in
order of waste, a branch is cut when its waste exceeds what one sequence less than the incumbent
allows. The search is of limited discrepancy: it keeps the best 4 of 48 fillings visited for each
sequence, and where it runs out of these above the lower bound it begins again with four times as
many, until it ends at the bound, has left none out, or has spent `nodes` nodes in all. A group costs
at most one partly filled sequence more than one global packing.

Defined results: null is an empty text; an empty text is the single id 0; rows that repeat are
packed once each, dealt to groups like other rows; pieces of one length are taken in the order of
id, piece and row; texts of any length are read whole; an empty table gives an empty result; columns
other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Atoms kept by a worker; beyond it the store starts anew (results don't depend on it).
KEPT_ATOMS = 700_000
#: Atoms that the tokenizer encodes in one call; its encodings take far more memory than their ids.
ENCODED_AT_ONCE = 16_384
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Atoms:
    """Encodes slices of texts through a store of atoms' ids."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # the atoms' hashes in order, and where each stands in starts
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), 0

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash's atom stands in starts, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1).astype(np.int64)

    def _store(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in ids])
        n, size = len(self.keys), int(ends[-1])
        while self.used + size > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + len(ends) + 1 > len(self.starts):
            self.starts = np.r_[self.starts, np.zeros_like(self.starts)]
        self.flat[self.used : self.used + size] = np.fromiter(chain.from_iterable(ids), np.uint32, size)
        self.starts[n + 1 : n + len(ends) + 1] = self.used + ends
        self.used += size
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.places = np.insert(self.keys, at, hashes[order]), np.insert(self.places, at, n + order)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows end to end, each row closed by id 0, and the rows' offsets."""
        rows = len(offsets) - 1
        folded = _FOLD[data]
        starts, ends, _ = common.words(data, offsets)
        kind = _CLASS[folded]
        change = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            change[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            is_start, is_end = change.copy(), change.copy()
            is_start[starts] = True
            is_end[ends] = True
            starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end)
        hashes = common.span_hashes(folded, starts, ends)
        inverse, distinct = pd.factorize(hashes)
        first = np.zeros(len(distinct), np.int64)
        first[inverse[::-1]] = np.arange(len(hashes))[::-1]
        if len(self.keys) > KEPT_ATOMS:
            self.clear()
        place = self.place(distinct)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            raw, new = folded.tobytes(), len(self.keys)
            for k in range(0, len(missing), ENCODED_AT_ONCE):
                some = missing[k : k + ENCODED_AT_ONCE]
                begin, end = starts[first[some]].tolist(), ends[first[some]].tolist()
                self._store(distinct[some], [raw[a:b].decode("utf-8") for a, b in zip(begin, end, strict=True)])
            place[missing] = np.arange(new, new + len(missing))
        begin = self.starts[place][inverse]
        length = self.starts[place + 1][inverse] - begin
        total = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)]
        ids = np.insert(ids, bounds[1:], 0)
        return ids, bounds + np.arange(rows + 1)


@lru_cache(maxsize=2)
def _atoms(path: str) -> Atoms:
    return Atoms(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, row_of_task, task = _atoms(path), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, offsets in common.steps(batch):
                ids, bounds = store.encode(data, offsets)
                doc_ids = part.column(0).to_pylist()
                raw = data.tobytes()
                special = any(s.encode() in raw for s in SPECIAL)
                out: list[tuple] = []
                for row, doc in enumerate(doc_ids):
                    own = ids[bounds[row] : bounds[row + 1]]
                    if special and any(s.encode() in raw[offsets[row] : offsets[row + 1]] for s in SPECIAL):
                        text = raw[offsets[row] : offsets[row + 1]].decode("utf-8")
                        own = np.array([*store.tokenizer.encode(text, add_special_tokens=False).ids, 0], np.uint32)
                    own = np.ascontiguousarray(own, dtype="<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        out.append((doc, k, start, len(piece), zlib.crc32(piece), task + row_of_task))
                    row_of_task += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], kinds[k]) for k in range(6)], names=["id", "piece", "start", "length", "ids_crc32", "row"]
                )

    return run


class _Sizes:
    """How many pieces of each length are left, with the lengths that occur as bits of one integer."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.count, self.mask = [0] * (capacity + 1), 0
        for x in lengths:
            self.count[x] += 1
            self.mask |= 1 << x

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.mask ^= 1 << x

    def put(self, x: int) -> None:
        if not self.count[x]:
            self.mask ^= 1 << x
        self.count[x] += 1

    def floor(self, x: int) -> int:
        """The largest length left of at most x, or 0."""
        return (self.mask & ((2 << x) - 1)).bit_length() - 1 if x > 0 else 0


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest sequence that still holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for x in sorted(lengths, reverse=True):
        above = rooms >> x
        if above:
            room = x + ((above & -above).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(x)
        else:
            b, room = len(bins), capacity
            bins.append([x])
        room -= x
        if not by_room.get(room):
            by_room[room] = []
            rooms |= 1 << room
        by_room[room].append(b)
    return bins


def fillings(sizes: _Sizes, room: int, most: int, tries: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of a residual space, least waste first, at most `most` of up to `tries` visited; and whether any may be left out."""
    found: list[tuple[int, tuple[int, ...]]] = []
    left = [tries]

    def dominated(chosen: tuple[int, ...], slack: int) -> bool:
        """Some one or two chosen lengths could give way to a larger single length that is left."""
        for i, x in enumerate(chosen):
            if sizes.floor(x + slack) > x:
                return True
            for y in chosen[i + 1 :]:
                if sizes.floor(x + y + slack) >= x + y:
                    return True
        return False

    def extend(chosen: tuple[int, ...], room: int, limit: int) -> bool:
        x = sizes.floor(min(room, limit))
        if x <= 0:
            if not dominated(chosen, room):
                found.append((room, chosen))
            return room == 0
        while x > 0 and left[0] > 0:
            left[0] -= 1
            sizes.take(x)
            full = extend((*chosen, x), room - x, x)
            sizes.put(x)
            if full:
                return True
            x = sizes.floor(x - 1)
        return False

    extend((), room, room)
    if not found:
        greedy, limit = [], room
        while (x := sizes.floor(limit)) > 0:
            sizes.take(x)
            greedy.append(x)
            limit -= x
        for x in greedy:
            sizes.put(x)
        return [tuple(greedy)], left[0] <= 0
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in found[:most]], left[0] <= 0 or len(found) > most


def bin_completion(lengths: list[int], capacity: int, nodes: int = 6000, most: int = 4, tries: int = 48) -> list[list[int]]:
    """As few bins as the search finds; never more than best-fit decreasing."""
    incumbent = best_fit(lengths, capacity)
    bound = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
    left_out = True
    while left_out and nodes > 0 and len(incumbent) > bound:
        incumbent, nodes, left_out = _search(lengths, capacity, incumbent, bound, nodes, most, tries)
        most, tries = 4 * most, 4 * tries
    return incumbent


def _search(lengths: list[int], capacity: int, incumbent: list[list[int]], bound: int, nodes: int, most: int, tries: int) -> tuple[list[list[int]], int, bool]:
    """The best bins found, the nodes left, and whether some filling was left out."""
    total, left_out = sum(lengths), False
    sizes = _Sizes(lengths, capacity)
    stack: list[tuple[int, list[tuple[int, ...]], int]] = []  # largest, fillings not yet tried, waste before it
    bins: list[list[int]] = []
    waste, left = 0, len(lengths)
    while nodes > 0:
        nodes -= 1
        allowed = (len(incumbent) - 1) * capacity - total
        if not left:
            if len(bins) < len(incumbent):
                incumbent = [list(b) for b in bins]
                if len(incumbent) <= bound:
                    break
        elif waste <= allowed:
            largest = sizes.mask.bit_length() - 1
            sizes.take(largest)
            options, cut = fillings(sizes, capacity - largest, most, tries)
            left_out |= cut
            sizes.put(largest)
            stack.append((largest, options[::-1], waste))
            bins.append([])
        while stack and not stack[-1][1]:  # every filling here was tried
            stack.pop()
            left += _undo(sizes, bins.pop())
        if not stack:
            break
        if bins[-1]:
            left += _undo(sizes, bins[-1])
        largest, options, waste = stack[-1]
        bins[-1] = [largest, *options.pop()]
        for x in bins[-1]:
            sizes.take(x)
        left -= len(bins[-1])
        waste += capacity - sum(bins[-1])
    return incumbent, nodes, left_out


def _undo(sizes: _Sizes, taken: list[int]) -> int:
    for x in taken:
        sizes.put(x)
    return len(taken)


def _pack_group(capacity: int, nodes: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        negative = [-x for x in lengths]
        next_of = {x: bisect_left(negative, -x) for x in set(lengths)}
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, members in enumerate(bin_completion(lengths, capacity, nodes)):
            place = 0
            for x in members:
                i = next_of[x]
                next_of[x] = i + 1
                sequence[i], offset[i] = (int(key[0]) << 32) + b, place
                place += x
        return rows.drop(columns=["bucket", "row"]).assign(sequence_id=sequence, offset=offset)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, group_pieces: int = 4096, nodes: int = 6000
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = plain.mapInArrow(common.lean(_pieces(tokenizer or default_tokenizer(), capacity)), "id long, piece int, start long, length long, ids_crc32 long, row long")
    cut = common.written(cut, "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(_pack_group(capacity, nodes), schema).withColumnRenamed("id", id_col)
