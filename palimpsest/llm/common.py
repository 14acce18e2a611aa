"""Shared helpers: table access, shared scratch space and vectorised word hashing.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D),
so splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; a longer single text is its own step.
STEP_BYTES = 2_000_000
#: Words in a shingle for every operator on word shingles.
SHINGLE = 5

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_MULT), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and there is one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return memory that this process has freed, and the power table, to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at a task's end its worker, which waits beside the executor's JVM for more tasks, keeps only what is alive."""

    def and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return and_give_back


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): bijective, every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _MULT), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's start (n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def steps(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about STEP_BYTES of text: (slice, bytes, row offsets)."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row of every word; a word never crosses two rows."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1 : n + 1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte codes, finalised with the length."""
    up, down = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and their rows; a row with fewer words has one shingle of them all."""
    n = len(hashes)
    if not n:
        return hashes, rows
    with np.errstate(over="ignore"):
        value = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
        for k in range(size):
            value = mix(value * _U(0x9FB21C651E98DF25) + hashes[k : k + len(value)] + _U(size))
        whole = rows[: len(value)] == rows[size - 1 :] if len(value) else np.zeros(0, bool)
        value, owner = value[whole], rows[: len(whole)][whole]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts = np.diff(np.r_[first, n])
        short = counts < size
        if short.any():
            extra, extra_rows = [], rows[first[short]]
            for a, c in zip(first[short], counts[short], strict=True):
                x = np.zeros(1, np.uint64)
                for k in range(c):
                    x = mix(x * _U(0x9FB21C651E98DF25) + hashes[a + k : a + k + 1] + _U(int(c)))
                extra.append(x)
            value, owner = np.r_[value, np.concatenate(extra)], np.r_[owner, extra_rows]
            order = np.argsort(owner, kind="stable")
            value, owner = value[order], owner[order]
    return value, owner


def weighted_sets(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in row order with their multiplicities."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, np.int64)
    return value[new], owner[new], np.diff(np.r_[new, len(value)])
