"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters, each a weight for every byte value at every place of its width, run over every
byte of the document. Their rectified responses are max-pooled over chunks of 512 bytes that
overlap by half; the maximum and the mean of the chunks' vectors are combined by a logistic unit
into one probability that the label is 1. Training is on the driver, on every chunk of a sample bounded
by `per_class` labelled rows of each class and by `sample_bytes` of text in all (rows in the order
of a hash of their id, those that would pass the bound left out); the bias is then moved from the
balanced sample to the classes' shares among all labelled rows. Scoring reads every byte of
every document.

Defined results: null is an empty text, scored from padding alone; rows whose label is null are
not learnt from; of several labels of one id the largest holds, of several texts the smallest; a
corpus without rows of both classes gives the share of label 1 (0.5 without any label) to every
document; rows that repeat get equal scores; a score of exactly the threshold predicts 1; texts of any
length are read whole; rows of null id are scored and never held out; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

WIDTH = 6
HALF = 256


@dataclass
class Net:
    """filters: WIDTH x 256 x n; bias: n; of_max, of_mean: n; shift: the unit's bias."""

    filters: np.ndarray
    bias: np.ndarray
    of_max: np.ndarray
    of_mean: np.ndarray
    shift: float

    def tables(self) -> list[np.ndarray]:
        """Two neighbouring places' weights as one table over byte pairs."""
        k = self.filters.astype(np.float32)
        return [(k[j][:, None, :] + k[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with WIDTH zero bytes after each, and their offsets there."""
    lengths = np.diff(offsets)
    places = np.arange(len(data)) + WIDTH * np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(data) + WIDTH * len(lengths) + WIDTH, dtype=np.uint8)
    out[places] = data
    return out, offsets + WIDTH * np.arange(len(offsets))


def half_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half chunks of each padded text, and the number of them for each."""
    n = np.maximum(1, -(-(np.diff(offsets) - WIDTH) // HALF))
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(offsets[:-1], n) + HALF * (np.arange(n.sum()) - first), n


def pooled(tables: list[np.ndarray], bias: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 2n: the maximum and the mean over each document's chunks of its max-pooled responses."""
    text, at = padded(data, offsets)
    starts, counts = half_starts(at)
    pairs = text[:-1].astype(np.int32) * 256 + text[1:]
    end = at[-1]
    # windows that begin in a text's padding hold zeros only, not the next text's first bytes
    edge = (at[1:, None] - np.arange(WIDTH - 1, 0, -1)).ravel()
    blank = sum(t[0] for t in tables)
    halves = np.empty((len(starts), len(bias)), dtype=np.float32)
    for a in range(0, len(starts), 512):
        b = min(a + 512, len(starts))
        low, high = starts[a], starts[b] if b < len(starts) else end
        high = min(high, end)
        response = tables[0][pairs[low:high]]
        for j, t in enumerate(tables[1:], 1):
            response += t[pairs[low + 2 * j : high + 2 * j]] if high + 2 * j <= len(pairs) else t[np.r_[pairs[low + 2 * j :], np.zeros(high + 2 * j - len(pairs), np.int32)]]
        response[edge[np.searchsorted(edge, low) : np.searchsorted(edge, high)] - low] = blank
        halves[a:b] = np.maximum.reduceat(response, starts[a:b] - low, axis=0)
    halves = np.maximum(halves + bias.astype(np.float32), 0)
    first = np.cumsum(counts) - counts
    last = first + counts - 1
    chunks = halves.copy()
    chunks[:-1] = np.maximum(halves[:-1], halves[1:])
    chunks[last] = halves[last]
    only = counts == 1  # a text of several halves has a chunk for each neighbouring pair
    weight = np.ones(len(chunks), dtype=np.float32)
    weight[last[~only]] = 0
    chunks *= weight[:, None]
    top = np.maximum.reduceat(chunks, first, axis=0)
    mean = np.add.reduceat(chunks, first, axis=0) / np.add.reduceat(weight, first)[:, None]
    return np.hstack([top, mean])


def train(texts: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 8, seed: int = 7) -> Net:
    """A net fitted by Adam on every byte of the texts; each half chunk's responses serve both chunks that hold it."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    epochs = max(epochs, min(40, 4000 // max(n, 1)))
    span = HALF + WIDTH - 1
    halves = np.array([max(1, -(-len(t) // HALF)) for t in texts])
    first = np.concatenate([[0], np.cumsum(halves)])
    rows = np.zeros((first[-1], span), np.uint8)
    for d, t in enumerate(texts):
        for h in range(halves[d]):
            piece = np.frombuffer(t[h * HALF : h * HALF + span], np.uint8)
            rows[first[d] + h, : len(piece)] = piece
    p = {
        "filters": rng.normal(0, 0.1, (WIDTH, 256, filters)).astype(np.float32), "bias": np.zeros(filters, np.float32),
        "of_max": rng.normal(0, 0.3, filters).astype(np.float32), "of_mean": rng.normal(0, 0.3, filters).astype(np.float32), "shift": np.zeros(1, np.float32),
    }
    m, v, turn = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    every = np.arange(filters)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 16):
            batch = np.sort(order[a : a + 16])
            x = rows[np.concatenate([np.arange(first[d], first[d + 1]) for d in batch])].astype(np.intp)
            count = halves[batch]
            start = np.cumsum(count) - count
            size = np.maximum(count - 1, 1)  # chunks: neighbouring halves, or the only half
            doc = np.repeat(np.arange(len(batch)), size)
            left = start[doc] + np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            right = np.minimum(left + 1, (start + count - 1)[doc])
            best, top_of = np.empty((len(x), filters), np.intp), np.empty((len(x), filters), np.float32)
            for k in range(0, len(x), 64):
                part = x[k : k + 64]
                response = p["filters"][0].take(part[:, :HALF], axis=0)
                for j in range(1, WIDTH):
                    response += p["filters"][j].take(part[:, j : j + HALF], axis=0)
                best[k : k + 64] = response.argmax(axis=1)
                top_of[k : k + 64] = np.take_along_axis(response, best[k : k + 64, None, :], 1)[:, 0]
            won = np.where(top_of[left] >= top_of[right], left[:, None], right[:, None])
            top = top_of[won, every] + p["bias"]
            hidden = np.maximum(top, 0)
            starts = np.cumsum(size) - size
            high = np.maximum.reduceat(hidden, starts, axis=0)
            mean = np.add.reduceat(hidden, starts, axis=0) / size[:, None]
            z = high @ p["of_max"] + mean @ p["of_mean"] + p["shift"][0]
            error = (1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)
            winner = hidden == high[doc]
            share = winner / np.add.reduceat(winner.astype(np.float32), starts, axis=0)[doc]
            back = error[doc][:, None] * (share * p["of_max"] + p["of_mean"] / size[doc][:, None]) * (top > 0)
            g = {"of_max": high.T @ error, "of_mean": mean.T @ error, "shift": np.array([error.sum()]), "bias": back.sum(0), "filters": np.zeros_like(p["filters"])}
            c, f = np.nonzero(back)
            h = won[c, f]
            at = best[h, f]
            for j in range(WIDTH):
                np.add.at(g["filters"][j], (x[h, at + j], f), back[c, f])
            turn += 1
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = (p[k] - 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return Net(p["filters"], p["bias"], p["of_max"], p["of_mean"], float(p["shift"][0]))


def logits(net: Net, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    return pooled(tables or net.tables(), net.bias, data, offsets).astype(np.float64) @ np.concatenate([net.of_max, net.of_mean]).astype(np.float64) + net.shift


def calibrated(texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> Net:
    """A net trained on four fifths of the sample, its logit scaled and shifted on the rest, weighted to the labels' true shares."""
    rest = np.arange(len(texts)) % 5 == 0
    if len(set(labels[rest].tolist())) < 2 or len(set(labels[~rest].tolist())) < 2:
        return train(texts, labels)
    net = train([t for t, r in zip(texts, rest, strict=True) if not r], labels[~rest])
    aside = [t for t, r in zip(texts, rest, strict=True) if r]
    z = np.concatenate([logits(net, np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in aside])
    x, y, w = np.stack([z, np.ones(len(z))]), labels[rest].astype(np.float64), weight[rest]
    ab = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge-penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        gradient = x @ (w * (p - y)) + 0.05 * (ab - [1, 0])
        ab = ab - np.linalg.solve((x * (w * p * (1 - p))) @ x.T + 0.05 * np.eye(2), gradient)
    a, b = max(float(ab[0]), 1e-3), float(ab[1])
    return Net(net.filters, net.bias, net.of_max * a, net.of_mean * a, net.shift * a + b)


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net = held.value
        tables = net.tables()
        for batch in batches:
            for part, data, offsets in common.steps(batch):
                z = logits(net, data, offsets, tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "held_out", "score"])

    return run


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, sample_bytes: int, folds: int = 5) -> Net:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id", folds, 0)).groupBy("id").agg(F.max("y").alias("y"))
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    rows = []
    if len(shares) == 2:
        sample = spark.createDataFrame([(r.id, r.y, k) for c in chosen for k, r in enumerate(c.collect())], "id long, y int, k int")  # at most 2 x per_class
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
        texts = common.written(texts.groupBy("id", "y", "k").agg(F.min("text").alias("text")), "quality-sample")
        kept, size = [], 0
        for r in sorted(texts.select("id", "y", "k", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.k, r.y)):
            if size + r.n <= sample_bytes:
                kept, size = [*kept, (r.id,)], size + r.n
        fits = spark.createDataFrame(kept, "id long")
        rows = sorted((r.id, r.text.encode(), r.y) for r in texts.join(F.broadcast(fits), "id").toLocalIterator())
        common.discard(texts)
    y = np.array([r[2] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        share = sum(n for k, n in shares.items() if k == 1) / sum(shares.values()) if shares else 0.5
        z = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Net(np.zeros((WIDTH, 256, 1)), np.zeros(1), np.zeros(1), np.zeros(1), z)
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    return calibrated([r[1] for r in rows], y, weight / weight.mean())


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 600, sample_bytes: int = 32_000_000, threshold: float = 0.3, folds: int = 5
) -> DataFrame:
    """id, held_out, score and predicted for every document."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, per_class, sample_bytes, folds))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col, folds, 0), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = plain.mapInArrow(_scores(net), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
