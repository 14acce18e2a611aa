"""Language identification: family first, then one-versus-one linear SVMs within the family.

A text is the mean, over all its places, of hashed byte n-grams (one to four bytes, ASCII letters
folded, everything in ASCII that is no letter a blank), so a score is the mean of the weights at
its places: every byte counts and no prefix is special. Linear support vector machines (squared
hinge) are trained on the driver for every lang value that occurs, on a sample bounded by
`per_language` rows of each and `sample_rows` in all (20 a language at least) and by `sample_bytes`
of text (rows in the order of a hash of their id, those that would pass the bound left out). Pairs of
families vote first; pairs within the chosen family vote next. Languages without an entry in
FAMILIES are families of their own.

Defined results: `und` with score 0 where the text is null or has no letter; rows whose lang is
null or whose text has no letter are not learnt from; where an id repeats the smallest (lang, text)
is learnt; with nothing to learn from all is `und`; with one language all texts with letters get it;
votes that tie go by margins, then to the first name; rows that repeat get equal results; rows of
null id are never held out; texts of any length are read whole; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common
from palimpsest.llm.quality_net import held_out

#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "cy", "gd", "br"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "am", "mt"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 12
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram (n = 1..4) ending at each byte, 4 x bytes, with blanks before each row's start."""
    text = _FOLD[data].astype(np.uint32)
    out = np.empty((4, len(text)), dtype=np.uint16)
    code = np.zeros(len(text), dtype=np.uint32)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(text))
    for k in range(4):
        back = at - k
        byte = np.where(back >= first, text[np.maximum(back, 0)], np.uint32(32))
        code = code * np.uint32(0x01000193) ^ (byte + np.uint32(1)) * np.uint32(0x9E3779B1)
        h = code ^ (code >> np.uint32(15))
        h = h * np.uint32(0x85EBCA6B)
        out[k] = (h >> np.uint32(32 - BITS)).astype(np.uint16)
    return out, first


def mean_scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x classifiers: the mean over each row's places of the weights there; weights is 4 x 2^BITS x classifiers."""
    rows = len(offsets) - 1
    out = np.zeros((rows, weights.shape[2]))
    if len(data):
        where, _ = places(data, offsets)
        length = np.maximum(np.diff(offsets), 1)
        for c in range(weights.shape[2]):
            total = np.zeros(len(data) + 1)
            np.cumsum(sum(weights[k, :, c][where[k]] for k in range(4)), out=total[1:])
            out[:, c] = (total[offsets[1:]] - total[offsets[:-1]]) / length
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """texts x (4 * 2^BITS) mean n-gram vectors."""
    out = np.zeros((len(texts), 4 << BITS), dtype=np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        if len(data):
            where, _ = places(data, np.array([0, len(data)]))
            index = (where.astype(np.int64) + (np.arange(4) << BITS)[:, None]).ravel()
            out[i] = np.bincount(index, minlength=4 << BITS) / len(data)
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; y is +1 or -1, classes weigh the same."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    pw, pb, t = w, b, 1.0
    step = np.float32(1 / (2 * (float(np.einsum("ij,ij->i", x, x).max()) + 1) + penalty))
    for _ in range(rounds):
        pull = np.float32(-2) * share * y * np.maximum(np.float32(0), 1 - y * (x @ pw + pb))
        nw, nb = pw - step * (pull @ x + np.float32(penalty) * pw), np.float32(pb - step * pull.sum())
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = np.float32((t - 1) / u)
        pw, pb = nw + ahead * (nw - w), nb + ahead * (nb - b)
        w, b, t = nw, nb, u
    return w, float(b)


@dataclass
class Model:
    """Pairwise classifiers of families, then of languages; weights has one column for each."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((4, 1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def choose(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The names' index with the most votes in each row (margins break ties), and its mean probability against the others."""
        n = len(names)
        votes, sure = np.zeros((len(margins), n)), np.zeros((len(margins), n))
        for c, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                p = 1 / (1 + np.exp(-np.clip(4 * margins[:, c], -60, 60)))
                i, j = names.index(a), names.index(b)
                votes[:, i] += margins[:, c] >= 0
                votes[:, j] += margins[:, c] < 0
                sure[:, i] += p
                sure[:, j] += 1 - p
        best = (votes + sure / (n + 1)).argmax(axis=1)
        return best, sure[np.arange(len(best)), best] / (n - 1) if n > 1 else np.ones(len(best))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = mean_scores(self.weights, data, offsets) + self.bias
        groups = [f"family:{f}" for f in self.families]
        family, score = self.choose(margins, groups)
        out = np.empty(len(margins), dtype=object)
        for k, langs in enumerate(self.families.values()):
            own = np.flatnonzero(family == k)
            best, sure = self.choose(margins[own], langs)
            out[own] = np.array(langs, dtype=object)[best]
            score[own] = score[own] * sure
        return out.tolist(), score


def fit_texts(texts: list[bytes], langs: list[str]) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    x, lang = features(texts), np.array(langs, dtype=object)
    scale = 1 / max(float(np.sqrt((x * x).sum(axis=1)).mean()), 1e-9)
    x *= scale
    group = np.array([f"family:{family_of(k)}" for k in langs], dtype=object)
    pairs, columns, bias = [], [], []
    for names, of in ([f"family:{f}" for f in families], group), *((v, lang) for v in families.values()):
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            w, c = svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))
            pairs.append((a, b))
            columns.append((w * scale).reshape(4, 1 << BITS))
            bias.append(c)
    weights = np.stack(columns, axis=2).astype(np.float32) if columns else np.zeros((4, 1 << BITS, 0), np.float32)
    return Model(families, pairs, weights, np.array(bias))


def _has_letter(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, text: pa.Array) -> np.ndarray:
    is_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.r_[0, np.cumsum(is_letter)]
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        if offsets[i + 1] > offsets[i]:
            out[i] = any(ch.isalpha() for ch in (text[i].as_py() or ""))
    return out


def _predictions(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            for part, data, offsets in common.steps(batch):
                known = _has_letter(part, data, offsets, part.column(2))
                if model.families:
                    langs, score = model.predict(data, offsets)
                else:
                    langs, score, known = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                langs = [x if k else "und" for x, k in zip(langs, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0))], names=["id", "held_out", "lang_pred", "score"]
                )

    return run


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, sample_rows: int, sample_bytes: int, folds: int, fold: int) -> Model:
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.coalesce(~held_out("id", folds, fold), F.lit(False)))
    names = known.select("lang").distinct().count()
    per_language = min(per_language, max(20, sample_rows // max(names, 1)))
    # Spark keeps no more rows of a language than these before the shuffle (a group limit), so a common language doesn't meet in one task
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = [r.id for r in known.withColumn("place", place).where(F.col("place") <= per_language).select("id").distinct().collect()]
    if not chosen:
        return Model()
    sample = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "id long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(sample, "id").where("text is not null and lang is not null")
    rows = common.written(rows.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("id", "r.lang", "r.text", F.xxhash64("id").alias("place")), "language-sample")
    kept, size = [], 0
    for r in sorted(rows.select("id", "place", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.place, r.id)):
        if size + r.n <= sample_bytes:
            kept, size = [*kept, (r.id,)], size + r.n
    fits = spark.createDataFrame(kept, "id long")
    pairs = sorted((r.id, r.lang, r.text) for r in rows.join(F.broadcast(fits), "id").toLocalIterator())
    common.discard(rows)
    pairs = [(lang, text.encode()) for _, lang, text in pairs if any(ch.isalpha() for ch in text)]
    return fit_texts([t for _, t in pairs], [lang for lang, _ in pairs]) if pairs else Model()


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, sample_rows: int = 6400,
    sample_bytes: int = 64_000_000, folds: int = 3, fold: int = 1
) -> DataFrame:
    """id, held_out, lang_pred and score for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, per_language, sample_rows, sample_bytes, folds, fold))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col, folds, fold), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = plain.mapInArrow(_predictions(model), "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
