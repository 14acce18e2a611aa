"""Quality rules: per-text counts plus cross-document line frequency.

A line (split at "\\n") is normalised - ASCII letters folded, digits zeroed, white space
collapsed - and hashed. For each host the number of *distinct texts* that hold a line is
counted, so exact copies of one document never make its lines look like boilerplate (with
`count="documents"` every row counts by itself). Lines held by at least `min_docs` texts and
`max_share` of the host's texts are removed; a document left with fewer than `min_words` words,
or with less than `keep_share` of its words, is depleted and rejected. quality_rules() tells what
it found of each document, cleaned() yields the documents that stay without those lines.

Defined results: null text is an empty text; empty texts have no words and fail the base rule;
null hosts form one host of their own; rows of null id are rows like any other, known by their
text; repeated rows give repeated results; texts of any length are read whole; columns other than
the named three, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

FEATURES = (
    "id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line_keys array<long>, line_words array<int>"
)
ROW = ["id", "host", "text_key"]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Frequent lines up to this many rows are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_LINES = 200_000


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its (row, key) occurs again, and whether it isn't the first such."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def text_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, end, key and word count of every line with words; lines are cut at every "\\n" and at every row's end."""
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    last = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    of = np.searchsorted(starts, first), np.searchsorted(starts, last)
    with_words = of[1] > of[0]
    first, last, a, b = first[with_words], last[with_words], of[0][with_words], of[1][with_words]
    row = rows[a] if len(a) else np.zeros(0, np.int64)
    folded = common.span_hashes(_FOLD[data], starts, ends)
    up, down = common._power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(folded * up[: len(folded)], dtype=np.uint64)]
        keys = common.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return row, first, last, keys.view(np.int64), (b - a).astype(np.int32)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice, and its lines' keys and word counts."""
    n = len(offsets) - 1
    starts, ends, rows = common.words(data, offsets)
    hashes = common.span_hashes(data, starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n)}
    out["word_chars"] = _per_row(((data & 0xC0) != 0x80) & ~common._SPACE[data], offsets)
    out["n_symbols"] = _per_row(_SYMBOLS[data], offsets)

    covered = np.zeros(len(rows), dtype=bool)
    if len(rows) > 2:
        whole = np.flatnonzero(rows[:-2] == rows[2:])
        key = common.mix(common.mix(hashes[whole]) + hashes[whole + 1])
        again = whole[_repeats(common.mix(key + hashes[whole + 2]), rows[whole])[0]]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)

    if n:
        row, first, last, keys, n_words = text_lines(data, offsets, starts, ends, rows)
        later = _repeats(common.span_hashes(data, first, last), row)[1]
        out["n_dup_lines"] = np.bincount(row[later], minlength=n)
        out |= {"line_row": row, "line_key": keys, "line_words": n_words}
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.steps(batch):
            c = text_counts(data, offsets)
            bounds = np.searchsorted(c["line_row"], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3)]
                + [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [lists(c["line_key"], pa.int64()), lists(c["line_words"], pa.int32())],
                names=["id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_keys", "line_words"],
            )


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of one document (id, host, text_key) together; a null id equals a null id."""
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in ROW else F.col(c) for c in right.columns])
    return left.join(r, left.id.eqNullSafe(r.r_id) & (left.host == r.r_host) & (left.text_key == r.r_text_key), how).drop(*[f"r_{c}" for c in ROW])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _host(host_col).alias("host"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key")).mapInArrow(common.lean(_features), FEATURES)


def frequent_lines(feats: DataFrame, min_docs: int, max_share: float, count: str = "texts") -> DataFrame:
    """(host, line, n_docs) of the lines above the limits, counted over distinct texts, or over all documents."""
    if count not in ("texts", "documents"):
        raise ValueError(f"count must be texts or documents, not {count}")
    lines = feats.select("host", "text_key", F.explode(F.array_distinct("line_keys")).alias("line"))
    many = F.countDistinct("text_key") if count == "texts" else F.count("*")
    counted = lines.groupBy("host", "line").agg(many.alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = feats.groupBy("host").agg(many.alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") >= F.col("host_docs") * F.lit(max_share)).select("host", "line", "n_docs")


def verdicts(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat: int, min_docs: int, max_share: float, keep_share: float, count: str
) -> DataFrame:
    """One row per document: id, host, text_key, its counts, words removed with frequent lines and those lines' keys, base_failed and kept."""
    feats = common.written(features(docs, id_col, text_col, host_col), "quality-features")
    frequent = common.written(frequent_lines(feats, min_docs, max_share, count), "quality-lines")
    small = frequent.count() <= BROADCAST_LINES
    lines = feats.select(*ROW, F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select(
        *ROW, F.col("l.line_keys").alias("line"), F.col("l.line_words").alias("words")
    )
    if small:
        hits = lines.join(F.broadcast(frequent), ["host", "line"])
    else:  # a hot line's rows are spread over salts, and the frequent lines repeated for each
        salts = 32
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(
            frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["host", "line", "salt"]
        )
    copies = feats.groupBy(*ROW).agg(F.count("*").alias("copies"))
    removed = hits.groupBy(*ROW).agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    removed = _joined(removed, copies, "inner").select(*ROW, (F.col("removed_words") / F.col("copies")).cast("long").alias("removed_words"), "removed_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        _joined(feats.drop("line_keys", "line_words"), removed, "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= min_words) & (left >= F.lit(keep_share) * F.col("n_words")))
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat: int = 50, min_docs: int = 5, max_share: float = 0.01, keep_share: float = 0.5, count: str = "texts",
) -> DataFrame:
    """One row per document: its counts, words removed with frequent lines, base_failed and kept."""
    return verdicts(docs, id_col, text_col, host_col, min_words, max_repeat, min_docs, max_share, keep_share, count).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the lines whose keys are beside it, and its length; texts and lengths of rows without such keys as they came."""
    for batch in batches:
        at_text, at_chars, at_gone = (batch.schema.get_field_index(x) for x in ("text", "n_chars", "removed_lines"))
        for part, data, offsets in common.steps(batch):
            gone = part.column(at_gone).to_pylist()
            cut = np.flatnonzero([bool(g) for g in gone])
            columns = part.columns
            if len(cut):
                texts, n_chars = part.column(at_text).to_pylist(), part.column(at_chars).to_pylist()
                row, first, last, keys, _ = text_lines(data, offsets, *common.words(data, offsets))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                raw = data.tobytes()
                for i in cut:
                    own = slice(bounds[i], bounds[i + 1])
                    hit = np.isin(keys[own], gone[i])
                    out, at, end = [], int(offsets[i]), int(offsets[i + 1])
                    for a, b in zip(first[own][hit], last[own][hit], strict=True):
                        out.append(raw[at:a])
                        at = min(int(b) + 1, end)  # the line's "\n" goes with it
                    out.append(raw[at:end])
                    text = b"".join(out)
                    if at == end and last[own][-1] == end and text.endswith(b"\n"):
                        text = text[:-1]  # the last line went: the break before it is no line's any more
                    texts[i] = text.decode()
                    n_chars[i] = len(texts[i])
                columns[at_text], columns[at_chars] = pa.array(texts, part.schema.field(at_text).type), pa.array(n_chars, part.schema.field(at_chars).type)
            yield pa.RecordBatch.from_arrays(columns[:at_gone], names=part.schema.names[:at_gone])


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars",
    min_words: int = 50, max_repeat: int = 50, min_docs: int = 5, max_share: float = 0.01, keep_share: float = 0.5, count: str = "texts",
) -> DataFrame:
    """The documents that stay, in their own columns: their texts without the frequent lines, the length of a changed text following it."""
    rated = verdicts(docs, id_col, text_col, host_col, min_words, max_repeat, min_docs, max_share, keep_share, count)
    told = rated.where(~F.col("kept") | F.col("removed_lines").isNotNull()).select(*ROW, "kept", "removed_lines").dropDuplicates(ROW)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), _host(host_col).alias("host"), _text_key(text_col).alias("text_key"))
    rows = _joined(rows, told, "left").where("kept IS NULL OR kept")
    inner = [F.col("doc")[c].alias({text_col: "text", chars_col: "n_chars"}.get(c, c)) for c in docs.columns]
    out = rows.select(*inner, "removed_lines")
    return out.mapInArrow(common.lean(_without_lines), out.drop("removed_lines").schema).toDF(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
lw AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\\x20\\x09-\\x0D]+') AS lws FROM l),
lines AS (SELECT * FROM lw WHERE len(lws) > 0),
dup AS (SELECT doc_id, sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS n_dup FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS rn FROM lines) GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY 1),
freq AS (SELECT host, line, n_docs FROM (SELECT host, array_to_string(lws, ' ') AS line, count(DISTINCT text) AS n_docs FROM lines GROUP BY 1, 2) JOIN hosts USING (host) WHERE n_docs >= 5 AND n_docs >= host_docs * 0.01),
gone AS (SELECT doc_id, sum(len(lws)) AS removed FROM lines JOIN freq ON lines.host = freq.host AND array_to_string(lws, ' ') = freq.line GROUP BY 1),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM base
"""
