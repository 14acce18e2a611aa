"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame functions only.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches with a validity test;
a match that fails is dropped. The bootstrap starts from them: every run of words with digits, and
every other word with an @, is an occurrence of an instance (its text) in lexical contexts: the
one or two words before it, the word after it, the words on both sides. A context makes a
pattern of its words alone, so identifiers of any layout share it; the one-sided contexts make a
narrower pattern too, of the words with the run's shape. Instances that overlap base spans are
seeds of score 1; so are words of KEY's form (keys and tokens are written that way), but these
must be confirmed by a context like any other instance. In each round a pattern's confidence is
the score sum of its distinct instances over their number plus one, patterns of little support
drop out, a context counts by the better of its patterns, and an instance that is no seed is raised
to 1 - product(1 - confidence) over its contexts; it supports patterns in the next round only from
`accept` on, or doubtful ones would confirm each other. Instances at `accept` after the last round
add spans of kind `id` if they have an @ or at least four digits, as every base span has; base
spans always stay.

Positions are code points. Spark's regular expressions yield matches without places, so a text is
also split at the same pattern: lengths of the pieces and matches add up to the places. The
patterns are possessive and anchored to the last match or the run's start, which changes no match
and keeps them linear on long runs. Running sums and maxima go by blocks (`running`), so a text of
a million matches takes about a million steps.

Defined results: null text is empty; an empty text has no spans and the digest of the empty
string; rows of null id are known by their text like all others; rows that repeat give
repeated results and count once for the bootstrap's instances; spans of one start are in the
order of kinds as listed; texts of any length are read whole; an empty table gives an empty result;
columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

KINDS = ["email", "ip", "card", "phone", "id"]
#: The contract's patterns with possessive repeats; groups are non-capturing.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit, joined by single spaces; or a word with an @ and no digit.
RUN = r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+|[^\s0-9@]*+@[^\s0-9]*+(?!\S))"

_DIGITS = "regexp_replace(m.text, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(m.text, '[.]'), p -> coalesce(try_cast(p AS INT), 256) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + CASE "
    f"WHEN i % 2 = 1 THEN int(substr({_DIGITS}, -i, 1)) WHEN int(substr({_DIGITS}, -i, 1)) > 4 THEN 2 * int(substr({_DIGITS}, -i, 1)) - 9 "
    f"ELSE 2 * int(substr({_DIGITS}, -i, 1)) END) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
#: Seeds besides the base spans: lower-case hexadecimal keys.
KEY = "instance RLIKE '^[0-9a-f]{32,}$' AND instance RLIKE '[0-9]' AND instance RLIKE '[a-f]'"
BLOCK = 256
_plus = "{} + {}".format
_greatest = "greatest({}, {})".format


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` where `name` stands for `value`, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, zero: str, merged: Callable[[str, str], str]) -> str:
    """SQL of the array whose i-th item merges all items of an int array before the i-th, beginning with `zero`.

    A fold that appends copies its array at each step, so folds run in blocks: n * BLOCK + (n / BLOCK) ^ 2 steps of a copy.
    """
    fold = lambda array, start: (
        f"aggregate({array}, named_struct('s', {start}, 'o', cast(array() AS array<int>)), "
        f"(a, v) -> named_struct('s', {merged('a.s', 'v')}, 'o', concat(a.o, array(a.s))), a -> a.o)"
    )
    block = f"slice(l, b * {BLOCK} + 1, {BLOCK})"
    totals = f"transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> aggregate({block}, {zero}, (s, v) -> {merged('s', 'v')}))"
    whole = f"flatten(transform({fold(totals, zero)}, (c, b) -> {fold(block, 'c')}))"
    return _let("l", values, f"CASE WHEN size(l) = 0 THEN l WHEN size(l) <= {BLOCK} THEN {fold('l', zero)} ELSE {whole} END")


def places(text: str, pattern: str, needs: str, context: bool = False) -> Column:
    """All matches of a pattern in a text column as (start, end, text), with the words around them where asked for."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    before = "regexp_extract(m.p[i], '(\\\\S+(?:\\\\s+\\\\S+)?)\\\\s*$', 1)" if context else "''"
    after = "regexp_extract(m.p[i + 1], '^\\\\s*(\\\\S+)', 1)" if context else "''"
    lengths = "transform(m.f, (x, i) -> length(m.p[i]) + length(x))"
    place = (
        f"named_struct('start', s + length(m.p[i]), 'end', s + length(m.p[i]) + length(m.f[i]), 'text', m.f[i], 'before', {before}, 'after', {after})"
    )
    walk = _let("m", f"named_struct('f', regexp_extract_all({text}, '{p}', 0), 'p', split({text}, '{p}', -1))", f"transform({running(lengths, '0', _plus)}, (s, i) -> {place})")
    return F.expr(f"CASE WHEN {text} RLIKE '{needs}' THEN {walk} ELSE cast(array() AS array<struct<start:int,end:int,text:string,before:string,after:string>>) END")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: (id, text_key, base spans, runs with their contexts and whether they overlap a base span)."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("id", F.xxhash64("text").alias("text_key"), "text")
    needs = {"email": "@", "ip": "[0-9][.]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]"}
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        df = df.withColumn(kind, places("text", pattern, needs[kind]))
    df = df.withColumn("runs", places("text", RUN, "[0-9@]", context=True)).drop("text")
    for k, kind in enumerate(KINDS[:4]):
        kept = F.expr(f"transform(filter({kind}, m -> {_VALID[kind]}), m -> named_struct('start', m.start, 'kind', {k}, 'end', m.end))")
        df = df.withColumn(kind, kept)
    df = df.select("id", "text_key", F.expr("array_sort(concat(email, ip, card, phone))").alias("base"), "runs")
    df = df.withColumn(
        "runs",
        F.expr(
            "filter(transform(runs, r -> named_struct('start', r.start + length(r.text) - length(regexp_replace(r.text, '^[^0-9A-Za-z+]+', '')), "
            "'end', r.end - length(r.text) + length(regexp_replace(r.text, '[^0-9A-Za-z]+$', '')), "
            "'instance', regexp_replace(regexp_replace(r.text, '^[^0-9A-Za-z+]+', ''), '[^0-9A-Za-z]+$', ''), 'before', lower(r.before), 'after', lower(r.after))), r -> r.end > r.start)"
        ),
    )
    # a run overlaps a base span if, of those that begin before its end, one ends after its start: runs by their ends among spans by their starts
    events = (
        "array_sort(concat(transform(runs, (r, i) -> named_struct('at', r.end, 'kind', 0, 'end', -1, 'i', i)), "
        "transform(base, (b, i) -> named_struct('at', b.start, 'kind', 1, 'end', b.end, 'i', i))))"
    )
    reach = running("transform(e, x -> x.end)", "-1", _greatest)
    reached = f"filter(zip_with(e, {reach}, (x, r) -> named_struct('i', x.i, 'kind', x.kind, 'r', r)), x -> x.kind = 0)"
    by_run = _let("e", events, f"transform(array_sort({reached}), x -> x.r)")  # runs and their ends have one order
    return df.withColumn("reach", F.expr(f"CASE WHEN size(base) = 0 OR size(runs) = 0 THEN transform(runs, r -> -1) ELSE {by_run} END"))


def occurrences(scan: DataFrame) -> DataFrame:
    """(id, text_key, start, end, instance, base, seed, patterns as (context, shape)) of every run; a pattern of the words alone has an empty shape."""
    run = F.explode(F.arrays_zip("runs", "reach")).alias("r")
    rows = scan.select("id", "text_key", run).select("id", "text_key", "r.runs.*", (F.col("r.reach") > F.col("r.runs.start")).alias("base"))
    shape = "regexp_replace(regexp_replace(instance, '[0-9]', '9'), '[A-Za-z]+', 'a')"
    last = "regexp_extract(before, '(\\\\S+)$', 1)"
    two, one, after = "concat('<2 ', regexp_replace(before, '\\\\s+', ' '))", f"concat('<1 ', {last})", "concat('>1 ', after)"
    pattern = lambda context, shape="''", when="true": f"named_struct('context', CASE WHEN {when} THEN {context} END, 'shape', {shape})"
    alone = ", ".join([  # at the edge of a text there are no words
        pattern(two, when="before RLIKE '\\\\s'"), pattern(one, when=f"{last} <> ''"), pattern(after, when="after <> ''"),
        pattern(f"concat('<> ', {last}, ' ', after)", when=f"{last} <> '' AND after <> ''"),
    ])
    shaped = ", ".join(pattern(x, shape) for x in (two, one, after))
    return rows.select(
        "id", "text_key", "start", "end", "instance", "base", F.expr(f"base OR ({KEY})").alias("seed"),
        F.expr(f"array_distinct(concat(filter(array({alone}), p -> p.context IS NOT NULL), array({shaped})))").alias("patterns"),
    )


def bootstrap(found: DataFrame, rounds: int, support: int, confident: float, accept: float) -> DataFrame:
    """(instance) of the unseen identifiers: scores run over the graph of distinct patterns and instances."""
    graph = found.select("instance", "base", "seed", F.explode("patterns").alias("p")).select("instance", "base", "seed", "p.*")
    graph = common.written(graph.groupBy("instance", "context", "shape").agg(F.max("base").alias("base"), F.max("seed").alias("seed")), "pii-graph")
    links = graph.select("instance", "context", "shape")
    seeds = graph.groupBy("instance").agg(F.max("base").alias("base"), F.max("seed").alias("seed"))
    scores = common.written(seeds.select("instance", "base", "seed", F.col("seed").cast("double").alias("score"), F.lit(0.0).alias("raised")), "pii-scores")
    for _ in range(rounds):
        rated = links.join(scores.select("instance", "score"), "instance").groupBy("context", "shape")
        patterns = rated.agg(F.sum("score").alias("sum"), F.count("*").alias("n")).where(F.col("sum") >= support)
        patterns = patterns.select("context", "shape", (F.col("sum") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= confident)
        by_context = links.join(patterns, ["context", "shape"]).groupBy("instance", "context").agg(F.max("confidence").alias("confidence"))
        raised = by_context.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("raised"))
        raised = scores.drop("raised").join(raised, "instance", "left").withColumn("raised", F.coalesce("raised", F.lit(0.0)))
        last, scores = scores, common.written(raised.withColumn("score", F.when(F.col("seed"), 1.0).when(F.col("raised") >= accept, F.col("raised")).otherwise(0.0)).select(scores.columns), "pii-scores")
        common.discard(last)
    likely = F.col("instance").contains("@") | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= 4)
    new = common.written(scores.where(~F.col("base") & (F.col("raised") >= accept) & likely).select("instance"), "pii-new")
    for table in (graph, scores):
        common.discard(table)
    return new


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, confident: float = 0.6, accept: float = 0.9,
    broadcast_instances: int = 50_000,
) -> DataFrame:
    """One row per document row: its id, text_key (xxhash64 of the text), base spans and all spans as (start, kind, end)."""
    scan = common.written(scanned(docs, id_col, text_col), "pii-scan")
    found = common.written(occurrences(scan), "pii-runs")
    new = bootstrap(found, rounds, support, confident, accept)
    if new.count() <= broadcast_instances:
        hits = found.where(~F.col("base")).join(F.broadcast(new), "instance")
    else:  # a frequent instance's occurrences are spread over salts, and the instances repeated for each
        salts = 32
        spread = new.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        hits = found.where(~F.col("base")).withColumn("salt", F.pmod(F.xxhash64("text_key", "start"), F.lit(salts).cast("long"))).join(spread, ["instance", "salt"])
    added = hits.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("added"))
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)")
    added = added.select(F.col("id").alias("a_id"), F.col("text_key").alias("a_key"), "added")
    both = scan.select("id", "text_key", "base").join(added, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key")), "left")
    return both.select(F.col("id").alias(id_col), "text_key", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of find_pii's rows: counts of base spans, their digest, and all spans as text."""
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)")
    return found.select(
        id_col, *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"),
    )


def mask(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans take the first one's place together.

    A substring is found by counting code points from the start of its text, so the text is cut into stretches of many
    spans, these into stretches of fewer, and only these into pieces.
    """
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    heads = f"filter(zip_with({spans}, {running(f'transform({spans}, x -> x.end)', '0', _greatest)}, (x, r) -> named_struct('at', r, 'to', x.start, 'kind', x.kind)), x -> x.to >= x.at)"

    def stretch(heads: str, text: str, start: str, size: int, level: int) -> str:
        h, t, i = f"h{level}", f"t{level}", f"i{level}"
        inner = (
            f"transform({h}, x -> concat(substr({t}, x.at - {h}[0].at + 1, x.to - x.at), {names}[x.kind]))" if size == 1
            else f"transform(sequence(0, (size({h}) - 1) div {size}), {i} -> {stretch(f'slice({h}, {i} * {size} + 1, {size})', t, f'{h}[0].at', size // BLOCK, level + 1)})"
        )
        return _let(h, heads, _let(t, f"substr({text}, {h}[0].at - {start} + 1, element_at({h}, -1).to - {h}[0].at)", f"array_join({inner}, '')"))

    masked = f"concat({stretch(heads, text, '0', BLOCK * BLOCK, 0)}, substr({text}, array_max(transform({spans}, x -> x.end)) + 1))"
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {masked} ELSE {text} END")
