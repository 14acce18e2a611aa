"""HTML main-text extraction with a site style tree.

The DOMs of a host's pages are merged: elements meet on one node where their chains of names
(tag, class, role, and whether first or last among siblings of that name) agree. With m the
distinct pages that hold a node, and following the site style tree of Yi, Liu and Li (2003):

- content: a text on c of the m pages has importance 1 - log c / log m, and a node's own text has
  the mean over its distinct texts: 1 where every page has its own, 0 where all share one;
- presentation: the entropy, to the base m, of the sequences of child elements seen there;
- an element's composite importance is (1 - g) * presentation + g * (the mean of its children and
  its own text, weighted by their pages), with g = GAMMA ^ (distinct sequences - 1).

A node seen on few pages says little, so its own importance counts as m pages beside `strength`
pages of its parent's composite importance, and that beside `strength` pages of importance 1. Elements marked as an article or as menu, footer, advert
and so on (by tag, role, class or id) lend their nodes a prior that the tree's evidence moves:
marked parts can reach at most 0.5, parts of a marked article at least 0.75. The threshold is fitted
to each host: the cut of its nodes' importances with the greatest variance between both sides (Otsu),
if their means are `gap` apart; else the host shows no noise and nothing goes. Removed are
branches of low composite importance below which every text is low, and low texts elsewhere.

What no style can show is left out when parsing: scripts, forms, and readers' comments, whose texts
differ from page to page like an article's.

Defined results: null and empty html give empty text; null urls form one host; malformed html is
read as far as its tags can be told; broken character references stay as written; white space is
what str.split() takes for it, U+00A0 and U+001C to U+001F included; rows that repeat (equal html
on one host) count as one page in the tree and all get the same text; ties between cuts go to the
lowest; very long pages are read whole, in time linear in their length; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

GAMMA = 0.9
BINS = 50
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe template".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split()
)
#: Never an article's text, and without a style of their own.
_NEVER_TAGS = frozenset("form script style noscript template iframe svg button select dialog head title textarea canvas object".split())
_NEVER_WORDS = frozenset("comment comments disqus replies reply respond login signup".split())
#: Marks that lower a node's importance; the tree decides.
_NOISE_TAGS = frozenset("nav footer aside menu".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar share sharing social related recommended popup modal overlay widget widgets pagination pager toolbar skip".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An element. Inline elements without a mark are transparent: their text is their parent's (`own`)."""

    __slots__ = ("tag", "name", "own", "parent", "mark", "never", "article", "counts", "style", "index", "key", "chain")

    def __init__(self, tag: str, name: str, parent: Node | None, mark: int | None, never: bool, article: bool) -> None:
        self.tag, self.name, self.never, self.article = tag, name, never, article
        self.mark = mark if mark is not None else parent.mark if parent else None
        self.own, self.parent = self, parent.own if parent else None
        self.counts, self.style, self.index, self.key, self.chain = None, None, 0, 0, ()


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in the tree, whether its attributes mark it as no part of an article, and whether as no text at all."""
    name, noise, never = tag, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in _NOISE_ROLES or key == "aria-hidden" and value == "true" and tag not in _INLINE:
            name, noise = f"{name}@{value}", True
        if key in ("class", "id") and value:
            name += f".{' '.join(sorted(value.split()))}" if key == "class" else ""
            if tag not in ("html", "body", "article", "main") or key == "class" and tag == "article":
                said = re.split(r"[^a-z]+", value)
                noise, never = noise or not _NOISE_WORDS.isdisjoint(said), never or not _NEVER_WORDS.isdisjoint(said)
    return name, noise, never


_keys: dict[tuple[int, str], int] = {}


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _step_key(parent: int, name: str) -> int:
    """The key of a node from its parent's key and its name; kept, since a host's pages repeat them."""
    key = _keys.get((parent, name))
    if key is None:
        if len(_keys) > 200_000:
            _keys.clear()
        key = _keys[parent, name] = _hash(f"{parent}/{name}")
    return key


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The elements of a page, parents first, with their keys, chains and styles; and its blocks (element, text) in page order."""
    root = Node("", "", None, None, False, False)
    stack, nodes, out, parts, marked = [root], [root], [], [], False
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not stack[-1].never:
                out.append((stack[-1].own, text))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(x.own is x for x in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in _INLINE:
                flush()
            continue
        name, noise, never = _marks(tag, attributes) if attributes else (tag, False, False)
        closes = {"p"} if tag in _CLOSES_P else _SIBLINGS.get(tag)
        inline = tag in _INLINE and not noise and not never
        if not inline:
            flush()
        if tag in _VOID:
            continue
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE and stack[k].tag != "p":
                    break
        if attributes.rstrip().endswith("/") and tag in ("div", "p", "section"):
            continue
        parent = stack[-1]
        if parent.article and tag in _HEADINGS:
            noise = False  # a heading's class tells its look
        noise = noise or tag in _NOISE_TAGS or tag == "header" and not parent.article
        never = never or parent.never or tag in _NEVER_TAGS
        article = tag in ("article", "main") and not noise and not never and parent.mark != 0
        node = Node(tag, name, parent, 0 if noise else 1 if article else None, never, parent.article or article)
        stack.append(node)
        if inline:
            node.own = parent.own
            continue
        marked = marked or article
        above = parent.own
        if above.counts is None:
            above.counts, above.style = {}, []
        node.index = above.counts.get(name, 0)
        above.counts[name] = node.index + 1
        if above.style[-1:] != [name]:
            above.style.append(name)
        if not never:
            nodes.append(node)
    flush()
    if marked:  # text beside a marked article is no part of it, unless the tree says so
        root.mark, root.name = 0, "+"
    root.key = _step_key(0, root.name)
    root.chain = (root.key,)
    for x in nodes[1:]:
        if x.mark is None:
            x.mark = x.parent.mark
        last = x.parent.counts[x.name] - 1
        place = "" if not last else "^" if not x.index else "$" if x.index == last else "*"
        x.key = _step_key(x.parent.key, x.name + place)
        x.chain = (*x.parent.chain, x.key)
    return nodes, out


def blocks(page: str) -> list[str]:
    """The texts of a page's blocks in page order, before any is removed."""
    return [text for _, text in parsed(page)[1]]


_SEEN = "host long, page long, node long, kind int, variant long, mark int, chain array<long>"


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and node its distinct texts (kind 0) and sequences of children (kind 1); per slice each node's chain and mark (kind 2)."""
    for batch in batches:
        for part, _, _ in common.steps(batch, "html"):
            rows, known = [], set()
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                whole = _hash(page)
                nodes, found = parsed(page)
                seen = {(x.key, 0, _hash(text)) for x, text in found}
                seen.update((x.key, 1, _hash("|".join(x.style))) for x in nodes if x.style)
                rows += [(host, whole, *x, None, None) for x in seen]
                held = {x[0] for x in seen}
                for x in nodes:
                    if x.key in held and (host, x.key) not in known:
                        known.add((host, x.key))
                        rows.append((host, 0, x.key, 2, 0, x.mark, list(x.chain)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            names = ["host", "page", "node", "kind", "variant", "mark", "chain"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)


def style_tree(pages: DataFrame, strength: float = 20.0) -> DataFrame:
    """One row per host and node: chain, mark, m (pages), n (texts), own (importance of its text, null without), composite, and both after strength and mark; pages has host (long) and html."""
    seen = common.written(pages.mapInArrow(_variants, _SEEN), "style-variants")
    rows = seen.where("kind < 2").select("host", "page", "node", "kind", "variant").distinct()
    counted = common.written(rows.groupBy("host", "node", "kind", "variant").agg(F.count("*").cast("double").alias("c")), "style-counts")
    held = rows.select("host", "page", "node").distinct().groupBy("host", "node").agg(F.count("*").cast("double").alias("m"))
    meta = seen.where("kind = 2").groupBy("host", "node").agg(F.first("chain").alias("chain"), F.first("mark").alias("mark"))
    ln = lambda x: F.log(F.col(x))
    text, style = F.col("kind") == 0, F.col("kind") == 1
    of = counted.groupBy("host", "node").agg(  # before pages are joined: a node may have as many texts as its host has pages
        F.sum(F.when(text, F.col("c"))).alias("n"), F.avg(F.when(text, ln("c"))).alias("shared"),
        F.count(F.when(style, 1)).alias("styles"), F.sum(F.when(style, F.col("c"))).alias("s"), F.sum(F.when(style, F.col("c") * ln("c"))).alias("w"),
    ).join(held, ["host", "node"])
    of = of.withColumn("own", F.when(F.col("m") > 1, 1 - F.col("shared") / ln("m")).when(F.col("shared").isNotNull(), 1.0))
    entropy = F.when(F.col("styles") == 0, 0.0).when(F.col("m") > 1, F.least(F.lit(1.0), (ln("s") - F.col("w") / F.col("s")) / ln("m"))).otherwise(1.0)
    nodes = meta.join(of, ["host", "node"]).select(
        "host", "node", "chain", "mark", "m", "n", "own", entropy.alias("presentation"), F.pow(F.lit(GAMMA), F.greatest(F.col("styles") - 1, F.lit(0))).alias("g"),
        F.try_element_at("chain", F.lit(-2)).alias("parent"),
    )
    nodes = common.written(nodes, "style-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("host", F.col("parent").alias("node")).agg(F.sum("m").alias("below"))
    text = F.when(F.col("own").isNotNull(), F.col("m")).otherwise(0.0)
    nodes = nodes.join(children, ["host", "node"], "left").withColumn("all", F.coalesce("below", F.lit(0.0)) + text).withColumn(
        "part", (1 - F.col("g")) * F.col("presentation") + F.col("g") * F.coalesce(F.col("own") * F.col("m") / F.nullif("all", F.lit(0.0)), F.lit(0.0))
    )
    above = nodes.select("host", F.col("node").alias("parent"), F.col("g").alias("of_g"), F.col("all").alias("of_all"))
    share = F.coalesce(ln("of_g") + F.log(F.col("m") / F.col("of_all")), F.lit(0.0))  # the root has no parent
    nodes = nodes.join(above, ["host", "parent"], "left").withColumn("share", share)
    lines = nodes.select("host", "node", F.explode("chain").alias("over"))
    weight = lines.join(nodes.select("host", F.col("node").alias("over"), "share"), ["host", "over"]).groupBy("host", "node").agg(F.sum("share").alias("weight"))
    weight = common.written(weight.join(nodes.select("host", "node", "part"), ["host", "node"]), "style-weights")
    composite = (
        lines.join(weight, ["host", "node"]).join(weight.select("host", F.col("node").alias("over"), F.col("weight").alias("of_weight")), ["host", "over"])
        .groupBy("host", F.col("over").alias("node")).agg(F.sum(F.exp(F.col("weight") - F.col("of_weight")) * F.col("part")).alias("composite"))
    )
    composite = common.written(composite, "style-composite")
    seen_on = F.col("m") / (F.col("m") + strength)
    parents = nodes.select("host", "node", "m").join(composite, ["host", "node"]).select("host", F.col("node").alias("parent"), (seen_on * F.col("composite") + 1 - seen_on).alias("around"))
    tree = nodes.select("host", "node", "parent", "chain", "mark", "m", "n", "own").join(composite, ["host", "node"]).join(parents, ["host", "parent"], "left")

    def judged(x: str) -> Column:
        value = seen_on * F.col(x) + (1 - seen_on) * F.coalesce("around", F.lit(1.0))
        return F.when(F.col("mark") == 0, 0.5 * seen_on * value).when(F.col("mark") == 1, 1 - 0.25 * seen_on * (1 - value)).otherwise(value)

    return common.written(tree.withColumn("of_text", judged("own")).withColumn("of_branch", judged("composite")), "style-tree")


def thresholds(tree: DataFrame, gap: float = 0.4) -> DataFrame:
    """(host, least): the cut of each host's text importances, in BINS steps; no row where both sides are less than `gap` apart."""
    bins = tree.where("own IS NOT NULL").groupBy("host", F.least(F.floor(F.col("of_text") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("of_text")).alias("x")
    )
    cuts = bins.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "x"))).alias("b"), F.sum("n").alias("n"), F.sum("x").alias("x"))  # at most BINS
    low = "aggregate(slice(b, 1, i), cast(0 AS DOUBLE), (s, v) -> s + v.{0})"
    cuts = cuts.where("size(b) > 1").select("host", "b", "n", "x", F.expr("explode(sequence(1, size(b) - 1)) AS i"))
    cuts = cuts.select("host", F.expr("b[i].bin").alias("bin"), "n", "x", F.expr(low.format("n")).alias("n0"), F.expr(low.format("x")).alias("x0"))
    apart = F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0")
    cuts = cuts.withColumn("n1", F.col("n") - F.col("n0")).withColumn("x1", F.col("x") - F.col("x0")).withColumn("apart", apart)
    # the cut lies at the lowest bin of the upper side; equal variances go to the lowest cut
    best = cuts.groupBy("host").agg(F.max(F.struct(F.round(F.col("n0") * F.col("n1") * F.col("apart") * F.col("apart") / F.col("n") / F.col("n"), 9).alias("v"), (-F.col("bin")).alias("bin"), "apart")).alias("c"))
    return best.where(F.col("c.apart") >= gap).select("host", (-F.col("c.bin") / F.lit(float(BINS))).alias("least"))


def noise(tree: DataFrame, gap: float = 0.4) -> DataFrame:
    """(host, node, branch): the topmost branches to be removed whole, and the other nodes whose own text goes."""
    cut = tree.join(thresholds(tree, gap), "host").withColumn("low", F.col("of_text") < F.col("least"))
    texts = cut.where("own IS NOT NULL").select("host", F.explode("chain").alias("node"), "low")
    below = texts.groupBy("host", "node").agg(F.min("low").alias("all_low"))
    rated = cut.join(below, ["host", "node"], "left").withColumn("branch", F.coalesce("all_low", F.lit(False)) & (F.col("of_branch") < F.col("least")))
    rated = common.written(rated.select("host", "node", "parent", "branch", F.coalesce("low", F.lit(False)).alias("low")), "style-low")
    over = rated.where("branch").select("host", F.col("node").alias("parent"), F.lit(True).alias("covered"))
    top = rated.where("branch OR low").join(over, ["host", "parent"], "left")
    return top.where("branch AND covered IS NULL OR NOT branch").select("host", "node", "branch")


def _main_text(page: str | None, branches: frozenset[int], texts: frozenset[int]) -> str:
    found = parsed(page or "")[1]
    if branches or texts:
        found = [(x, text) for x, text in found if x.key not in texts and branches.isdisjoint(x.chain)]
    return "\n\n".join(text for _, text in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in common.steps(batch, "html"):
            cut = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
            texts = [_main_text(page, frozenset(branches or ()), frozenset(low or ())) for page, branches, low in cut]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = 20.0, gap: float = 0.4, broadcast_nodes: int = 100_000
) -> DataFrame:
    """id, url, text and n_chars of every page."""
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = common.written(noise(style_tree(named.select("host", "html"), strength), gap), "style-noise")
    by_host = low.groupBy("host").agg(F.collect_set(F.when(F.col("branch"), F.col("node"))).alias("branches"), F.collect_set(F.when(~F.col("branch"), F.col("node"))).alias("low"))
    if low.count() <= broadcast_nodes:  # 8 bytes a node
        joined = named.join(F.broadcast(by_host), "host", "left")
    else:  # a host's pages are spread over salts, and its nodes repeated for each
        salts = 64
        spread = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = named.withColumn("salt", F.pmod(F.hash("id", "url"), F.lit(salts))).join(spread, ["host", "salt"], "left")
    out = joined.select("id", "url", "html", "branches", "low").mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
