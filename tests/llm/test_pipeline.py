"""The corpus pipeline's stages, each on its own input, against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from conftest import SMALL
from llm.test_operators import brute_pii, classes_by_brute_force, odd_documents, shingle_bag, words

from palimpsest.llm import common


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    before = [tuple(r) for r in docs.collect()]
    items = {r.item_id: set(shingle_bag(r.text.lower())) for r in common.table(spark, SMALL, "benchmark").collect()}
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, docs, SMALL), "stage")
        after = [tuple(r) for r in out.collect()]
        texts = {r[0]: r[1] for r in before}
        if name != "packing":
            assert out.columns == cp.COLUMNS
        if name == "quality_rules":
            def failed(t):
                w = words(t)
                tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
                covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
                return len(w) < 50 or 100 * len(covered) > 50 * len(w)

            per_host = defaultdict(set)
            for _, t, _, host, _ in before:
                per_host[host].add(t or "")
            norm = lambda line: " ".join(re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in words(line))
            seen = Counter((host, x) for host, ts in per_host.items() for t in ts for x in {norm(y) for y in t.split("\n")} if x)
            often = {(host, x) for (host, x), n in seen.items() if n >= 5 and n >= 0.01 * len(per_host[host])}
            want = {}
            for i, t, _, host, n in before:
                lines = [x for x in (t or "").split("\n")]
                left = "\n".join(x for x in lines if (host, norm(x)) not in often)
                if not failed(t) and len(words(left)) >= max(50, 0.5 * len(words(t))):
                    want[i] = (left, n if left == t else len(left))
            assert {r[0]: (r[1], r[4]) for r in after} == want and len(after) == len(want)
        elif name == "near_dedup":
            classes = classes_by_brute_force([(r[0], r[1]) for r in before])
            assert sorted(after) == sorted(r for r in before if classes[r[0]] == r[0])
        elif name == "decontaminate":
            held = {i for i, t in texts.items() if any(len(s & set(shingle_bag(t.lower()))) >= 0.8 * len(s) for s in items.values() if s)}
            assert sorted(after) == sorted(r for r in before if r[0] not in held)
        elif name == "pii":
            for r in after:
                spans = brute_pii(texts[r[0]])
                assert brute_pii(r[1]) == [] and sum(r[1].count(f"[{k}]") for k in ("EMAIL", "IP", "CARD", "PHONE")) == len(spans) + sum(texts[r[0]].count(f"[{k}]") for k in ("EMAIL", "IP", "CARD", "PHONE"))
                assert r[4] == len(r[1])
        else:
            per = defaultdict(int)
            for r in out.collect():
                per[r.doc_id] += 1
            assert set(per) == set(texts)
        docs, before = out, after


def test_odd_rows_and_empty_tables(spark):
    empty = odd_documents(spark).limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, SMALL)
        assert out.count() == 0
    odd = odd_documents(spark)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    docs, left = odd, {}
    for name, stage in cp.STAGES:
        docs = common.written(stage(spark, docs, SMALL), "odd")
        left[name] = ids(docs)
    texts = [(False, i) for i in range(6)]
    assert left["quality_rules"] == [*texts, (False, 6), (False, 7), (True, 0)]  # short, empty and repetitive texts go
    assert left["near_dedup"] == left["decontaminate"] == left["pii"] == left["packing"] == texts
    alone = {name: ids(common.written(stage(spark, odd, SMALL), "odd")) for name, stage in cp.STAGES}
    every = ids(odd)
    assert alone["decontaminate"] == alone["pii"] == every and sorted(set(alone["packing"])) == sorted(set(every))
    assert alone["near_dedup"] == [*texts, *[(False, i) for i in (8, 10, 11, 12, 13, 14, 15)]]
    for _, stage in cp.STAGES:
        stage(spark, odd_documents(spark), SMALL).count()


def test_frequent_lines_leave_the_texts(spark):
    name = lambda x: "".join(chr(97 + int(c)) for c in str(x))  # noqa: E731  digits of lines are zeroed, so letters tell them apart
    own = lambda i, n: " ".join(f"own{name(i)}x{name(k)}" for k in range(n))
    notice = "All RIGHTS kept by é site 12"
    rows = [(i, f"{own(i, 60)}\n{notice}\n\n{own(i + 500, 5)}" if i % 2 else f"{notice}\n{own(i, 60)}\n{notice}", "en", "h", -1) for i in range(60)]
    rows += [(100, f"{own(100, 60)}\n{notice}\n", "en", "other", -1), (None, f"{own(101, 60)}\n{notice}", "en", "h", -1), (None, own(102, 60), "en", "h", -1)]
    rows += [(7, "too short", "en", "h", -1), (None, "short too", "en", "h", -1), (103, notice, "en", "h", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {tuple(r) for r in cp._quality(spark, docs, SMALL).collect()}
    want = set()
    for i, t, lang, host, n in rows[:-3]:
        kept = "\n".join(x for x in t.split("\n") if host != "h" or x != notice)
        want.add((i, kept, lang, host, n if kept == t else len(kept)))
    assert got == want


def test_near_dedup_keeps_one_row_of_each_class(spark):
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(90))
    near = lambda k: own(k) + " tail"
    rows = [(None, own(0)), (None, own(1)), (None, near(1)), (3, near(2)), (None, own(2)), (None, own(2)), (5, own(3)), (5, own(4)), (6, near(4)), (5, own(3)), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp._near_dedup(spark, docs, SMALL).collect()]
    assert len(got) == len(set(got)) == 6
    assert {(None, own(0)), (3, near(2)), (5, own(3)), (5, own(4)), (9, None)} <= set(got)
    assert len({(None, own(1)), (None, near(1))} & set(got)) == 1


def test_decontamination_goes_by_text(spark):
    item = common.table(spark, SMALL, "benchmark").first().text
    rows = [(None, f"aa {item} bb"), (1, f"aa {item} bb"), (1, "a clean text of the same id"), (None, "a clean text of no id"), (2, None), (3, item.upper())]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter((r.doc_id, r.text) for r in cp._decontaminate(spark, docs, SMALL).collect()) == Counter(rows[2:5])


def test_masking_of_null_ids(spark):
    rows = [(None, "write to a@b.cd now"), (None, "or call +1 (212) 555-1234."), (None, "none"), (1, "x@y.zz"), (1, "or call +1 (212) 555-1234."), (None, None), (None, "write to a@b.cd now")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text, r.n_chars) for r in cp._mask_pii(spark, docs, SMALL).collect())
    want = [(None, "write to [EMAIL] now"), (None, "or call [PHONE]."), (None, "none"), (1, "[EMAIL]"), (1, "or call [PHONE]."), (None, None), (None, "write to [EMAIL] now")]
    assert got == Counter((i, t, len(t or "")) for i, t in want)
