"""Retrying, paging and the folder of a repository."""

from __future__ import annotations

import pytest

from palimpsest.sources import remote
from palimpsest.sources.remote import ENRICHING, SEARCHING, Refused, Reply


def tried(replies, policy):
    """What fetch gives for a list of replies (exceptions are raised), and its pauses."""
    pauses, left = [], iter(replies)

    def get(url):
        r = next(left)
        if isinstance(r, Exception):
            raise r
        return r

    try:
        out = remote.fetch(get, "u", policy, now=lambda: 1000.0, sleep=pauses.append)
    except (Refused, OSError) as e:
        out = type(e)
    return out, pauses


OK, LOST = Reply(200, "x"), ConnectionError()


@pytest.mark.parametrize(
    "replies, policy, want",
    [
        ([OK], SEARCHING, (OK, [])),
        ([LOST, TimeoutError(), OK], SEARCHING, (OK, [2, 4])),
        ([LOST] * 5, SEARCHING, (ConnectionError, [2, 4, 8, 16])),
        ([Reply(403, "API Rate Limit exceeded", {"X-RateLimit-Reset": "1040"}), OK], SEARCHING, (OK, [40])),
        ([Reply(403, "rate limit", {"X-RateLimit-Reset": "990"}), OK], SEARCHING, (OK, [5])),
        ([Reply(403, "rate limit")] * 5, SEARCHING, (Refused, [60] * 5)),
        ([Reply(403, "rate limit"), LOST, OK], SEARCHING, (OK, [60, 4])),
        ([Reply(403, "no")], SEARCHING, (Refused, [])),
        ([Reply(404)], SEARCHING, (Refused, [])),
        ([LOST, OK], ENRICHING, (OK, [1])),
        ([LOST] * 5, ENRICHING, (None, [1, 2, 4, 8])),
        ([Reply(404)], ENRICHING, (None, [])),
        ([Reply(403, "", {"X-RateLimit-Remaining": "0"})] * 5, ENRICHING, (None, [60] * 5)),
        ([Reply(500)], ENRICHING, (Refused, [])),
    ],
)
def test_fetch(replies, policy, want):
    assert tried(replies, policy) == want


def test_waits_are_bounded():
    policy = remote.Policy(lambda r: False, tries=8)
    assert tried([LOST] * 7 + [OK], policy) == (OK, [2, 4, 8, 16, 30, 30, 30])


def test_paged():
    of = {1: "ab", 2: "cd", 3: "", 4: "e"}
    assert list(remote.paged(lambda k: of[k])) == list("abcd")
    assert list(remote.paged(lambda k: of[k], pages=1)) == list("ab")
    assert list(remote.paged(lambda k: of[k], rows=3)) == list("abc")


@pytest.fixture
def made(tmp_path):
    def make(*files):
        for f in files:
            (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / f).write_text("")
        return str(tmp_path)

    return make


def test_usable(spark, made):
    root = made("a/b/c.py", "d/e.txt")
    assert remote.usable(spark, f"{root}/a")
    assert not any(remote.usable(spark, x) for x in (None, "", f"{root}/d", f"{root}/gone", f"{root}/a/b/c.py"))


def test_original_repository(spark, made):
    root = made("w/r/x.py", "home/Downloads/q/y.py", "over/z.py", "w/out/notes.txt", "n/n/x.py", "n/x.py")
    find = lambda named, **more: remote.original_repository(spark, named, f"{root}/w/out", **more)
    assert find("/gone/r") == f"{root}/w/r"
    assert find("C:\\gone\\r") == f"{root}/w/r"
    assert find("/gone/r", override=f"{root}/over") == f"{root}/over"
    assert find("/gone/r", override=f"{root}/gone") == f"{root}/w/r"
    assert find(f"{root}/n") == f"{root}/n/n"
    assert find("/gone/q") == ""
    assert find("/gone/q", home=f"{root}/home") == f"{root}/home/Downloads/q"
    assert find("") == find(None) == ""


def test_migrated_repository(spark, made):
    root = made("out/r_new/x.py", "s_new/x.py", "m/x.py")
    find = lambda named, name, **more: remote.migrated_repository(spark, named, f"{root}/out", name, **more)
    assert find(f"{root}/m", "r_new") == f"{root}/m"
    assert find(None, "r_new") == f"{root}/out/r_new"
    assert find("/gone", "s_new") == f"{root}/s_new"
    assert find("/gone", "t_new", override=f"{root}/m") == f"{root}/m"
    assert find("/gone", "t_new") == ""
