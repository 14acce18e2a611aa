"""Remote sources as boundaries: a GET that waits and tries again, paging, and the folder a repository is read from.

Nothing here opens a connection: `get` is the caller's, from a URL to a Reply, raising OSError
(ConnectionError, TimeoutError) where there is no reply. Clock and sleep are parameters too.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Reply:
    status: int
    text: str = ""
    headers: dict[str, str] = field(default_factory=dict)


class Refused(Exception):
    """A reply whose status is an error, or no usable reply after the last try."""


@dataclass(frozen=True)
class Policy:
    """tries; seconds after the first lost connection, which double up to most_wait; what counts as a spent rate limit; whether failing means an exception or None."""

    limited: Callable[[Reply], bool]
    tries: int = 5
    first_wait: float = 2
    most_wait: float = 30
    strict: bool = True
    absent: tuple[int, ...] = ()


# The two clients' tries, waits and signs of a spent rate limit.
SEARCHING = Policy(lambda r: r.status == 403 and "rate limit" in r.text.lower())
ENRICHING = Policy(lambda r: r.status == 403 and r.headers.get("X-RateLimit-Remaining") == "0", first_wait=1, strict=False, absent=(404,))
LEAST_PAUSE, UNKNOWN_PAUSE = 5, 60


def fetch(get: Callable[[str], Reply], url: str, policy: Policy, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Reply | None:
    """The reply of a URL; None for an absent one and, if the policy isn't strict, where every try failed."""
    wait = policy.first_wait
    for left in range(policy.tries - 1, -1, -1):
        try:
            reply = get(url)
        except OSError:
            if left:
                sleep(min(wait, policy.most_wait))
                wait *= 2
                continue
            if policy.strict:
                raise
            return None
        wait *= 2
        if policy.limited(reply):
            resumes = float(reply.headers.get("X-RateLimit-Reset", now() + UNKNOWN_PAUSE))
            sleep(max(resumes - now(), LEAST_PAUSE))
        elif reply.status in policy.absent:
            return None
        elif reply.status >= 400:
            raise Refused(f"status {reply.status}: {url}")
        else:
            return reply
    if policy.strict:
        raise Refused(f"no reply after {policy.tries} tries: {url}")
    return None


def paged(page: Callable[[int], Iterable], pages: int | None = None, rows: int | None = None) -> Iterator:
    """Rows of page 1, 2, ... until an empty one, the last of `pages`, or `rows` rows."""
    given = 0
    for k in range(1, pages + 1) if pages else count(1):
        found = list(page(k))
        if not found:
            return
        for row in found:
            if given == rows:
                return
            given += 1
            yield row


def usable(spark: SparkSession, path: str | None) -> bool:
    """Whether a path of any file system is a folder with a Python file at some depth; one with a drive letter is another machine's."""
    if not path or re.match(r"[A-Za-z]:[\\/]", path):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".py"):
            return True
    return False


def _parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def original_repository(spark: SparkSession, named: str | None, outputs: str, override: str | None = None, home: str | None = None) -> str:
    """The first usable of: the override, the named folder, its namesakes beside the outputs and below the home folder; "" if none is.

    Of each folder but the override, one of the same name inside it comes first. An empty name
    names no folder.
    """
    name = (named or "").replace("\\", "/").rstrip("/").rpartition("/")[2]
    folders = [named] if named else []
    if name:
        beside = [_parent(outputs), _parent(_parent(outputs))]
        folders += [f"{x}/{name}" for x in beside + ([f"{home}/{x}" for x in HOME_FOLDERS] if home else [])]
    chain = [override, *[x for f in folders for x in (f"{f.rstrip('/')}/{name}", f)]]
    return next((x for x in chain if usable(spark, x)), "")


def migrated_repository(spark: SparkSession, named: str | None, outputs: str, name: str, override: str | None = None) -> str:
    """The first usable of: the override, the named folder, the folder `name` in the outputs or beside them; "" if none is."""
    return next((x for x in (override, named, f"{outputs.rstrip('/')}/{name}", f"{_parent(outputs)}/{name}") if usable(spark, x)), "")


#: Folders below the home folder that may hold a downloaded repository.
HOME_FOLDERS = ("Downloads", "OneDrive/Downloads", "OneDrive/Documents")
