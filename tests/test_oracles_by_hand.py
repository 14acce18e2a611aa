"""Queries that SQL can't state, against plain Python on the small tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SMALL

from palimpsest import catalog
from palimpsest.functions import boundary
from palimpsest.streaming import log_stages


def test_log_states(spark, duck):
    from palimpsest.plans import report_queries

    lines = defaultdict(list)
    for r in report_queries._log(spark, SMALL).collect():
        lines[r.job_id].append((r.seq, r.line))
    want = {}
    for job, rows in lines.items():
        status: dict[str, str] = {}
        for _, line in sorted(rows):
            log_stages.advance(status, line or "")
        if status:
            want[job] = ",".join(f"{s}={status[s]}" for s in log_stages.STAGES if s in status)
    got = {r.job_id: r.status for r in catalog.QUERIES["log_stage_state"](spark, SMALL).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_a_started_stage_completes_the_ones_before_it():
    status = {"version": "failed"}
    log_stages.advance(status, "== 3. MIGRATION JOB SELECTION ==")
    assert status == {"scan": "completed", "version": "failed", "selection": "running"}


@pytest.mark.parametrize("text", ["", "a b a", "x " * 2000, "Def f(x): return x_1"])
def test_hashed_embedding(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(boundary.hashed_embedding(F.col("t"), 8).alias("v")).first()
    tokens = [t for t in __import__("re").split(r"[^a-z0-9_]+", text.lower()) if t]
    want = [0.0] * 8
    if tokens:
        places = {r.t: r.p for r in spark.createDataFrame([(t,) for t in set(tokens)], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(16)).alias("p")).collect()}
        for t in tokens:
            want[places[t] // 2] += 1 if places[t] % 2 == 0 else -1
        norm = sum(x * x for x in want) ** 0.5
        want = [x / norm if norm else 0.0 for x in want]
    assert row.v == pytest.approx(want, abs=1e-6)
