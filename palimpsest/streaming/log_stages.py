"""Pipeline logs: a state machine from log lines to stage states, as a batch fold and as a stream.

Both use `advance`, so a replay through either gives the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in order, titles that start them, titles a result line may carry, lines of sub-stages.
STAGES = (
    "scan", "version", "selection", "extraction", "embeddings", "dependency", "planning", "context", "rag", "prompt", "llm", "assembly", "syntax", "dependency_verification",
    "test_generation", "differential_testing", "behavioral_verification", "semantic_equivalence", "risk_analysis",
)
STAGE_TITLES = {
    "1. REPOSITORY SCANNING": "scan", "2. PYTHON VERSION DETECTION": "version", "3. MIGRATION JOB SELECTION": "selection", "4. CODE EXTRACTION / STATIC FEATURES": "extraction",
    "5. CODEBERT EMBEDDINGS": "embeddings", "6. DEPENDENCY GRAPH": "dependency", "7. MIGRATION PLANNING": "planning", "8. REPOSITORY CONTEXT": "context",
    "9. RAG MIGRATION KNOWLEDGE RETRIEVAL": "rag", "10. FINAL LLM PROMPTS": "prompt", "LLM MIGRATION ENGINE": "llm", "REPOSITORY ASSEMBLY": "assembly",
    " - SYNTAX VERIFICATION": "syntax", " - IMPORT & DEPENDENCY VERIFICATION": "dependency_verification",
    "STAGE 5 - DIFFERENTIAL / SEMANTIC VERIFICATION": "differential_testing", "STAGE 6 - MIGRATION RISK PREDICTION": "risk_analysis",
}
RESULT_TITLES = {
    "STAGE 3 - SYNTAX VERIFICATION": "syntax", "STAGE 4 - IMPORT & DEPENDENCY VERIFICATION": "dependency_verification",
    "STAGE 5 - DIFFERENTIAL / SEMANTIC VERIFICATION": "differential_testing", "STAGE 6 - MIGRATION RISK PREDICTION": "risk_analysis",
}
PASSING = ("syntax", "dependency_verification")
SUB_STAGES = (
    (("Generating Groq cases for:", "GROQ REQUEST"), "test_generation", "running"), (("GROQ PARSED CASE COUNT:",), "test_generation", "completed"),
    (("Behavioral equivalence", "Behavioral cases"), "behavioral_verification", "running"), (("Semantic differences", "Semantic verification"), "semantic_equivalence", "running"),
)
FAILURE_SIGNS = ("[FAIL]", "Traceback", "Error:", "Exception")
TAIL = 100
STATE = "status string"


def advance(status: dict[str, str], line: str) -> None:
    """Apply one log line to a job's stage states."""
    for sign, allowed, state in (("[PASS]", PASSING, "completed"), ("[FAIL]", tuple(RESULT_TITLES.values()), "failed")):
        if sign in line:
            hit = next((s for t, s in RESULT_TITLES.items() if t in line and s in allowed), None)
            if hit:
                status[hit] = state
                return
    numbered = any(t in line for t in list(RESULT_TITLES)[:2])  # "STAGE 3 - ..." reports on a stage, any other prefix starts it
    started = next((s for t, s in STAGE_TITLES.items() if t in line and not (numbered and t.startswith(" - "))), None)
    if started:
        for earlier in STAGES[: STAGES.index(started)]:
            if status.get(earlier) != "failed":
                status[earlier] = "completed"
        status[started] = "running"
        return
    if line.startswith("[") and "] Migrating:" in line or "[SUCCESS]" in line and status.get("llm") == "running":
        status["llm"] = "running"
        return
    for signs, stage, state in SUB_STAGES:
        if any(s in line for s in signs):
            status[stage] = state


def _text(status: dict[str, str]) -> str:
    return ",".join(f"{s}={status[s]}" for s in STAGES if s in status)


def _states(text: str) -> dict[str, str]:
    return dict(x.split("=") for x in text.split(",") if x)


def finished(status: dict[str, str], ok: bool) -> dict[str, str]:
    """A job's end: what still runs fails or completes, and after a failure nothing pending will run."""
    end = "completed" if ok else "failed"
    return {s: end if status.get(s) == "running" else status.get(s, "pending" if ok else "not_completed") for s in STAGES}


def fold(lines: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("seq",), text: str = "line") -> DataFrame:
    """(job, status) after all lines of each job, in order. A job's lines are one log: a group of log size, as in the stream."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        status: dict[str, str] = {}
        for x in rows.sort_values(list(order), kind="stable")[text]:
            if x is not None:
                advance(status, x)
        return pd.DataFrame({job: [key[0]], "status": [_text(status)]})

    # only lines that can change a state need to travel
    signs = [*STAGE_TITLES, *RESULT_TITLES, "[SUCCESS]", "] Migrating:", *[s for x in SUB_STAGES for s in x[0]]]
    matters = F.lit(False)
    for s in signs:
        matters = matters | F.col(text).contains(s)
    kind = dict(lines.dtypes)[job]
    return lines.where(matters).select(job, *order, text).groupBy(job).applyInPandas(run, f"{job} {kind}, status string")


def stream(lines: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("seq",), text: str = "line") -> DataFrame:
    """The same states from a streaming DataFrame, one row for each job and micro-batch that changes it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status = _states(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches))
        for x in rows.sort_values(list(order), kind="stable")[text]:
            if x is not None:
                advance(status, x)
        state.update((_text(status),))
        yield pd.DataFrame({job: [key[0]], "status": [_text(status)]})

    kind = dict(lines.dtypes)[job]
    return lines.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, status string", STATE, "update", "NoTimeout")


def tail(lines: DataFrame, job: str, order: tuple[str, ...], n: int = TAIL) -> DataFrame:
    """The last n lines of each job."""
    w = Window.partitionBy(job).orderBy(*[F.col(o).desc() for o in order])
    return lines.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def failure_lines(lines: DataFrame, job: str, order: tuple[str, ...], text: str, n: int = 5) -> DataFrame:
    """The last n lines of each job that tell of a failure, joined in order."""
    failing = F.lit(False)
    for s in FAILURE_SIGNS:
        failing = failing | F.col(text).contains(s)
    last = tail(lines.where(failing), job, order, n)
    return last.groupBy(job).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("from_end")).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), " | ").alias("failures"))


def first_number(lines: DataFrame, job: str, order: str, text: str, pattern: str) -> DataFrame:
    """(job, number): the first group of the job's first line that matches, as a number; null where the group is none."""
    hits = lines.where(F.col(text).rlike(pattern)).groupBy(job).agg(F.min_by(text, order).alias("line"))
    return hits.select(job, F.regexp_extract("line", pattern, 1).try_cast("double").alias("number"))


def stage_counts(states: DataFrame, by: str, state: str) -> DataFrame:
    c = F.col(state)
    kinds = ("completed", "running", "failed", "pending", "not_completed")
    return states.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(c == k).alias(f"n_{k}") for k in kinds])


def tumbling(events: DataFrame, by: str, time: str, size: str, late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums by event-time window; on a stream, rows later than `late` are dropped."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(by, F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, by: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """An extension: counts by session window."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(done: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(100.0 * done, total), F.lit(0.0)), 1)
