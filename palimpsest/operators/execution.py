"""Execution as a boundary: runs are recorded by a runner that the caller plugs in; nothing is executed here.

A runner is a function from one job (a dict of its columns) to (return_code, stdout, stderr,
timed_out). Its results become columns, and every verdict is derived from the recorded columns, so
results recorded elsewhere serve as well as those of a runner.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RECORDED = "return_code int, stdout string, stderr string, timed_out boolean"
#: Return codes of a run that didn't end, of no tests, and of tests of no known framework.
TIMED_OUT, NO_TESTS, UNKNOWN_FRAMEWORK = -1, 0, 2


def recorded(jobs: DataFrame, runner: Callable[[dict], tuple]) -> DataFrame:
    """jobs with what the runner recorded of each; an exception of the runner is that job's failure only."""
    names = [*jobs.columns, "return_code", "stdout", "stderr", "timed_out"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job in batch.to_dict("records"):
                try:
                    result = tuple(runner(job))
                except Exception as e:
                    result = (1, "", f"{type(e).__name__}: {e}", False)
                out.append((*job.values(), *result))
            yield pd.DataFrame(out, columns=names)

    return jobs.mapInPandas(run, T.StructType([*jobs.schema.fields, *T.StructType.fromDDL(RECORDED).fields]))


def call_status(return_code: Column, result: Column, timed_out: Column) -> Column:
    """The status of one differential call: its result line tells of a value or of an exception."""
    said = F.get_json_object(result, "$.status")
    return (
        F.when(F.coalesce(timed_out, F.lit(False)), "TIMEOUT")
        .when(F.coalesce(return_code, F.lit(1)) != 0, "EXECUTION_FAILED")
        .when(said == "ok", "SUCCESS").when(said == "exception", "EXCEPTION").otherwise("EXECUTION_FAILED")
    )


def suite_code(framework: Column, return_code: Column, timed_out: Column) -> Column:
    """The return code of a repository's tests by framework (none, pytest, unittest, unknown)."""
    known = F.when(F.coalesce(timed_out, F.lit(False)), TIMED_OUT).otherwise(return_code)
    return F.when(framework == "none", NO_TESTS).when(framework.isin("pytest", "unittest"), known).otherwise(UNKNOWN_FRAMEWORK).cast("int")


def same_tests(original: DataFrame, migrated: DataFrame, key: str = "test") -> DataFrame:
    """(key, original_status, migrated_status, equivalent): one suite on both trees; equal only where both pass."""
    status = F.when(F.col("return_code") == 0, "PASS").otherwise("FAIL")
    left, right = (df.select(key, status.alias(f"{side}_status")) for df, side in ((original, "original"), (migrated, "migrated")))
    both = left.join(right, key, "full").fillna("FAIL", ["original_status", "migrated_status"])
    return both.withColumn("equivalent", (F.col("original_status") == "PASS") & (F.col("migrated_status") == "PASS"))


def tagged(value, open_: tuple[int, ...] = ()):
    """A value as JSON can hold it: containers that JSON lacks carry a type tag, unordered ones are sorted by their JSON text, cycles are marked."""
    if value is None or isinstance(value, (bool, str, int, float)):
        return value
    kind = {"__type__": type(value).__name__}
    if isinstance(value, bytearray):
        try:
            return kind | {"value": value.decode("utf-8")}
        except UnicodeDecodeError:
            return kind
    if id(value) in open_:
        return kind | {"__recursive__": True}
    inner = lambda x: tagged(x, (*open_, id(value)))
    text = lambda x: json.dumps(x, sort_keys=True, default=str)
    match value:
        case list():
            return [inner(x) for x in value]
        case tuple():
            return {"__type__": "tuple", "items": [inner(x) for x in value]}
        case dict():
            return {"__type__": "dict", "items": sorted(([inner(k), inner(v)] for k, v in value.items()), key=lambda pair: text(pair[0]))}
        case set():
            return {"__type__": "set", "items": sorted(map(inner, value), key=text)}
    return kind | {"attributes": inner(vars(value))} if hasattr(value, "__dict__") else kind


@pandas_udf(T.StringType())
def tagged_literal(source: pd.Series) -> pd.Series:
    """The tagged JSON of a Python literal's text (read as data, never executed); null for what is no literal."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(tagged(ast.literal_eval(x)), sort_keys=True)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return source.map(one)
