"""Sinks: JSON, JSON Lines, CSV, a write-once content cache, repository trees and ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_document(row: DataFrame, path: str) -> None:
    """One row as one pretty JSON document; replaces what was there."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def cache_contents(files: DataFrame, path: str) -> DataFrame:
    """Write (repo, sha, path, content) rows whose key the cache lacks; returns the rows with their reference."""
    spark = files.sparkSession
    keys = ["repo", "sha", "path"]
    named = files.dropDuplicates(keys).withColumn("reference", F.concat_ws("/", *keys))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = named.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if there else named
    new.write.mode("append").partitionBy("repo", "sha").parquet(path)
    return named


def materialise(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as a tree below a folder (a URI all executors reach); safe to run again."""

    def run(rows: Iterator) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for r in rows:
            if r.path.startswith("/") or ".." in r.path.split("/"):
                raise ValueError(f"unsafe path {r.path}")
            target = f"{base}/{r.path}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write((r.content or "").encode())

    files.select("path", "content").foreachPartition(run)


def zipped(files: DataFrame, by: str = "repo") -> DataFrame:
    """(repo, archive): one ZIP for each repository; a repository is the unit that one task holds."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.sort_values("path").itertuples():
                z.writestr(zipfile.ZipInfo(r.path), r.content or "")
        return pd.DataFrame({by: [key[0]], "archive": [out.getvalue()]})

    return files.select(by, "path", "content").groupBy(by).applyInPandas(run, f"{by} string, archive binary")
