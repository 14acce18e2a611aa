"""Sources: repository trees, JSON and CSV files, ZIP uploads, and an offline pull-request source."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.paths import SCAN_EXCLUDES, excluded

# Folders that the other walks leave out.
PYTHON_EXCLUDES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".nox", "site-packages",
)
ASSEMBLY_EXCLUDES = (".git", "__pycache__", ".venv", "venv", "node_modules", ".pytest_cache")
PAIR_COLUMNS = ("id", "original_code", "migrated_code", "label", "split")


def repository(spark: SparkSession, root: str, excludes: tuple[str, ...] = SCAN_EXCLUDES, fold: bool = False, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, size_bytes) of the files below a folder; bytes that are no UTF-8 are dropped, names are tested before any content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), rf"^.*?\Q{base}\E/", "")
    named = raw.select(path.alias("path"), "content", F.col("length").alias("size_bytes")).where(~excluded(F.col("path"), excludes, fold))
    if suffixes:
        test = F.lit(False)
        for s in suffixes:
            test = test | F.lower("path").endswith(s)
        named = named.where(test)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], names=["path", "content", "size_bytes"])

    return named.mapInArrow(decoded, "path string, content string, size_bytes long")


def structure(files: DataFrame) -> DataFrame:
    """One sorted list of all paths."""
    return files.agg(F.array_sort(F.collect_list("path")).alias("paths"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON Lines file, and its malformed lines; blank lines and a byte order mark are no rows."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    fields = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    rows = text.select("line", F.from_json("line", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | ~F.ltrim("line").startswith("{")
    return rows.where(~bad).select("r.*").drop("_bad"), rows.where(bad).select("line")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document as a row; no row of the schema where the file is missing or broken."""
    empty = spark.createDataFrame([], schema)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return empty
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.StructType.fromDDL(schema), {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.col("r").isNotNull()).select("r.*")


def function_records(document: Column) -> Column:
    """Records (JSON texts) of a list, of .functions or of .function_records that have original_code."""
    of = lambda path: F.from_json(F.get_json_object(document, path), "array<string>")
    whole = F.when(F.ltrim(document).startswith("["), F.from_json(document, "array<string>"))
    found = F.coalesce(whole, of("$.functions"), of("$.function_records"), F.raise_error(F.lit("no function records")).cast("array<string>"))
    return F.filter(found, lambda x: F.get_json_object(x, "$.original_code").isNotNull())


def labelled_pairs(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split of a labelled CSV file; fails on missing columns, unknown labels or an empty split."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := set(PAIR_COLUMNS) - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    known = rows.where(F.col("split") == split)
    if known.where(~F.col("label").isin("equivalent", "not_equivalent")).limit(1).count():
        raise ValueError("unknown label")
    if not known.limit(1).count():
        raise ValueError(f"no rows of split {split}")
    return known


def unzipped(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(archive, path, content) of every file in ZIP archives; absolute and parent paths are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for archive, data in zip(b[name], b[content], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        path = m.filename.replace("\\", "/")
                        if m.is_dir() or path.startswith("__MACOSX/"):
                            continue
                        if path.startswith("/") or ".." in path.split("/") or (len(path) > 1 and path[1] == ":"):
                            raise ValueError(f"unsafe member {m.filename}")
                        out.append((os.path.basename(archive), path, z.read(m)))
            yield pd.DataFrame(out, columns=["archive", "path", "content"])

    return archives.select(name, content).mapInPandas(run, "archive string, path string, content binary")


def unrooted(files: DataFrame) -> DataFrame:
    """Unzipped files without their archive's only top folder, if it has just one."""
    top = F.substring_index("path", "/", 1)
    one = files.groupBy("archive").agg(F.countDistinct(top).alias("n"), F.min(top).alias("top"), F.min(F.instr("path", "/")).alias("slash"))
    lone = (F.col("n") == 1) & (F.col("slash") > 0)
    return files.join(one, "archive").withColumn("path", F.when(lone, F.expr("substring(path, length(top) + 2)")).otherwise(F.col("path"))).drop("n", "top", "slash")


class PullRequestSource(DataSource):
    """Pull requests, their files and contents from recorded pages: option `path` is a folder of page-N.json files.

    Each page is a list of {repo, pr_number, pr_title, base_sha, head_sha, path, encoding, content};
    pages are read in order until an empty one or `pages`, and content that is no strict UTF-8 is null.
    """

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return "repo string, pr_number long, pr_title string, base_sha string, head_sha string, path string, content string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PullRequestReader(self.options)


class _PullRequestReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.pages = options["path"], int(options.get("pages", "5"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import base64

        file = os.path.join(self.folder, f"page-{partition.value}.json")
        if not os.path.exists(file):
            return
        with open(file, encoding="utf-8") as f:
            rows = json.load(f)
        for r in rows:
            content = r.get("content")
            if content is not None and r.get("encoding") == "base64":
                try:
                    content = base64.b64decode(content).decode("utf-8")
                except ValueError:
                    content = None
            yield (r.get("repo"), r.get("pr_number"), r.get("pr_title"), r.get("base_sha"), r.get("head_sha"), r.get("path"), content)
