"""Cutting lineage in loops: reliable checkpoints in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder (spark.checkpoint.dir; our own only where it is unset and there is one machine)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint()
