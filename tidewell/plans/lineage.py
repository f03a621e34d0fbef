"""Cutting lineage safely."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set a temporary folder serves, but only if all runs in this
    process: on a cluster other machines couldn't read it."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if shared is None and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp("-checkpoints"))
    return shared or sc.getCheckpointDir()
