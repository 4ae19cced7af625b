"""Writes that can be repeated."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, under the session's checkpoint folder; only where they are threads of this process (tests) may that be unset and a temporary one be taken."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = tempfile.mkdtemp(prefix="quillon-shared-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{base}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what is used more than once is made once, and outlives lost executors. The folder's owner clears it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_scores(df: DataFrame, path: str, by: str = "as_of", key: str | None = None, files: int = 1) -> None:
    """Writes scores by date; the dates of `df` replace theirs, others stay. Rows are dealt by date, so each date has few files: `files`, by a hash of `key`, where a date is too large for one task."""
    deal = [by] if key is None or files == 1 else [by, F.pmod(F.xxhash64(key), F.lit(files))]
    df.repartition(*deal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
