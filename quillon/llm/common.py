"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A run of anything but ASCII white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: short rows of a table that one task writes
ROWS_A_FILE = 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def named(name: str) -> Column:
    """A column as a string without nulls, in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def md5_int(value: Column, digits: int = 8) -> Column:
    """The first hex digits of the md5 of a value's string as a long: an even spread that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def fan_out(rows: int) -> int:
    """How many buckets keep both the rows of a bucket and the buckets of a group near the square root of the rows."""
    return max(1, math.isqrt(max(rows, 1)))


def offsets(counts: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same group that stand earlier."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or that its context was given. All executors must reach it: only where they are threads of this process (tests) is one made up."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="quillon-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return folder


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    It outlives lost executors, is read by column, and later plans show a scan instead of all that made it. The folder's owner
    clears it when the job is done.
    """
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As written, with the table's path, for `cleared`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written_short(df: DataFrame, rows: int) -> DataFrame:
    """As written, for a table of about so many rows of a few numbers: as many tasks write it as its rows need, whatever the number of shuffle partitions.

    On a local folder Hadoop starts three processes (chmod) for each file that a task writes, so a small table in hundreds of files takes time and memory for nothing.
    """
    return written(df.coalesce(max(1, -(-rows // ROWS_A_FILE))))


def in_order(df: DataFrame, order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row in the order of all, from 0, as `at`, and per column of `sums` its sum over earlier rows as `before_<column>`.

    Rows are sorted by ranges and written with their places inside the ranges; one count and one sum per range and column go through one task. `order` leaves no ties.
    """
    rows = written(df.sort(*order).withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_place", 33))  # the sorted partition
    per = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *[f"_s_{c}" for c in sums])])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumns({"_k": F.row_number().over(Window.partitionBy("_range").orderBy("_place")) - 1, **{f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}})
    placed = run.join(F.broadcast(starts), "_range")  # a row per sorted partition
    return placed.select(*df.columns, (F.col("_n") + F.col("_k")).alias("at"), *[(F.col(f"_s_{c}") + F.col(f"before_{c}")).alias(f"before_{c}") for c in sums])


def cleared(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
