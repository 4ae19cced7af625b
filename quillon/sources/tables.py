"""Typed reads of the credit tables, and permissive reads of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: columns and types of each table
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
BAD_ROW = "_bad_row"


def read_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table by its declared schema. CSV and JSON keep rows that don't fit, as text in `_bad_row` with the fields that could be read."""
    if fmt == "parquet":
        return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")
    reader = spark.read.schema(f"{SCHEMAS[name]}, {BAD_ROW} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW)
    path = f"{directory}/{name}.{fmt}"
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


#: files of a batch
PER_TRIGGER = 1000


def read_stream(spark: SparkSession, directory: str, name: str, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """A table as a stream of its files, at most `per_trigger` a batch."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", per_trigger)
    # a pattern, so that the table may be a file or a folder
    return reader.parquet(f"{directory}/{name}.parque[t]")


def event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone should be UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))
