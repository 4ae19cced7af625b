"""Default labels and delinquency."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGES = (0, 30, 60, 90, 365)


def default_label(lineitem: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per account with lines: bad is 1 when at least a share `threshold` of its lines is missed. Compared in integers, the threshold as a fraction of thousandths at most."""
    share = Fraction(threshold).limit_denominator(1000)
    missed = F.count_if(F.col("l_returnflag") == "R")
    bad = F.when(missed * share.denominator >= F.count("*") * share.numerator, 1).otherwise(0).cast("long")
    return lineitem.groupBy(F.col("l_orderkey").alias("account")).agg(F.count("*").alias("lines"), missed.alias("missed"), bad.alias("bad"))


def delinquency_bucket(lines: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """Adds days_late, floored at 0, and bucket, the number of edges that are below it."""
    late = F.greatest(F.lit(0), F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).cast("long")
    bucket = F.lit(0)
    for k, edge in enumerate(edges, 1):
        bucket = F.when(F.col("days_late") > edge, F.lit(k)).otherwise(bucket)
    return lines.withColumn("days_late", late).withColumn("bucket", bucket.cast("long"))


def roll_rates(lines: DataFrame) -> DataFrame:
    """Moves of a borrower's state from one posting day to its next: before, after, n, share of before. A day is missed if any of its lines is."""
    days = lines.groupBy("o_custkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("missed"))
    moves = days.select(F.lag("missed").over(Window.partitionBy("o_custkey").orderBy("day")).alias("before"), F.col("missed").alias("after")).where("before IS NOT NULL")
    counts = moves.groupBy("before", "after").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("before")), 6))


def vintage_curve(lines: DataFrame, ages: int = 7) -> DataFrame:
    """Per quarter of opening and age in whole years, floored at 0: accounts, those with a missed line by then, and their share.

    `lines` holds account lines with o_orderkey, o_orderdate, l_shipdate and l_returnflag. Ages from 0 to `ages` - 1, or to
    the last age at which an account first misses a line if that is later, have a row in each quarter.
    """
    age = F.greatest(F.lit(0), F.floor(F.months_between(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) / 12)).cast("long")
    first = lines.groupBy("o_orderkey", F.date_trunc("quarter", F.col("o_orderdate")).cast("date").cast("string").alias("quarter")).agg(F.min(F.when(F.col("l_returnflag") == "R", age)).alias("age"))
    totals = first.groupBy("quarter").agg(F.count("*").alias("accounts"))
    last = first.agg(F.greatest(F.lit(ages - 1).cast("long"), F.max("age")).alias("last"))  # one row
    grid = totals.crossJoin(F.broadcast(last)).withColumn("age", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    missed = first.where("age IS NOT NULL").groupBy("quarter", "age").agg(F.count("*").alias("m"))
    w = Window.partitionBy("quarter").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.coalesce("m", F.lit(0))).over(w)
    return grid.join(missed, ["quarter", "age"], "left").select("quarter", "age", "accounts", cum.alias("missed_by"), F.round(cum / F.col("accounts"), 6).alias("missed_share"))
