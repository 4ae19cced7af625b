"""How well scores rank and fit. All start from counts per score at 6 decimals, at most a million, which are put in order range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.scorecard import RANGES, binned_counts
from quillon.sources.sinks import written


#: least and greatest score
ENDS = (0.0, 1.0)


def per_score(scored: DataFrame, score: str = "pd", label: str = "bad") -> DataFrame:
    return scored.groupBy(F.round(score, 6).alias("score")).agg(F.count_if(F.col(label) == 0).alias("g"), F.count_if(F.col(label) == 1).alias("b"))


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pd", F.round("pd", 6))


def _running(scored: DataFrame) -> DataFrame:
    """Counts per score with those up to it, `cg` and `cb`, and of all. Scores are dealt to ranges of equal width: a running sum over one sum per range, then inside each range."""
    counts = written(per_score(scored)).withColumn("_r", F.coalesce(F.floor(F.col("score") * RANGES), F.lit(-1)))
    per = counts.groupBy("_r").agg(F.sum("g").alias("_g"), F.sum("b").alias("_b"))  # RANGES + 2 rows at most, as scores lie between 0 and 1
    before, every = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    below = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_g", "_b")]
    starts = per.select("_r", *below, F.sum("_g").over(every).alias("goods"), F.sum("_b").over(every).alias("bads"))
    w = Window.partitionBy("_r").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"cg": F.sum("g").over(w), "cb": F.sum("b").over(w)}).join(F.broadcast(starts), "_r")
    return run.select("score", "g", "b", (F.col("cg") + F.col("_before_g")).alias("cg"), (F.col("cb") + F.col("_before_b")).alias("cb"), "goods", "bads")


def auc_gini(scored: DataFrame) -> DataFrame:
    """One row: rank probability that a bad account scores above a good one (ties count half), and 2 AUC - 1; null if a class is missing."""
    area = F.sum(F.col("b") * (F.col("cg") - F.col("g") / 2)) / F.max(F.when((F.col("goods") > 0) & (F.col("bads") > 0), F.col("goods") * F.col("bads")))
    return _running(scored).agg(area.alias("a")).select(F.round("a", 6).alias("auc"), F.round(2 * F.col("a") - 1, 6).alias("gini"))


def ks(scored: DataFrame) -> DataFrame:
    """One row: the largest gap between the cumulative shares of good and bad accounts, and the lowest score where it is reached."""
    gap = F.round(F.abs(F.try_divide("cg", "goods") - F.try_divide("cb", "bads")), 9)
    best = _running(scored).agg(F.max(F.struct(gap.alias("gap"), (-F.col("score")).alias("s"))).alias("m"))
    return best.select(F.round("m.gap", 6).alias("ks"), (-F.col("m.s")).alias("score"))


def gains_table(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per score bin, 1 the lowest: accounts, bads, bad rate, share of all bads in it and the higher ones, and lift. Null scores are left out; without bads capture and lift are null."""
    per = binned_counts(_rounded(scored), "pd", n, {"bads": F.sum("bad")}, ends=ENDS).withColumnRenamed("n", "accounts")
    every, down = Window.partitionBy(), Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("bads") / F.col("accounts")
    return per.select("bin", "accounts", "bads", F.round(rate, 6).alias("bad_rate"), F.round(F.try_divide(F.sum("bads").over(down), F.sum("bads").over(every)), 6).alias("capture"), F.round(F.try_divide(rate, F.sum("bads").over(every) / F.sum("accounts").over(every)), 6).alias("lift"))


def confusion(scored: DataFrame, thresholds: DataFrame, missed_cost: float = 5.0) -> DataFrame:
    """Per threshold: counts of the four outcomes, precision, recall, F1 and cost. Each score is compared once per threshold, of which there are few."""
    up = F.col("score") >= F.col("threshold")
    counts = per_score(scored).crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(*[F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0)).alias(n) for n, c, k in (("tp", up, "b"), ("fp", up, "g"), ("fn", ~up, "b"), ("tn", ~up, "g"))])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.select("threshold", "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"), (F.col("fp") + F.lit(missed_cost) * F.col("fn")).alias("cost"))


def calibration(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per score bin: accounts, mean score and bad rate; and for all rows the Brier score and the Hosmer-Lemeshow sum. Null scores are left out; a bin of mean score 0 or 1 expects no variance and adds nothing to the sum, which is null where all bins are such."""
    square = (F.col("pd") - F.col("bad")) * (F.col("pd") - F.col("bad"))
    sums = {"p": F.sum(F.col("pd").cast("decimal(18,6)")), "b": F.sum("bad"), "s": F.sum(F.round(square, 12).cast("decimal(24,12)"))}
    per = binned_counts(_rounded(scored), "pd", n, sums, ends=ENDS).withColumns({"p": F.col("p").cast("double"), "s": F.col("s").cast("double")})
    every = Window.partitionBy()
    hl = F.try_divide((F.col("b") - F.col("p")) * (F.col("b") - F.col("p")), F.col("p") * (1 - F.col("p") / F.col("n")))
    return per.select("bin", F.col("n").alias("accounts"), F.round(F.col("p") / F.col("n"), 6).alias("mean_pd"), F.round(F.col("b") / F.col("n"), 6).alias("bad_rate"), F.round(F.sum("s").over(every) / F.sum("n").over(every), 6).alias("brier"), F.round(F.sum(hl).over(every), 4).alias("hosmer_lemeshow"))


def psi(scored: DataFrame, period: str, base: str, n: int = 10, floor: float = 1e-4) -> DataFrame:
    """Per period: the population stability index of its scores against the base period's, over bins of all scores; shares have a floor. Rows without a period are a period (null), null scores are left out; without rows in the base period the index is null."""
    counts = binned_counts(_rounded(scored), "pd", n, {}, [period], ENDS).withColumnRenamed(period, "_p")
    share = counts.select("_p", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("_p"))).alias("share"))
    expected = share.where(F.col("_p") == base).select(F.col("bin").alias("_b"), F.col("share").alias("e"))
    there = expected.agg((F.count("*") > 0).alias("_there"))
    bins = counts.select("bin").distinct()  # n at most
    grid = share.select(F.col("_p").alias("_q")).distinct().crossJoin(F.broadcast(bins.select(F.col("bin").alias("_b")))).crossJoin(F.broadcast(there))
    both = grid.join(share, F.col("_q").eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("bin")), "left").join(expected, "_b", "left")
    a, e = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor))
    return both.groupBy(F.col("_q").alias(period)).agg(F.round(F.sum(F.when(F.col("_there"), (a - e) * F.log(a / e))), 6).alias("psi"))


def segment_outliers(labelled: DataFrame, by: list[str], z: float = 1.0) -> DataFrame:
    """Segments (nulls are segments) whose bad rate lies more than z sample deviations of the segments' rates from the portfolio's. Where all segments have one rate, or there is one segment, none is."""
    per = labelled.groupBy(*by).agg(F.count("*").alias("n"), F.sum("bad").alias("b")).withColumn("rate", F.col("b") / F.col("n"))
    every = Window.partitionBy()
    score = F.try_divide(F.col("rate") - F.sum("b").over(every) / F.sum("n").over(every), F.stddev_samp("rate").over(every))
    return per.withColumn("z", score).where(F.abs("z") > z).select(*by, F.round("rate", 6).alias("bad_rate"), F.round("z", 4).alias("z"))
