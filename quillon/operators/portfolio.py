"""Expected loss, concentration, stress and lists of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.money import money
from quillon.operators.scorecard import rank_within

#: loss given default by market segment; any other segment has the last
LGD = (("AUTOMOBILE", 0.35), ("BUILDING", 0.25), ("FURNITURE", 0.45), ("HOUSEHOLD", 0.4), ("MACHINERY", 0.3))
LGD_OTHER = 0.45
#: name, factor of the default probability, factor of the loss given default
SCENARIOS = (("base", 1.0, 1.0), ("mild", 1.25, 1.1), ("severe", 2.0, 1.3))
#: rating, and the default probabilities from (included) and to (not included) which it reaches
BANDS = (("A", 0.0, 0.25), ("B", 0.25, 0.4), ("C", 0.4, 0.55), ("D", 0.55, 1.01))


def expected_loss(scored: DataFrame) -> DataFrame:
    """Adds lgd and loss, the product of default probability, loss given default and exposure."""
    table = scored.sparkSession.createDataFrame([*LGD], "_segment string, _lgd double")
    joined = scored.join(F.broadcast(table), scored["segment"] == F.col("_segment"), "left").withColumn("lgd", F.coalesce("_lgd", F.lit(LGD_OTHER)))
    return joined.withColumn("loss", F.round(F.col("pd") * F.col("lgd") * F.col("exposure"), 2)).drop("_segment", "_lgd")


def exposure_cube(losses: DataFrame, form: str = "cube") -> DataFrame:
    """Exposure and loss by region, segment and status with all subtotals (cube), by prefix (rollup), or by each alone and in total (sets)."""
    keys = ["region", "segment", "status"]
    amounts = [money(F.col("exposure")).alias("exposure"), money(F.col("loss")).alias("loss")]
    level = F.grouping_id().cast("long").alias("level")
    if form == "sets":
        cols = [F.col(k) for k in keys]
        return losses.groupingSets([[cols[0]], [cols[1]], [cols[2]], []], *cols).agg(*amounts, level)
    return getattr(losses, form)(*keys).agg(*amounts, level)


def concentration(base: DataFrame, k: int = 3) -> DataFrame:
    """Per region its k largest borrowers with their share of exposure, and the Herfindahl index of all its borrowers; ties by borrower. A null region is a region; one without exposure has null shares and index."""
    per = base.groupBy("region", "borrower").agg(F.sum(F.col("exposure").cast("decimal(18,2)")).cast("double").alias("exposure"))
    total = per.groupBy(F.col("region").alias("_r")).agg(F.sum(F.col("exposure").cast("decimal(18,2)")).cast("double").alias("_t"))
    share = per.join(F.broadcast(total), F.col("region").eqNullSafe(F.col("_r"))).withColumn("share", F.try_divide("exposure", "_t")).drop("_r")  # regions are few
    index = share.groupBy(F.col("region").alias("_r")).agg(F.round(F.sum(F.round(F.col("share") * F.col("share"), 15).cast("decimal(30,15)")).cast("double"), 9).alias("herfindahl"))
    top = rank_within(share, "region", [F.desc("exposure"), "borrower"], k)
    return top.join(F.broadcast(index), F.col("region").eqNullSafe(F.col("_r"))).select("region", "rank", "borrower", "exposure", F.round("share", 9).alias("share"), "herfindahl")


def stress(losses: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Loss per scenario and region; the stressed default probability stops at 1."""
    table = losses.sparkSession.createDataFrame([*scenarios], "scenario string, _p double, _l double")
    loss = F.round(F.least(F.lit(1.0), F.col("pd") * F.col("_p")) * F.least(F.lit(1.0), F.col("lgd") * F.col("_l")) * F.col("exposure"), 6)
    return losses.crossJoin(F.broadcast(table)).groupBy("scenario", "region").agg(F.sum(loss.cast("decimal(24,6)")).cast("double").alias("loss"))  # a handful of scenarios


def watchlist(before: DataFrame, after: DataFrame, paid: DataFrame) -> DataFrame:
    """Names (one column, borrower) that are new, kept or cleared between two lists, without those that have paid up; a null name never has.

    One aggregate tells on which lists a name stands, so a task holds a number per name, and no list is joined with another.
    """
    lists = [x.select("borrower", F.lit(bit).alias("_on")) for bit, x in ((1, before), (2, after), (4, paid.where("borrower IS NOT NULL")))]
    seen = lists[0].union(lists[1]).union(lists[2]).groupBy("borrower").agg(F.bit_or("_on").alias("_on"))
    move = F.when(F.col("_on") == 1, "cleared").when(F.col("_on") == 2, "new").otherwise("kept")
    return seen.where("_on < 4").select("borrower", move.alias("move"))


def risk_bands(scored: DataFrame, bands=BANDS) -> DataFrame:
    """Adds `rating` by ranges of the default probability; a probability outside all has none."""
    table = scored.sparkSession.createDataFrame([*bands], "rating string, _from double, _to double")
    return scored.join(F.broadcast(table), (F.col("pd") >= F.col("_from")) & (F.col("pd") < F.col("_to")), "left").drop("_from", "_to")


def loss_rollup(losses: DataFrame) -> DataFrame:
    """Accounts, exposure and loss by region and segment with subtotals."""
    return losses.rollup("region", "segment").agg(F.count("*").alias("accounts"), money(F.col("exposure")).alias("exposure"), money(F.col("loss")).alias("loss"), F.grouping_id().cast("long").alias("level"))


