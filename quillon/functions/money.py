"""Column functions shared by the jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def money(c: Column) -> Column:
    """A sum of money that doesn't depend on the order of its terms."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so (Spark takes no notice of case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def points(pd: Column, offset: float = 500.0, to_double: float = 20.0) -> Column:
    """Score points: `to_double` points double the odds of being good. A probability of 0 or 1 has no finite odds, so no points (null)."""
    return F.lit(offset) + F.lit(to_double / math.log(2)) * F.log(F.when(pd < 1.0, F.try_divide(1.0 - pd, pd)))


#: accuracy of the sketches, and how far from a share, in units of their error, its bracket reaches
ACCURACY, MARGIN = 10_000, 4


def discrete_cuts(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per group (all rows, without `by`) the least values at which shares of the rows with a value are reached, as the array `cuts`. The column holds numbers, dates or times.

    A first pass takes from a sketch a bracket of values around each cut, which holds less than a thousandth of the rows. A second counts the rows between the brackets as a whole
    and those in a bracket per value; only the values of one bracket are then put in order, so no task sees all of them. Raises if a cut isn't in its bracket, which the
    sketch's error rules out. `approx` takes the cuts from the sketch: one pass, ranks off by at most one in 10,000.
    """
    by, known = by or [], df.where(F.col(column).isNotNull())
    if approx:
        return known.groupBy(*by).agg(F.percentile_approx(column, [float(p) for p in shares], ACCURACY).alias("cuts"))
    keys = [f"_k{i}" for i in range(len(by))]
    order = sorted(range(len(shares)), key=lambda i: shares[i])
    n, goals = len(shares), [float(shares[i]) for i in order]
    rows = known.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(column).alias("_v"))
    wide = MARGIN / ACCURACY
    ends = [max(0.0, g - wide) for g in goals] + [min(1.0, g + wide) for g in goals]
    brackets = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    low, high = (lambda i: F.col("_e")[i]), (lambda i: F.col("_e")[n + i])
    met = _null_safe(rows, brackets, keys)
    inside, gap = F.lit(False), F.lit(0)
    for i in range(n):
        inside |= (F.col("_v") >= low(i)) & (F.col("_v") <= high(i))
        gap += (F.col("_v") > high(i)).cast("int")
    cells = met.groupBy(*keys, F.when(inside, F.col("_v")).alias("_x"), F.when(~inside, gap).alias("_g")).agg(F.count("*").alias("_n"), F.max("_v").alias("_v"))
    placed = _null_safe(cells.select(*keys, "_v", "_n"), brackets, keys)
    below = [F.sum(F.when(F.col("_v") < low(i), F.col("_n")).otherwise(0)) for i in range(n)]
    totals = placed.groupBy(*keys).agg(F.array(*below).alias("_below"), F.sum("_n").alias("_all"))
    which = F.filter(F.array(*[F.when((F.col("_v") >= low(i)) & (F.col("_v") <= high(i)), F.lit(i)) for i in range(n)]), lambda i: i.isNotNull())
    held = _null_safe(placed.select(*keys, "_v", "_n", F.explode(which).alias("_i")), totals, keys)
    run = F.element_at("_below", F.col("_i") + 1) + F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    goal = F.element_at(F.array(*map(F.lit, goals)), F.col("_i") + 1) * F.col("_all")
    found = held.withColumns({"_run": run, "_goal": goal}).groupBy(*keys, "_i").agg(F.min(F.when(F.col("_run") >= F.col("_goal"), F.col("_v"))).alias("_c"), F.first("_goal").alias("_goal"), F.first(F.element_at("_below", F.col("_i") + 1)).alias("_b"))
    missed = F.col("_c").isNull() | ((F.col("_b") > 0) & (F.col("_b") >= F.col("_goal")))
    cut = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast(dict(rows.dtypes)["_v"])).otherwise(F.col("_c"))
    back = [order.index(i) for i in range(n)]
    names = [F.col(k).alias(c) for c, k in zip(by, keys)]
    return found.withColumn("_c", cut).groupBy(*names).agg(F.array(*[F.min(F.when(F.col("_i") == i, F.col("_c"))) for i in back]).alias("cuts"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each left row with its group's one right row; without keys that is a table of one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    met = F.lit(True)
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return left.join(other, met).drop(*[f"{k}_" for k in keys])


def bin_of(column: str, cuts: Column) -> Column:
    """1 and the number of cuts below a value; a value at a cut is in the lower bin, a null in bin 0."""
    return F.when(F.col(column).isNull(), 0).otherwise(1 + F.size(F.filter(cuts, lambda c: c < F.col(column)))).cast("long")
