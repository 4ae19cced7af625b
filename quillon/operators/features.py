"""Accounts, borrowers and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.money import discrete_cuts, money, unused
from quillon.sources.sinks import written


def account_base(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """One row per account with its borrower and geography. Nations and regions are fixed small tables; accounts and borrowers meet by the borrower's key."""
    place = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    who = customer.join(F.broadcast(place), customer["c_nationkey"] == place["n_nationkey"])
    out = orders.join(who, orders["o_custkey"] == who["c_custkey"])
    return out.select(F.col("o_orderkey").alias("account"), F.col("c_custkey").alias("borrower"), F.col("o_totalprice").alias("exposure"), F.col("o_orderdate").alias("opened"), F.col("o_orderstatus").alias("status"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def borrower_features(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per borrower: accounts, exposure, mean exposure, missed share of its lines (null without lines) and accounts by status. Lines are summed per account before the join."""
    lines = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("missed"))
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    return joined.groupBy(F.col("o_custkey").alias("borrower")).agg(
        F.count("*").alias("accounts"),
        money(F.col("o_totalprice")).alias("exposure"),
        F.round(money(F.col("o_totalprice")) / F.count("*"), 6).alias("mean_exposure"),
        F.round(F.sum("missed") / F.sum("lines"), 6).alias("missed_share"),
        *[F.count_if(F.col("o_orderstatus") == s).alias(f"accounts_{s.lower()}") for s in ("F", "O", "P")],
    )


#: a key with more than this part of all rows is hot; its rows are dealt to as many ranges of time
HOT = 64


def hot_keys(keys: DataFrame, key: str, time: str, parts: int = HOT) -> DataFrame | None:
    """The keys that have more than one in `parts` of the rows, so fewer than `parts`, as a table (`_hot`, `_edges`: times that cut the key's rows into about `parts` equal ranges); None if there are none."""
    counts = keys.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= max(total / parts, parts):
        return None
    hot = counts.where(F.col("_n") > max(total / parts, parts)).select("_hot").collect()
    named = keys.sparkSession.createDataFrame(hot, counts.select("_hot").schema)
    rows = keys.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("_hot")))
    shares = [i / parts for i in range(1, parts)]
    return written(rows.groupBy("_hot").agg(F.coalesce(F.percentile_approx(time, shares), F.array().cast(f"array<{dict(keys.dtypes)[time]}>")).alias("_edges")))


def in_ranges(df: DataFrame, key: str, time: str, hot: DataFrame | None) -> DataFrame:
    """Adds `_r`: for rows of a hot key their range of time, in order (0 for a null time), else 0."""
    if hot is None:
        return df.withColumn("_r", F.lit(0))
    at = F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col(time))), F.lit(0))
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_r", F.when(F.col("_edges").isNull() | F.col(time).isNull(), F.lit(0)).otherwise(at)).drop("_hot", "_edges")


def velocity(orders: DataFrame, days: int = 90) -> DataFrame:
    """Per account: the borrower's accounts and exposure opened in the days up to it, same-time accounts included.

    A null borrower is a borrower; accounts without an opening date count each other. The accounts of a hot borrower (see HOT) are dealt to cells of twice `days`, and those of a cell's last `days` are
    copied into the next as a halo, which is counted there but not returned, so that its accounts are the work of many tasks.
    """
    day, cell = F.unix_date(F.col("o_orderdate").cast("date")), 2 * int(days)
    hot = hot_keys(orders.select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")
    rows = orders.select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("_money"))
    if hot is None:
        dealt = rows.withColumns({"_own": F.lit(0), "_cell": F.lit(0)})
    else:
        split = rows.join(F.broadcast(hot.select("_hot", F.lit(True).alias("_many"))), F.col("o_custkey").eqNullSafe(F.col("_hot")), "left")
        own = F.when(F.col("_many"), F.floor(day / cell)).otherwise(F.lit(0))
        # days are whole here, so the halo is one wider
        later = F.when(F.col("_many") & (day + int(days) + 1 >= (own + 1) * cell), F.array(own, own + 1)).otherwise(F.array(own))
        dealt = split.withColumn("_own", own).withColumn("_cell", F.explode(later))
    w = f"(PARTITION BY o_custkey, _cell ORDER BY o_orderdate RANGE BETWEEN INTERVAL {int(days)} DAYS PRECEDING AND CURRENT ROW)"
    counted = dealt.select(F.col("o_orderkey").alias("account"), F.expr(f"count(*) OVER {w}").alias("opened"), F.expr(f"CAST(sum(_money) OVER {w} AS double)").alias("opened_exposure"), "_own", "_cell")
    return counted.where(F.col("_cell").eqNullSafe(F.col("_own"))).select("account", "opened", "opened_exposure")


def recency(orders: DataFrame) -> DataFrame:
    """Per account: its number in the borrower's order of opening and the days since the account before (null for the first). A null borrower is a borrower, and null dates come first.

    The accounts of a hot borrower are numbered within ranges of time; a range starts from the number and the last date of those before it.
    """
    rows = orders.select("o_custkey", "o_orderkey", "o_orderdate")
    hot = hot_keys(rows, "o_custkey", "o_orderdate")
    dealt = in_ranges(rows, "o_custkey", "o_orderdate", hot)
    w = Window.partitionBy("o_custkey", "_r").orderBy("o_orderdate", "o_orderkey")
    numbered = dealt.withColumns({"_i": F.row_number().over(w), "_date": F.lag("o_orderdate").over(w)})
    if hot is None:
        numbered = numbered.withColumn("_before", F.lit(0))
    else:
        mine = dealt.join(F.broadcast(hot.select("_hot")), F.col("o_custkey").eqNullSafe(F.col("_hot")))
        per = mine.groupBy(F.col("_hot").alias("_k"), F.col("_r").alias("_s")).agg(F.count("*").alias("_n"), F.max("o_orderdate").alias("_last"))
        earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        start = per.select("_k", "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.max("_last").over(earlier).alias("_end"))  # HOT * HOT rows at most
        joined = numbered.join(F.broadcast(start), F.col("o_custkey").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_s")), "left")
        numbered = joined.withColumns({"_before": F.coalesce("_start", F.lit(0)), "_date": F.when(F.col("_i") > 1, F.col("_date")).otherwise(F.col("_end"))})
    return numbered.select(F.col("o_orderkey").alias("account"), (F.col("_before") + F.col("_i")).cast("long").alias("sequence"), F.datediff(F.col("o_orderdate").cast("date"), F.col("_date").cast("date")).cast("long").alias("days_since"))


def asof_features(left: DataFrame, right: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (of equal times the greatest `tie`); right columns are null if there is none.

    A null key meets nothing, nor does a null time on either side; such left rows stay. A right column that has the name of a left one comes as `<name>_right`.

    Both sides are put under one another and the last right row is carried forward, so each side moves once and no range of pairs arises; rows are sorted, not held. The rows of a
    hot key (see HOT, counted over both sides) are dealt to ranges of time, and where a range has no right row yet, the last one of the key's ranges before holds, from one row per hot key and range. So such a
    key is the work of many tasks, unless its rows have one time.
    """
    names = {c: c if c not in left.columns else unused(left, f"{c}_right") for c in right.columns if c not in (key, time)}
    values = [F.col(c).alias(n) for c, n in names.items()] + [F.col(time).alias(f"asof_{time}")]
    k, t = F.col(key).alias("_k"), F.col(time).alias("_t")
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    row = F.struct(*[F.col(c) for c in left.columns])
    b = right.where(placed).select(k, t, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.select(row.alias("s")).schema["s"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    none = F.lit(None).cast(b.schema["_right"].dataType).alias("_right")
    # rows without key or time need no partner, and no partition of their own
    a = left.where(placed).select(k, t, F.lit(1).alias("_side"), F.lit(None).cast(b.schema["_tie"].dataType).alias("_tie"), row.alias("_left"), none)
    hot = hot_keys(a.select("_k", "_t").unionByName(b.select("_k", "_t")), "_k", "_t")
    both = in_ranges(a.unionByName(b), "_k", "_t", hot)
    w = Window.partitionBy("_k", "_r").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1").select("_k", "_r", "_left", "_right")
    if hot is not None:
        few = in_ranges(b.join(F.broadcast(hot.select(F.col("_hot").alias("_h"))), F.col("_k") == F.col("_h")), "_k", "_t", hot)
        last = few.groupBy("_k", "_r").agg(F.max_by("_right", F.struct("_t", "_tie")).alias("_last"))
        grid = hot.select(F.col("_hot").alias("_k"), F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_r"))  # HOT * HOT rows at most
        earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        before = grid.join(last, ["_k", "_r"], "left").select("_k", "_r", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
        found = found.join(F.broadcast(before), ["_k", "_r"], "left").withColumn("_right", F.coalesce("_right", "_before"))
    return found.select("_left", "_right").unionByName(left.where(~placed).select(row.alias("_left"), none)).select("_left.*", "_right.*")


def status_pivot(base: DataFrame, statuses: tuple[str, ...] = ("F", "O", "P")) -> DataFrame:
    """Exposure per borrower, a column per status, 0 for none."""
    out = base.groupBy("borrower").pivot("status", list(statuses)).agg(F.sum(F.col("exposure").cast("decimal(18,2)")))
    return out.select("borrower", *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(f"exposure_{s.lower()}") for s in statuses])


def winsorise(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, approx: bool = False) -> DataFrame:
    """Clamps a column to two of its discrete quantiles, as `<column>_w`. Nulls stay. `approx` takes the quantiles from a sketch."""
    name = unused(df, "_cuts")
    cuts = discrete_cuts(df, column, [low, high], approx=approx).withColumnRenamed("cuts", name)
    clamped = F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.col(name)[1]), F.col(name)[0]))
    return df.crossJoin(F.broadcast(cuts)).withColumn(f"{column}_w", clamped).drop(name)  # cuts: one row


def impute(df: DataFrame, column: str, by: str, approx: bool = False) -> DataFrame:
    """Fills nulls with the discrete median of the row's group, with a flag `<column>_missing`. A null group is a group; one without values stays null. `approx` takes the medians from sketches."""
    name = unused(df, "_median")
    medians = discrete_cuts(df, column, [0.5], [by], approx).select(by, F.col("cuts")[0].alias(name))
    joined = df.alias("d").join(medians.alias("m"), F.expr(f"d.`{by}` <=> m.`{by}`"), "left").select("d.*", f"m.{name}")
    return joined.withColumns({f"{column}_missing": F.col(column).isNull(), column: F.coalesce(column, name)}).drop(name)


#: reason and condition, over the columns of account_base and velocity
POLICY = (("balance_negative", "balance < 0"), ("exposure_cap", "exposure > 450000"), ("velocity_cap", "opened_90d > 2"))


def policy_rules(accounts: DataFrame, rules: tuple[tuple[str, str], ...] = POLICY) -> DataFrame:
    """Per account: the reasons against it, joined by commas, and their number."""
    reasons = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return accounts.select("account", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).cast("long").alias("n_reasons"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_features(events: DataFrame) -> DataFrame:
    """Per borrower: events of each type, value, and the mean of the attribute k of the JSON properties."""
    k = F.from_json("props", "k int")["k"]
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in EVENT_TYPES]
    return events.groupBy(F.col("user_id").alias("borrower")).agg(*counts, money(F.round("value", 2)).alias("value"), F.round(F.sum(k) / F.count(k), 6).alias("mean_k"))
