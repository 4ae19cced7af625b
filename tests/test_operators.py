"""Hand-computed cases, planted signal and properties of the credit operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.money import discrete_cuts
from quillon.operators import evaluation, features, labels, portfolio, quality, scorecard
from quillon.sources.sinks import write_scores
from quillon.sources.tables import BAD_ROW, read_table
from quillon.streaming import behaviour

SCORED = "account bigint, pd double, bad bigint"


def scored(spark, rows):
    return spark.createDataFrame([(i, float(p), b) for i, (p, b) in enumerate(rows)], SCORED)


def test_profile_counts_nulls(spark):
    found = {r.column_name: r for r in quality.profile(spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string")).collect()}
    assert (found["x"].n_rows, found["x"].n_null, found["x"].n_distinct, found["y"].n_null, found["y"].greatest) == (3, 0, 2, 1, "b")
    assert quality.profile(spark.createDataFrame([], "x int")).first().n_rows == 0


def test_key_check(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "k int, n int")
    assert tuple(quality.key_check(child, ["k", "n"], spark.createDataFrame([(1,)], "p int"), ("k", "p")).first()) == (1, 1, 1)


def test_permissive_reads(spark, tmp_path):
    (tmp_path / "region.csv").write_text("r_regionkey,r_name\n1,ASIA\nx,EUROPE\n2,AFRICA,extra\n")
    found = read_table(spark, str(tmp_path), "region", "csv").cache()
    assert found.count() == 3 and found.where(F.col(BAD_ROW).isNotNull()).count() == 2
    (tmp_path / "region.json").write_text('{"r_regionkey": 1, "r_name": "ASIA"}\n{broken\n')
    found = read_table(spark, str(tmp_path), "region", "json").cache()
    assert found.count() == 2 and found.where(F.col(BAD_ROW).isNotNull()).count() == 1


def test_write_scores_replaces_its_dates_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    write_scores(spark.createDataFrame([(1, 0.1, "2024-01-01"), (2, 0.2, "2024-01-02")], "a int, pd double, as_of string"), path)
    write_scores(spark.createDataFrame([(3, 0.3, "2024-01-02")], "a int, pd double, as_of string"), path)
    assert sorted(r.a for r in spark.read.parquet(path).collect()) == [1, 3]


def test_asof_ties_and_gaps(spark):
    day = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, day, 1), (1, day + dt.timedelta(1), 2), (2, day, 3), (1, day - dt.timedelta(1), 4)], "key int, time timestamp_ntz, id int")
    right = spark.createDataFrame([(1, day, 10), (1, day, 11), (3, day, 12)], "key int, time timestamp_ntz, v int")
    found = {r.id: r.v for r in features.asof_features(left, right, "key", "time", "v").collect()}
    assert found == {1: 11, 2: 11, 3: None, 4: None}


def test_impute_and_winsorise(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "s string, x double")
    assert sorted((r.s, r.x, r.x_missing) for r in features.impute(df, "x", "s").where("s = 'a'").collect()) == [("a", 1.0, False), ("a", 1.0, True), ("a", 3.0, False)]
    assert features.impute(df, "x", "s").where("s = 'b'").first().x is None
    wide = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "x double")
    found = features.winsorise(wide, "x").agg(F.min("x_w"), F.max("x_w"), F.count_if(F.col("x_w").isNull())).first()
    assert tuple(found) == (5.0, 95.0, 1)


def test_policy_reasons(spark):
    df = spark.createDataFrame([(1, -1.0, 500000.0, 5), (2, 1.0, 1.0, 1)], "account int, balance double, exposure double, opened_90d int")
    found = {r.account: (r.reasons, r.n_reasons) for r in features.policy_rules(df).collect()}
    assert found == {1: ("balance_negative,exposure_cap,velocity_cap", 3), 2: ("", 0)}


def test_label_is_half_or_more(spark):
    lines = spark.createDataFrame([(1, "R"), (1, "N"), (2, "N"), (2, "N"), (2, "R")], "l_orderkey int, l_returnflag string")
    assert {r.account: r.bad for r in labels.default_label(lines).collect()} == {1: 1, 2: 0}


def test_roll_rates_sum_to_one(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day + dt.timedelta(i), f) for i, f in enumerate("RNRRN")] + [(2, day, "N")]
    found = labels.roll_rates(spark.createDataFrame(rows, "o_custkey int, l_shipdate timestamp_ntz, l_returnflag string")).collect()
    assert {(r.before, r.after): r.n for r in found} == {(1, 0): 2, (0, 1): 1, (1, 1): 1}
    for before in (0, 1):
        assert math.isclose(sum(r.share for r in found if r.before == before), 1, abs_tol=1e-5)


def test_vintage_curve_reaches_late_misses(spark):
    day = dt.datetime
    rows = [(1, day(1995, 1, 2), day(1996, 2, 2), "R"), (2, day(1995, 1, 2), day(2004, 3, 1), "R"), (3, day(1995, 2, 1), day(1995, 3, 1), "N")]
    found = {r.age: (r.accounts, r.missed_by) for r in labels.vintage_curve(spark.createDataFrame(rows, "o_orderkey int, o_orderdate timestamp_ntz, l_shipdate timestamp_ntz, l_returnflag string")).collect()}
    assert found == {age: (3, (age >= 1) + (age >= 9)) for age in range(10)}


def test_woe_by_hand(spark):
    found = {r.bin: r for r in scorecard.woe_iv(spark.createDataFrame([(1, 0)] * 3 + [(1, 1)] + [(2, 1)] * 2, "bin int, bad int"), "bad").collect()}
    assert found[1].woe == pytest.approx(math.log((3.5 / 3.5) / (1.5 / 3.5)), abs=1e-6)
    assert found[2].woe == pytest.approx(math.log((0.5 / 3.5) / (2.5 / 3.5)), abs=1e-6)


def test_bins_put_ties_low(spark):
    found = scorecard.quantile_bins(spark.createDataFrame([(float(i % 4),) for i in range(40)] + [(None,)], "x double"), "x", 4).groupBy("bin").count()
    assert {r.bin: r["count"] for r in found.collect()} == {0: 1, 1: 10, 2: 10, 3: 10, 4: 10}


def test_auc_ks_by_hand(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]
    assert tuple(evaluation.auc_gini(scored(spark, rows)).first()) == (0.75, 0.5)
    assert evaluation.ks(scored(spark, rows)).first().ks == 0.5
    tied = scored(spark, [(0.5, 0), (0.5, 1)])
    assert evaluation.auc_gini(tied).first().auc == 0.5
    assert evaluation.auc_gini(scored(spark, [(0.5, 0)])).first().auc is None
    assert evaluation.auc_gini(scored(spark, [])).first().auc is None


def test_auc_ignores_monotone_rescaling(spark):
    rows = [(((i * 37) % 101) / 101, int((i * 53) % 7 < 3)) for i in range(200)]
    a, b = (evaluation.auc_gini(scored(spark, x)).first().auc for x in (rows, [(p * p, y) for p, y in rows]))
    assert a == b


def test_psi_of_itself_is_zero(spark):
    df = scored(spark, [((i % 50) / 50, 0) for i in range(200)])
    both = df.withColumn("year", F.lit("a")).union(df.withColumn("year", F.lit("b")))
    assert {r.year: r.psi for r in evaluation.psi(both, "year", "a").collect()} == {"a": 0.0, "b": 0.0}


def test_confusion_by_hand(spark):
    df = scored(spark, [(0.2, 0), (0.6, 0), (0.7, 1), (0.1, 1)])
    r = evaluation.confusion(df, spark.createDataFrame([(0.5,), (0.9,)], "threshold double")).orderBy("threshold").collect()
    assert (r[0].tp, r[0].fp, r[0].fn, r[0].tn, r[0].precision, r[0].cost) == (1, 1, 1, 1, 0.5, 6.0)
    assert r[1].precision is None


def test_models_recover_a_planted_signal(spark):
    rows = spark.range(4000).select(F.col("id").alias("account"), (F.rand(1) * 2 - 1).alias("x1"), (F.rand(2) * 2 - 1).alias("x2"), F.rand(3).alias("u"))
    rows = rows.withColumn("label", (F.col("u") < 1 / (1 + F.exp(-(3 * F.col("x1") - 2 * F.col("x2"))))).cast("double"))
    for fit in (scorecard.fit_pd, scorecard.fit_challenger):
        out = scorecard.score_batch(rows, fit(rows.where("account % 2 = 0"), ["x1", "x2"])).where("account % 2 = 1")
        assert evaluation.auc_gini(out.withColumn("bad", F.col("label").cast("long"))).first().auc > 0.8
    model = scorecard.fit_pd(rows, ["x1", "x2"])
    w, s = model.stages[2].coefficients, model.stages[1].std
    assert w[0] / s[0] == pytest.approx(3, abs=0.5) and w[1] / s[1] == pytest.approx(-2, abs=0.5)


def test_points_double_odds(spark):
    from quillon.functions.money import points

    r = spark.createDataFrame([(0.5,), (1 / 3,)], "pd double").select(points(F.col("pd")).alias("p")).collect()
    assert r[0].p == pytest.approx(500) and r[1].p == pytest.approx(520)


def test_cube_totals_and_band_edges(spark):
    df = spark.createDataFrame([("r", "s", "F", 1.5, 0.5, 0.25), ("q", "s", "O", 2.5, 0.25, 0.2)], "region string, segment string, status string, exposure double, loss double, pd double")
    total = portfolio.exposure_cube(df).where("level = 7").first()
    assert (total.exposure, total.loss) == (4.0, 0.75)
    assert {r.pd: r.rating for r in portfolio.risk_bands(df).collect()} == {0.25: "B", 0.2: "A"}


def test_watchlist_moves(spark):
    name = lambda *x: spark.createDataFrame([(i,) for i in x], "borrower int")
    found = {r.borrower: r.move for r in portfolio.watchlist(name(1, 2, 5), name(2, 3, 3, 4), name(4, 5)).collect()}
    assert found == {1: "cleared", 2: "kept", 3: "new"}


def test_watchlist_of_null_names_and_one_aggregate(spark):
    """A null name moves like others and is never paid up; each list is read once and none is joined with another."""
    name = lambda *x: spark.createDataFrame([(i,) for i in x], "borrower int")
    found = portfolio.watchlist(name(1, None, 1, 6), name(2, None, 6), name(None, 2, 7))
    assert {r.borrower: r.move for r in found.collect()} == {1: "cleared", None: "kept", 6: "kept"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 3


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def files(spark, folder, parts):
    """One file per part, oldest first by the file's time."""
    import os
    import time

    for i, rows in enumerate(parts):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def event(i, hour, user=1, kind="view"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), user, kind, 1.0, '{"k": 1}')


def test_late_rows_are_counted(spark, tmp_path):
    # late rows are judged by the watermark of the batch before, so the old row comes two files after the newest
    parts = [[event(1, 0), event(2, 1)], [event(3, 200)], [event(6, 200)], [event(4, 2), event(5, 201)], [event(9, 2000)]]
    stream = files(spark, tmp_path, parts)
    landed = behaviour.run_to_end(behaviour.activity_windows(stream, "1 hour", delay="10 hours"))
    closed = landed.where("start < '2024-02-01'")
    every = spark.read.schema(EVENTS).parquet(f"{tmp_path}/*").where("ts < '2024-02-01'")
    assert behaviour.late_rows(every, closed).first().late == 1


def test_stream_dedup_drops_repeats(spark, tmp_path):
    stream = files(spark, tmp_path, [[event(1, 0), event(2, 1)], [event(1, 0), event(3, 1)]])
    assert sorted(r.event_id for r in behaviour.run_to_end(behaviour.dedup_events(stream, "5 hours")).collect()) == [1, 2, 3]


def test_stream_sessions_equal_batch(spark, tmp_path):
    rows = [event(i, h, u) for i, (h, u) in enumerate([(0, 1), (5, 1), (11, 1), (18, 1), (0, 2), (30, 2)])]
    stream = files(spark, tmp_path, [rows[:3], rows[3:], [event(99, 5000, 9)]])
    found = behaviour.run_to_end(behaviour.activity_sessions(stream)).where("user_id != 9")
    batch = behaviour.activity_sessions(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_keeps_the_latest(spark, tmp_path):
    one = [event(1, 0, 1), event(2, 1, 2)]
    stream = files(spark, tmp_path / "in", [one, [event(3, 5, 1), event(4, 0, 2)]]).withColumnRenamed("user_id", "borrower")
    path = str(tmp_path / "scores")
    behaviour.upsert_scores(stream, path)
    assert {r.borrower: r.event_id for r in behaviour.latest_scores(spark, path).collect()} == {1: 3, 2: 2}


def test_plans_have_no_cartesian_of_tables(spark, small):
    from quillon.plans.queries import base, losses

    for df in (base(spark, small), losses(spark, small)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


def test_scores_keep_rows_with_nulls(spark):
    rows = spark.range(400).select(F.col("id").alias("account"), F.when(F.col("id") % 4 != 0, F.rand(1)).alias("x"), F.rand(2).alias("u"))
    rows = rows.withColumn("label", (F.col("u") < F.coalesce("x", F.lit(0.9))).cast("double"))
    for fit in (scorecard.fit_pd, scorecard.fit_challenger):
        out = scorecard.score_batch(rows, fit(rows, ["x"]))
        assert out.count() == 400 and out.where("pd IS NULL").count() == 100
    table = scorecard.woe_table(rows, ["x"], n=4)
    out = scorecard.with_woe(rows, table)
    scored_ = scorecard.score_batch(out, scorecard.fit_pd(out, ["x_woe"]))
    assert scored_.where("pd IS NULL").count() == 0 and set(table["x"][1]) == {0, 1, 2, 3, 4}
    foreign = scorecard.score_foreign(rows, lambda df: df["x"] / 2, ["x"])
    assert foreign.where("pd = x / 2").count() == 300 and foreign.where("pd IS NULL").count() == 100


def test_asof_ignores_null_keys_and_times(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, "a", at(5)), (2, None, at(5)), (3, "a", None), (4, "b", at(1))], "id int, key string, time timestamp")
    right = spark.createDataFrame([("a", at(2), 10), ("a", None, 11), (None, at(1), 12), ("a", at(6), 13), ("b", at(2), 14)], "key string, time timestamp, v int")
    found = {r.id: r.v for r in features.asof_features(left, right, "key", "time", "v").collect()}
    assert found == {1: 10, 2: None, 3: None, 4: None}


def test_null_foreign_keys_are_orphans(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "k int, p int")
    r = quality.key_check(child, ["k"], spark.createDataFrame([(1,)], "id int"), ("p", "id")).first()
    assert (r.surplus_rows, r.orphan_rows) == (0, 2)


def test_cuts_by_counts_and_by_sketch(spark):
    rows = spark.createDataFrame([(v, "a" if v % 2 else "b") for v in range(1, 101)] + [(None, "a"), (None, "c")], "v int, g string")
    cuts = discrete_cuts(rows, "v", [0.25, 0.5]).first().cuts
    assert cuts == [25, 50] == discrete_cuts(rows, "v", [0.25, 0.5], approx=True).first().cuts
    filled = features.impute(rows, "v", "g").where("v_missing")
    assert {r.g: r.v for r in filled.collect()} == {"a": 49, "c": None}
    per = {r.bin: r.n for r in scorecard.binned_counts(rows, "v", 4, {}).collect()}
    assert per == {1: 25, 2: 25, 3: 25, 4: 25}


def test_default_threshold(spark):
    lines = spark.createDataFrame([(1, "R"), (1, "N"), (1, "N"), (2, "R"), (2, "R"), (2, "N")], "l_orderkey int, l_returnflag string")
    bad = lambda t: {r.account: r.bad for r in labels.default_label(lines, t).collect()}
    assert bad(0.5) == {1: 0, 2: 1} and bad(0.3) == {1: 1, 2: 1} and bad(0.7) == {1: 0, 2: 0}


def test_alerts_with_late_events_and_expiry(spark, tmp_path):
    # the late event 4 counts the one before it, not those after; the state goes once the watermark has passed the span
    stream = files(spark, tmp_path, [[event(1, 0), event(2, 2), event(3, 3)], [event(4, 1), event(9, 200, 2)], [event(8, 400, 2)], [event(5, 401)]])
    found = behaviour.run_to_end(behaviour.velocity_alerts(stream, 2, 6 * 3600, "4 hours"))
    assert {(r.event_id, r.n) for r in found.collect()} == {(2, 2), (3, 3), (4, 2)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [[event(i, i, i) for i in range(1, 40)], [event(99, 50, 7)], [event(98, 49, 7)]]).withColumnRenamed("user_id", "borrower")
    path = str(tmp_path / "scores")
    behaviour.upsert_scores(stream, path, buckets=8)
    found = {r.borrower: r.event_id for r in behaviour.latest_scores(spark, path).collect()}
    assert found == {**{i: i for i in range(1, 40)}, 7: 99}
    assert spark.read.parquet(f"{path}/v=1").select("bucket").distinct().count() == 1


def test_portfolios_without_bads_spread_or_exposure(spark):
    good = scored(spark, [(i / 100, 0) for i in range(40)])
    assert {(r.bads, r.capture, r.lift) for r in evaluation.gains_table(good, 4).collect()} == {(0, None, None)}
    sure = scored(spark, [(0.0, 0)] * 5 + [(1.0, 1)] * 5 + [(0.5, 1)] * 2).unionByName(spark.createDataFrame([(99, None, 1)], SCORED))
    found = evaluation.calibration(sure, 3).collect()
    assert {r.hosmer_lemeshow for r in found} == {round((7 - 6) ** 2 / (6 * (1 - 6 / 7)), 4)} and sum(r.accounts for r in found) == 12
    assert {r.hosmer_lemeshow for r in evaluation.calibration(scored(spark, [(0.0, 0), (1.0, 1)]), 2).collect()} == {None}
    equal = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 0), (None, 1), (None, 0)], "region string, bad int")
    assert evaluation.segment_outliers(equal, ["region"]).count() == 0
    assert evaluation.segment_outliers(equal.where("region = 'a'"), ["region"]).count() == 0
    base = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 0.0), (None, 3, 5.0), (None, 4, 15.0)], "region string, borrower int, exposure double")
    assert {(r.region, r.borrower, r.share, r.herfindahl) for r in portfolio.concentration(base).collect()} == {("r", 1, None, None), ("r", 2, None, None), (None, 3, 0.25, 0.625), (None, 4, 0.75, 0.625)}


def test_scores_at_the_ends_of_doubles(spark):
    rows = spark.createDataFrame([(1, 1e8, 0.0, "F"), (2, -1e9, 0.0, "F"), (3, 0.0, 0.0, "P"), (4, None, 1.0, "F")], "account int, balance double, exposure double, status string")
    found = {r.account: (r.pd, r.points) for r in scorecard.apply_scorecard(rows).collect()}
    assert found[1] == (0.0, None) and found[2] == (1.0, None) and found[4] == (None, None) and found[3][1] is not None
    assert {r.account: r.reasons for r in scorecard.reason_codes(rows, 1).collect()}[4] == "exposure"


def test_psi_of_null_and_missing_periods(spark):
    df = scored(spark, [((i % 50) / 50, 0) for i in range(200)])
    both = df.withColumn("year", F.lit("a")).union(df.withColumn("year", F.lit(None).cast("string")))
    assert {r.year: r.psi for r in evaluation.psi(both, "year", "a").collect()} == {"a": 0.0, None: 0.0}
    assert {r.year: r.psi for r in evaluation.psi(both, "year", "z").collect()} == {"a": None, None: None}


def disc(values, share):
    """The least value at which a share of the values is reached."""
    values = sorted(values)
    return next(v for i, v in enumerate(values, 1) if i >= share * len(values))


@pytest.mark.parametrize("shape", ["even", "tied", "tails", "dates"])
def test_cuts_equal_sorted_values(spark, shape):
    import random

    rng = random.Random(shape)
    make = {"even": lambda: rng.random(), "tied": lambda: float(rng.randint(0, 5)), "tails": lambda: rng.random() ** -3, "dates": lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 2000))}[shape]
    rows = [(rng.choice(["a", "a", "a", "b", None]), make() if rng.random() > 0.1 else None) for _ in range(30_000)]
    df = spark.createDataFrame(rows, f"g string, v {'date' if shape == 'dates' else 'double'}").repartition(5)
    shares = [0.9, 0.0, 0.05, 0.5, 0.5003, 1.0]
    known = [v for _, v in rows if v is not None]
    assert discrete_cuts(df, "v", shares).first().cuts == [disc(known, p) for p in shares]
    for r in discrete_cuts(df, "v", shares, ["g"]).collect():
        assert r.cuts == [disc([v for g, v in rows if g == r.g and v is not None], p) for p in shares]
    assert discrete_cuts(df.limit(0), "v", shares, ["g"]).count() == 0


def windows_in_one_task(df):
    """Plans of the sorts that a single task makes, without what a broadcast or an aggregate has made small."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [plan[i + 1].strip() for i, line in enumerate(plan) if "Exchange SinglePartition" in line and i + 1 < len(plan) and "partial_" not in plan[i + 1] and "LocalLimit" not in plan[i + 1]]


def test_quantiles_have_no_task_for_all_values(spark, small):
    from quillon.plans.queries import QUERIES

    for name in ("quantile_bins", "winsorise", "impute"):
        assert windows_in_one_task(QUERIES[name](spark, small)) == [], name
    per = scorecard.binned_counts(spark.range(1000).select((F.col("id") / 1000).alias("pd")), "pd", 10, {})
    text = per._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange SinglePartition") <= 2 and all("_r" in line and "_s" in line for line in windows_in_one_task(per))


def test_columns_with_the_names_inside_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("a", None, 8)], "s string, x double, _median int").withColumn("_cuts", F.lit(9))
    assert sorted((r.x, r["_median"], r["_cuts"]) for r in features.impute(df, "x", "s").collect()) == [(1.0, 7, 9), (1.0, 8, 9)]
    assert {r["_cuts"] for r in features.winsorise(df, "x").collect()} == {9} == {r["_cuts"] for r in scorecard.quantile_bins(df, "x", 2).collect()}
    left = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), 5)], "key int, time timestamp, v int")
    found = features.asof_features(left, left.withColumn("v", F.lit(6)), "key", "time", "v").first()
    assert (found["v"], found["v_right"]) == (5, 6)


def hot_rows(seed, n=3000):
    """Keys of which one has a third of all rows, one is null, and the others few; times with ties and nulls."""
    import random

    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    return [(i, rng.choice([1, None] + [rng.randint(2, 900)] * 2), None if rng.random() < 0.02 else start + dt.timedelta(hours=rng.randint(0, 9000))) for i in range(n)]


def test_hot_keys_in_asof_joins(spark):
    schema = "id int, key int, time timestamp"
    a, b = hot_rows(1), [r for r in hot_rows(2) if r[0] % 4 == 0]
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumnRenamed("id", "v")
    assert features.hot_keys(left, "key", "time").count() >= 1
    want = {}
    for i, k, t in a:
        fits = [(u, v) for v, j, u in b if None not in (k, t, u) and j == k and u <= t]
        want[i] = max(fits)[1] if fits else None
    found = features.asof_features(left, right, "key", "time", "v")
    assert {r.id: r.v for r in found.collect()} == want
    # the hot key's rows meet in ranges, none of which has them all
    dealt = features.in_ranges(left.where("key = 1 AND time IS NOT NULL"), "key", "time", features.hot_keys(left, "key", "time"))
    sizes = [r["count"] for r in dealt.groupBy("_r").count().collect()]
    assert len(sizes) > 30 and max(sizes) < sum(sizes) / 20


def test_hot_borrowers_in_velocity_and_recency(spark):
    rows = hot_rows(3)
    orders = spark.createDataFrame([(i, k, t, float(i)) for i, k, t in rows], "o_orderkey int, o_custkey int, o_orderdate timestamp_ntz, o_totalprice double")
    found = {r.account: (r.opened, r.opened_exposure) for r in features.velocity(orders, 30).collect()}
    for i, k, t in rows[::7]:
        seen = [j for j, m, u in rows if m == k and ((t is None and u is None) or (None not in (t, u) and t - dt.timedelta(30) <= u <= t))]
        assert found[i] == (len(seen), float(sum(seen))), i
    got = {r.account: (r.sequence, r.days_since) for r in features.recency(orders).collect()}
    by = {}
    for i, k, t in rows:
        by.setdefault(k, []).append((t is not None, t or dt.datetime.min, i))
    for mine in by.values():
        for n, (has, t, i) in enumerate(sorted(mine)):
            before = sorted(mine)[n - 1] if n else (False, None, None)
            assert got[i] == (n + 1, (t.date() - before[1].date()).days if has and before[0] else None), i


def test_profile_by_sketches(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 7).alias("few"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("half"), F.lit(None).cast("int").alias("none"), F.array("id").alias("odd.name"))
    exact = {r.column_name: r for r in quality.profile(df).collect()}
    assert [exact[c].n_distinct for c in df.columns] == [50_000, 7, 25_000, 0, 50_000] and exact["half"].n_null == 25_000 and exact["none"].least is None
    rough = {r.column_name: r.n_distinct for r in quality.profile(df, exact=100).collect()}
    assert rough["few"] == 7 and abs(rough["id"] / 50_000 - 1) < 0.05 and abs(rough["half"] / 25_000 - 1) < 0.05 and rough["none"] == 0
    assert {r.n_distinct for r in quality.profile(df, exact=0).where("column_name = 'few'").collect()} == {7}


def test_profile_counts_beyond_the_sets_exactly(spark):
    df = spark.range(50_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("odd.name"), F.array("id").alias("list"), (F.col("id") % 7).alias("few"))
    assert [r.n_distinct for r in quality.profile(df, exact=100).collect()] == [50_000, 25_000, 50_000, 7]


def test_fit_on_counts_equals_spark_ml(spark):
    rows = spark.range(6000).select((F.col("id") % 5 / 2).alias("x1"), (F.col("id") % 7 / 3).alias("x2"), F.rand(3).alias("u"))
    rows = rows.withColumn("label", (F.col("u") < 1 / (1 + F.exp(-(0.5 + F.col("x1") - 2 * F.col("x2"))))).cast("double"))
    found = scorecard.fit_counts(rows, ["x1", "x2"], "label")
    model = scorecard.fit_pd(rows, ["x1", "x2"])
    w, s = model.stages[2].coefficients, model.stages[1].std
    assert found["x1"] == pytest.approx(w[0] / s[0], abs=0.01) and found["x2"] == pytest.approx(w[1] / s[1], abs=0.01)
    assert scorecard.fit_counts(rows.limit(0), ["x1"], "label") == {"intercept": 0.0, "x1": 0.0}
    flat = scorecard.fit_counts(rows.withColumn("x2", F.lit(1.0)), ["x1", "x2"], "label")
    assert math.isfinite(flat["x2"])


def test_foreign_models_are_loaded_and_see_no_nulls(spark):
    def load():
        def model(a, b):
            assert not (a != a).any() and not (b != b).any()
            return a + 2 * b

        return model

    df = spark.range(500).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("a"), F.lit(1.0).alias("b"))
    found = scorecard.score_loaded(df, load, ["a", "b"], batch=64)
    assert found.where("pd = a + 2").count() == 333 and found.where("pd IS NULL").count() == 167


def part_of(rows):
    """The part that each row is in, as a column, from rows (part, ...)."""
    return F.element_at(F.create_map(*[F.lit(x) for i, p in rows for x in (i, p)]), F.col("event_id").cast("int"))


def test_parts_are_batches_of_many_files(spark):
    rows = [event(i, i, i % 3) for i in range(60)]
    seen = []

    def run(stream):
        def put(batch, number):
            seen.append((batch.count(), batch.rdd.getNumPartitions() if batch.count() else 0))

        stream.writeStream.option("checkpointLocation", folder).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()

    from quillon.sources.sinks import shared_folder

    folder = shared_folder(spark)
    table = spark.createDataFrame(rows, EVENTS).repartition(6)
    behaviour.in_parts(table, F.pmod(F.col("event_id"), F.lit(2)), run)
    assert [n for n, _ in seen] == [30, 30] and all(parts > 1 for _, parts in seen)
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    behaviour.in_parts(table.limit(0), F.lit(0), run)
    assert [n for n, _ in seen][2:] in ([], [0])


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, behaviour.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_ordered_alerts_count_in_order_of_time(spark, rocksdb):
    """Events out of order within the delay count in order; one behind the watermark is dropped; a borrower with a third of all rows, and null borrowers."""
    import random

    rng = random.Random(5)
    rows = [event(i, rng.randint(0, 300), 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5])) for i in range(400)]
    parts = [(i, rng.randint(0, 1)) for i in range(400)] + [(1000, 2), (1002, 3), (1001, 4)]
    # a batch is judged by the watermark of the one before the last
    rows += [event(1000, 5000, 9), event(1002, 5001, 9), event(1001, 10, 1)]
    found = behaviour.run_in_parts(spark.createDataFrame(rows, EVENTS), part_of(parts), lambda s: behaviour.ordered_alerts(s, 3, 6 * 3600, "20 days", 3600))
    want = set()
    for i, t, u, *_ in rows[:400]:
        n = sum(1 for j, s, v, *_ in rows[:400] if v == u and (s, j) <= (t, i) and s >= t - dt.timedelta(hours=6))
        if u is not None and n >= 3:
            want.add((u, i, n))
    assert {tuple(r) for r in found.collect()} == want


def test_ordered_alerts_forget(spark, rocksdb):
    """What a span has passed isn't counted again after the state is cleared."""
    rows = [event(1, 0), event(2, 1), event(3, 500, 2), event(4, 501), event(5, 502), event(6, 2000, 2)]
    found = behaviour.run_in_parts(spark.createDataFrame(rows, EVENTS), part_of([(1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 3)]), lambda s: behaviour.ordered_alerts(s, 2, 3 * 3600, "4 hours"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2), (1, 5, 2)}


def test_ordered_alerts_keep_a_state_per_group_not_per_borrower(spark, rocksdb, monkeypatch):
    """Many borrowers with events on both sides of a cell's edge: rows of state stay few, and what a span before the cell brings is counted once."""
    monkeypatch.setattr(behaviour, "WAITING", 3)
    rows = [event(10 * u + k, t, u) for u in range(1, 60) for k, t in enumerate((1, 9, 11, 30))] + [event(0, 5000, 0)]
    states, put = [], behaviour.run_to_end

    def kept(stream, *a, **k):
        found = put(stream, *a, **k)
        states.append(spark.read.format("statestore").load(f"{k['folder']}/state").count())
        return found

    monkeypatch.setattr(behaviour, "run_to_end", kept)
    part = F.when(F.col("event_id") == 0, 1).otherwise(0)
    found = behaviour.run_in_parts(spark.createDataFrame(rows, EVENTS), part, lambda s: behaviour.ordered_alerts(s, 2, 3 * 3600, "4 hours", 10 * 3600))
    assert {tuple(r) for r in found.collect()} == {(u, 10 * u + 2, 2) for u in range(1, 60)}
    assert states[0] <= 3 * 4


def test_counted_is_each_borrowers_span():
    import numpy as np

    rng = np.random.default_rng(6)
    held = np.stack([rng.integers(-2, 5, 300), rng.integers(-50, 50, 300), np.arange(300)], axis=1)
    for far in (0, 1 << 60):  # with far times only a few borrowers fit on one axis
        some = np.concatenate([held, [[9, far, 300]]])
        rows, n = behaviour.counted(some, 2, 10)
        want = {(u, t, i, k) for u, t, i in some.tolist() if (k := sum(v == u and t - 10 <= s and (s, j) <= (t, i) for v, s, j in some.tolist())) >= 2}
        assert {(*r, k) for r, k in zip(rows.tolist(), n.tolist())} == {(u, t, i, k) for u, t, i, k in want}
    assert len(behaviour.counted(held[:0], 1, 10)[0]) == 0


def test_upsert_reads_and_keeps_live_versions_only(spark, tmp_path):
    """However many batches there were, a batch reads one version of a bucket; a batch that is run again changes nothing."""
    import os

    path, state = str(tmp_path / "scores"), str(tmp_path / "state")
    rows = spark.createDataFrame([event(i, i % 37, i % 5) for i in range(120)], EVENTS).withColumnRenamed("user_id", "borrower")
    kept = []

    def run(stream):
        behaviour.upsert_scores(stream, path, state=state, buckets=4)
        kept.append((sum(len([f for f in fs if f.endswith(".parquet")]) for d, _, fs in os.walk(path) if "/bucket=" in d), len(os.listdir(f"{path}/manifest"))))

    behaviour.in_parts(rows, F.pmod(F.col("event_id"), F.lit(8)), run)
    want = {}
    for i in range(120):
        want[i % 5] = max(want.get(i % 5, (-1, -1)), (i % 37, i))
    latest = lambda: {r.borrower: r.event_id for r in behaviour.latest_scores(spark, path).collect()}
    assert latest() == {k: v for k, (_, v) in want.items()}
    assert max(files for files, _ in kept) <= 8 and {n for _, n in kept[1:]} == {2}
    with pytest.raises(ValueError, match="no scores"):
        behaviour.latest_scores(spark, str(tmp_path / "nothing"))


def test_upsert_batch_run_again_changes_nothing(spark, tmp_path):
    """The last batch's commit is lost, as when a driver dies before it is written."""
    import os

    path, state, folder = str(tmp_path / "scores"), str(tmp_path / "state"), str(tmp_path / "in")
    latest = lambda: {r.borrower: r.event_id for r in behaviour.latest_scores(spark, path).collect()}

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/*").withColumnRenamed("user_id", "borrower")
        behaviour.upsert_scores(stream, path, state=state, buckets=3)

    for k in range(4):
        spark.createDataFrame([event(10 * k + i, 10 * k + i, i) for i in range(4)], EVENTS).write.parquet(f"{folder}/{k}")
        run()
    before, versions = latest(), sorted(os.listdir(path))
    assert before == {i: 30 + i for i in range(4)}
    for name in ("3", ".3.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    run()
    assert latest() == before and sorted(os.listdir(path)) == versions


def test_ranks_have_no_task_for_all_scores(spark):
    rows = spark.range(1000).select((F.col("id") / 1000).alias("pd"), (F.col("id") % 2).alias("bad"))
    for found in (evaluation.auc_gini(rows), evaluation.ks(rows)):
        assert all("_r" in line and "_g" in line for line in windows_in_one_task(found))


def test_ranks_over_ranges_against_plain_counts(spark):
    """Scores at the edges of ranges, at 0 and 1, repeated, and null (below all)."""
    rng = random.Random(12)
    rows = [(rng.choice([0.0, 1.0, 0.001, 0.002, 0.0019999, None, round(rng.random(), 4)]), rng.randrange(2)) for _ in range(600)]
    at = [-1.0 if p is None else round(p, 6) for p, _ in rows]
    goods, bads = [a for a, (_, y) in zip(at, rows) if not y], [a for a, (_, y) in zip(at, rows) if y]
    area = sum((g < b) + (g == b) / 2 for g in goods for b in bads) / len(goods) / len(bads)
    gap = max(abs(sum(g <= x for g in goods) / len(goods) - sum(b <= x for b in bads) / len(bads)) for x in set(at))
    frame = spark.createDataFrame(rows, "pd double, bad long")
    assert evaluation.auc_gini(frame).first().auc == pytest.approx(area, abs=1e-6)
    assert evaluation.ks(frame).first().ks == pytest.approx(gap, abs=1e-6)


def test_model_rows_are_made_once(spark, small):
    """Cuts, weights, fits and scores scan what was written; none repeats the joins of four tables."""
    from quillon.plans import queries

    plan = queries.model_rows(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
