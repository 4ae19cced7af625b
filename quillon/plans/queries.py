"""The credit-risk queries: each builds its result from the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import evaluation, features, labels, portfolio, quality, scorecard
from quillon.sources import sinks
from quillon.sources.tables import BAD_ROW, event_time, read_stream, read_table
from quillon.streaming import behaviour

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def base(spark: SparkSession, d: str) -> DataFrame:
    return features.account_base(*(read_table(spark, d, t) for t in ("orders", "customer", "nation", "region")))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with their default label; those without lines have none and are left out."""
    return base(spark, d).join(labels.default_label(read_table(spark, d, "lineitem")).select("account", "bad"), "account")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.apply_scorecard(labelled(spark, d))


def losses(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.expected_loss(scorecard.apply_scorecard(base(spark, d)))


def account_lines(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    return orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lines.select("l_orderkey", "l_shipdate", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query
def read_orders(spark, d):
    return read_table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00' AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


def spoiled(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Orders, and which of them are spoiled when they are written as text."""
    return read_table(spark, d, "orders"), F.col("o_orderkey") % 7 == 0


def told_apart(read: DataFrame) -> DataFrame:
    """Rows that fit and rows that don't, with what could be read of them."""
    return read.groupBy(F.col(BAD_ROW).isNull().alias("fits")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count("o_totalprice").alias("prices"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query
def read_csv_orders(spark, d):
    """Orders as CSV in which every seventh has a price that is no number, read by their schema."""
    rows, bad = spoiled(spark, d)
    folder = behaviour.shared_folder(spark)
    price = F.when(bad, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    text = rows.withColumns({"o_totalprice": price, "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")})
    text.write.option("header", True).csv(f"{folder}/orders.csv")
    return told_apart(read_table(spark, folder, "orders", "csv"))


@query
def read_json_orders(spark, d):
    """Orders as lines of JSON of which every seventh is cut off, read by their schema."""
    rows, bad = spoiled(spark, d)
    folder = behaviour.shared_folder(spark)
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(bad, F.left(line, F.length(line) - 5)).otherwise(line).alias("value")).write.text(f"{folder}/orders.json")
    return told_apart(read_table(spark, folder, "orders", "json"))


@query
def profile_customer(spark, d):
    return quality.profile(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query
def key_check_lines(spark, d):
    return quality.key_check(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], read_table(spark, d, "orders"), ("l_orderkey", "o_orderkey"))


@query
def account_base(spark, d):
    return base(spark, d).withColumn("opened", day("opened"))


@query
def borrower_features(spark, d):
    return features.borrower_features(read_table(spark, d, "orders"), read_table(spark, d, "lineitem"))


@query
def velocity(spark, d):
    return features.velocity(read_table(spark, d, "orders"))


@query
def recency(spark, d):
    return features.recency(read_table(spark, d, "orders"))


@query
def asof_features(spark, d):
    left = read_table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("time"))
    right = read_table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("time"), "o_orderkey", "o_totalprice")
    return features.asof_features(left, right, "key", "time", "o_orderkey").select("event_id", "o_orderkey", "o_totalprice", day("asof_time").alias("asof"))


@query
def asof_ship_dates(spark, d):
    """For each line the borrower's latest account opened by the line's date."""
    lines = account_lines(spark, d).select(F.col("o_custkey").alias("key"), F.col("l_shipdate").alias("time"), "o_orderkey", "l_returnflag").withColumnRenamed("o_orderkey", "line_of")
    right = read_table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("time"), "o_orderkey")
    out = features.asof_features(lines, right, "key", "time", "o_orderkey")
    return out.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("missed"))


@query
def status_pivot(spark, d):
    return features.status_pivot(base(spark, d))


@query
def winsorise(spark, d):
    return features.winsorise(base(spark, d).select("account", "exposure"), "exposure")


@query
def impute(spark, d):
    made = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return features.impute(made, "c_acctbal", "c_mktsegment")


@query
def policy_rules(spark, d):
    opened = features.velocity(read_table(spark, d, "orders")).select("account", F.col("opened").alias("opened_90d"))
    return features.policy_rules(base(spark, d).join(opened, "account"))


@query
def event_features(spark, d):
    return features.event_features(read_table(spark, d, "events"))


@query
def default_label(spark, d):
    return labels.default_label(read_table(spark, d, "lineitem"))


@query
def delinquency_bucket(spark, d):
    found = labels.delinquency_bucket(account_lines(spark, d))
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("missed"), F.sum("days_late").alias("days_late"))


@query
def roll_rates(spark, d):
    return labels.roll_rates(account_lines(spark, d))


@query
def vintage_curve(spark, d):
    return labels.vintage_curve(account_lines(spark, d))


@query
def quantile_bins(spark, d):
    return scorecard.quantile_bins(base(spark, d).select("account", "balance"), "balance", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("balance").alias("least"), F.max("balance").alias("greatest"))


@query
def woe_iv(spark, d):
    rows = sinks.written(labelled(spark, d).select("account", "balance", "bad"))  # read for the cuts and for the bins
    return scorecard.woe_iv(scorecard.quantile_bins(rows, "balance", 10), "bad")


@query
def split(spark, d):
    return scorecard.split(base(spark, d).select("account", "opened"), "2000-07-01").groupBy("part").agg(F.count("*").alias("n"), F.sum("account").alias("keys"))


FEATURES = ["balance", "exposure", "opened_90d"]


def all_rows(spark: SparkSession, d: str) -> DataFrame:
    """All accounts with features known at their opening, and their label if they have one. Written once, as cuts, weights, fits and scores each read them."""
    opened = features.velocity(read_table(spark, d, "orders")).select("account", F.col("opened").cast("double").alias("opened_90d"))
    bad = labels.default_label(read_table(spark, d, "lineitem")).select("account", "bad", F.col("bad").cast("double").alias("label"))
    rows = scorecard.split(base(spark, d).join(opened, "account").join(bad, "account", "left"), "2000-07-01")
    return sinks.written(rows.select("account", "bad", "label", "part", *FEATURES))


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    return all_rows(spark, d).where("label IS NOT NULL")


@query
def fit_pd(spark, d):
    """Scores of the holdout by a logistic model on weights of evidence, both of the training part."""
    rows = model_rows(spark, d)
    table = scorecard.woe_table(rows.where("part = 'train'"), FEATURES)
    rows, names = scorecard.with_woe(rows, table), [f"{c}_woe" for c in FEATURES]
    model = scorecard.fit_pd(rows.where("part = 'train'"), names)
    return scorecard.score_batch(rows.where("part = 'holdout'"), model).select("account", "bad", F.round("pd", 6).alias("pd"))


@query
def fit_challenger(spark, d):
    rows = model_rows(spark, d)
    model = scorecard.fit_challenger(rows.where("part = 'train'"), FEATURES)
    return scorecard.score_batch(rows.where("part = 'holdout'"), model).select("account", "bad", F.round("pd", 6).alias("pd"))


@query
def score_batch(spark, d):
    """Every account, labelled or not, scored by a model fitted on the training part."""
    rows = all_rows(spark, d)
    return scorecard.score_batch(rows, scorecard.fit_pd(rows.where("part = 'train'"), ["balance", "exposure"])).select("account", F.round("pd", 6).alias("pd"))


@query
def score_foreign(spark, d):
    """Every account scored by a plain linear model, loaded once a worker and given numpy batches."""
    return scorecard.score_loaded(base(spark, d), lambda: linear_model(-0.5, (-0.00008, 0.000002)), ["balance", "exposure"]).select("account", F.round("pd", 6).alias("pd"))


def linear_model(intercept: float, weights: tuple[float, ...]) -> Callable[..., object]:
    """A logistic model as another library might give it: from one array per feature to scores."""
    import numpy as np

    return lambda *columns: 1 / (1 + np.exp(-(intercept + sum(w * np.asarray(c, float) for w, c in zip(weights, columns)))))


@query
def fit_pd_counts(spark, d):
    """Coefficients of the logistic model on weights of evidence, by Newton steps on counts per combination of bins."""
    train = sinks.written(labelled(spark, d).where("account % 10 >= 3").select("balance", "exposure", "bad"))
    names = ["balance", "exposure"]
    rows = scorecard.with_woe(train, scorecard.woe_table(train, names, "bad"))
    found = scorecard.fit_counts(rows, [f"{c}_woe" for c in names], "bad")
    return spark.createDataFrame([(k, round(v, 5)) for k, v in found.items()], "name string, coefficient double")


@query
def write_scores(spark, d):
    """Scores of all accounts by year, then those of one year anew with the sign of their points turned; what is read back."""
    path = behaviour.shared_folder(spark)
    rows = scorecard.apply_scorecard(base(spark, d)).select("account", "pd", "points", F.date_format("opened", "yyyy").alias("as_of"))
    sinks.write_scores(rows, path, key="account", files=4)
    sinks.write_scores(rows.where("as_of = '1997'").withColumn("points", -F.col("points")), path)
    return spark.read.schema("account long, pd double, points double, as_of string").parquet(path)


@query
def apply_scorecard(spark, d):
    return scorecard.apply_scorecard(base(spark, d)).select("account", "pd", "points")


@query
def reason_codes(spark, d):
    return scorecard.reason_codes(base(spark, d))


@query
def auc_gini(spark, d):
    return evaluation.auc_gini(scored(spark, d))


@query
def ks(spark, d):
    return evaluation.ks(scored(spark, d))


@query
def gains_table(spark, d):
    return evaluation.gains_table(scored(spark, d))


@query
def confusion(spark, d):
    return evaluation.confusion(scored(spark, d), spark.createDataFrame([(0.3,), (0.4,), (0.5,), (0.6,)], "threshold double"))


@query
def calibration(spark, d):
    return evaluation.calibration(scored(spark, d))


@query
def psi(spark, d):
    return evaluation.psi(scored(spark, d).withColumn("year", F.date_format("opened", "yyyy")), "year", "1995")


@query
def segment_outliers(spark, d):
    return evaluation.segment_outliers(labelled(spark, d), ["region", "segment"])


@query
def expected_loss(spark, d):
    return losses(spark, d).select("account", "pd", "lgd", "loss")


@query
def expected_loss_rollup(spark, d):
    return portfolio.loss_rollup(losses(spark, d))


@query
def exposure_cube(spark, d):
    return portfolio.exposure_cube(losses(spark, d))


@query
def exposure_rollup(spark, d):
    return portfolio.exposure_cube(losses(spark, d), "rollup")


@query
def exposure_sets(spark, d):
    return portfolio.exposure_cube(losses(spark, d), "sets")


@query
def concentration(spark, d):
    return portfolio.concentration(base(spark, d))


@query
def stress(spark, d):
    return portfolio.stress(losses(spark, d))


@query
def watchlist(spark, d):
    accounts = base(spark, d)
    before = accounts.where("status = 'P' AND opened < TIMESTAMP_NTZ '1999-01-01 00:00:00' AND exposure > 400000")
    after = accounts.where("status = 'P' AND opened >= TIMESTAMP_NTZ '1999-01-01 00:00:00' AND exposure > 400000")
    return portfolio.watchlist(before, after, accounts.where("balance > 9500"))


@query
def risk_bands(spark, d):
    return portfolio.risk_bands(scorecard.apply_scorecard(base(spark, d))).select("account", "pd", "rating")


def stream(spark: SparkSession, d: str) -> DataFrame:
    return event_time(read_stream(spark, d, "events"))


@query
def dedup_events(spark, d):
    return behaviour.run_to_end(behaviour.dedup_events(stream(spark, d))).select("event_id", "user_id", "event_type", day("ts").alias("at"))


@query
def activity_windows(spark, d):
    return behaviour.run_to_end(behaviour.activity_windows(stream(spark, d)), "complete").withColumn("start", day("start"))


@query
def activity_windows_sliding(spark, d):
    return behaviour.run_to_end(behaviour.activity_windows(stream(spark, d), "2 days", "1 day"), "complete").withColumn("start", day("start"))


@query
def activity_sessions(spark, d):
    """Sessions from a stream; a far later event in a batch of its own closes the last ones."""
    events = behaviour.drained(event_time(read_table(spark, d, "events")))
    found = behaviour.run_in_parts(events, F.col("user_id").isNull().cast("int"), behaviour.activity_sessions)
    return found.where("user_id IS NOT NULL").select("user_id", day("start").alias("start"), day("last").alias("last"), "n")


#: the newest events come first, then the middle ones, then the old ones, which the watermark has left behind
NEW, OLD = "2024-01-20 00:00:00", "2024-01-10 00:00:00"


@query
def late_rows(spark, d):
    """Events that came too late for their day's window. A far later event closes the windows."""
    events = event_time(read_table(spark, d, "events"))
    part = F.when(F.col("user_id").isNull(), 3).when(F.col("ts") >= NEW, 0).when(F.col("ts") >= OLD, 1).otherwise(2)
    landed = behaviour.run_in_parts(behaviour.drained(events), part, behaviour.activity_windows).where("event_type IS NOT NULL")
    return behaviour.late_rows(events, landed)


@query
def upsert_scores(spark, d):
    """The latest value of each borrower, from a stream in four batches that are not in order of time."""
    rows = event_time(read_table(spark, d, "events")).select(F.col("user_id").alias("borrower"), "ts", "event_id", "value")
    path, state = behaviour.shared_folder(spark), behaviour.shared_folder(spark)
    behaviour.in_parts(rows, F.pmod(F.col("event_id"), F.lit(4)), lambda stream: behaviour.upsert_scores(stream, path, state=state))
    return behaviour.latest_scores(spark, path).select("borrower", day("ts").alias("at"), "event_id", "value")


@query
def score_stream(spark, d):
    known = features.borrower_features(read_table(spark, d, "orders"), read_table(spark, d, "lineitem")).select("borrower", "accounts", "exposure")
    return behaviour.run_to_end(behaviour.score_stream(stream(spark, d), known)).select("event_id", "user_id", "accounts", "exposure")


@query
def velocity_alerts(spark, d):
    """Alerts from a stream in three batches that are not in order of time; a far later event sends the last ones."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, behaviour.ROCKSDB)
    try:
        # times reach Python as nanoseconds, which end in 2262
        events = behaviour.drained(event_time(read_table(spark, d, "events")), "TIMESTAMP '2200-01-01 00:00:00'")
        far = F.col("ts") >= F.lit("2200-01-01").cast("timestamp")
        # a null borrower has no alert, so the closing event needs a key of its own
        events = events.withColumns({"user_id": F.when(far, F.lit(-1)).otherwise(F.col("user_id")), "event_id": F.when(far, F.lit(-1)).otherwise(F.col("event_id"))})
        part = F.when(far, 3).otherwise(F.pmod(F.col("event_id"), F.lit(3)))
        found = behaviour.run_in_parts(events, part, lambda stream: behaviour.ordered_alerts(stream, 3, 24 * 3600, "40 days", 10 * 24 * 3600))
    finally:
        spark.conf.set(provider, before)
    return found.where("user_id >= 0")


@query
def dedup_repeats(spark, d):
    """Events of which every third is sent again in a later batch, and every fifth once more long after its id is forgotten: what the stream lets through."""
    events = event_time(read_table(spark, d, "events")).select("event_id", "ts")
    again = events.where("event_id % 3 = 0")
    late = events.where("event_id % 5 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 DAYS"))
    # two later events: the first moves the watermark past what the ids are kept for, the batch of the second forgets them
    marks = spark.sql("SELECT * FROM VALUES (-1L, TIMESTAMP '2024-04-25 00:00:00', 1), (-2L, TIMESTAMP '2024-04-26 00:00:00', 2) AS t(event_id, ts, part)")
    rows = marks
    for k, sent in ((0, events), (1, again), (3, late)):
        rows = rows.unionByName(sent.withColumn("part", F.lit(k)))
    found = behaviour.run_in_parts(rows, F.col("part"), lambda stream: behaviour.dedup_events(stream, "40 days"))
    return found.where("event_id >= 0").groupBy("event_id").agg(F.count("*").alias("times"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))
