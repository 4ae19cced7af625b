"""Bins, weights of evidence, models and score points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillon.functions.money import bin_of, discrete_cuts, logistic, points, unused
from quillon.sources.sinks import written

#: intercept, and per attribute its expression and coefficient
SCORECARD = (-0.6, (("balance", "balance / 10000", -0.8), ("exposure", "exposure / 500000", 1.2), ("pending", "CASE WHEN status = 'P' THEN 1 ELSE 0 END", 0.3)))


def shares(n: int) -> list[float]:
    return [round(i / n, 10) for i in range(1, n)]


def quantile_bins(df: DataFrame, column: str, n: int, approx: bool = False) -> DataFrame:
    """Adds `bin`, 1 to n, by discrete quantiles of all rows; a value at a cut is in the lower bin, nulls in bin 0. `approx` takes the cuts from a sketch."""
    cuts = discrete_cuts(df, column, shares(n), approx=approx)
    name = unused(df, "_cuts")
    return df.crossJoin(F.broadcast(cuts.withColumnRenamed("cuts", name))).withColumn("bin", bin_of(column, F.col(name))).drop(name)  # cuts: one row


#: ranges of equal width into which values are dealt for a running sum
RANGES = 1000


def binned_counts(df: DataFrame, column: str, n: int, sums: dict[str, Column], by: list[str] | None = None, ends: tuple[float, float] | None = None) -> DataFrame:
    """Per bin of quantile_bins (and `by`): `n` and sums over its rows, from one pass over the rows; nulls are left out.

    Rows are summed per value, and that table is written, so the column should have few distinct values (rounded scores have at most a million). Values are dealt to ranges of
    equal width, between `ends` if they are known; the running sum goes over one sum per range, and then inside each range by itself.
    """
    by = by or []
    counts = written(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"), *[f.alias(k) for k, f in sums.items()]))
    least, most = ends or counts.agg(F.min(column), F.max(column)).first()
    wide = most - least if least is not None and most > least else 1
    dealt = counts.withColumn("_r", F.floor((F.col(column) - F.lit(least or 0)) / F.lit(wide) * RANGES))
    per = dealt.groupBy("_r").agg(F.sum("n").alias("_s"))  # RANGES + 1 rows at most
    starts = per.select("_r", (F.sum("_s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    # rows below the value, over all groups
    upto = F.sum("n").over(Window.partitionBy("_r").orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("_in", upto - F.sum("n").over(Window.partitionBy("_r", column))).join(F.broadcast(starts), "_r").withColumn("_below", F.col("_before") + F.col("_in"))
    # a cut lies below the value if the rows below already reach its share
    bin_ = (1 + sum((F.col("_below") >= F.lit(p) * F.col("_all")).cast("int") for p in shares(n))).cast("long")
    return placed.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])


def woe_iv(binned: DataFrame, label: str) -> DataFrame:
    """Per bin: goods, bads, weight of evidence with half a row added to each count, and its part of the information value."""
    per = binned.groupBy("bin").agg(F.count_if(F.col(label) == 0).alias("goods"), F.count_if(F.col(label) == 1).alias("bads"))
    total = per.agg(F.sum("goods").alias("_g"), F.sum("bads").alias("_b"))
    g, b = (F.col("goods") + 0.5) / (F.col("_g") + 0.5), (F.col("bads") + 0.5) / (F.col("_b") + 0.5)
    return per.crossJoin(F.broadcast(total)).select("bin", "goods", "bads", F.round(F.log(g / b), 6).alias("woe"), F.round((g - b) * F.log(g / b), 6).alias("iv"))  # total: one row


def split(accounts: DataFrame, as_of: str, key: str = "account", time: str = "opened") -> DataFrame:
    """Adds `part`: out_of_time from the date on, else holdout for three keys in ten, else train."""
    part = F.when(F.col(time) >= F.lit(as_of).cast("timestamp_ntz"), "out_of_time").when(F.pmod(F.col(key), F.lit(10)) < 3, "holdout").otherwise("train")
    return accounts.withColumn("part", part)


def woe_table(train: DataFrame, columns: list[str], label: str = "label", n: int = 10) -> dict[str, tuple[list, dict[int, float]]]:
    """Per column its cuts and the weight of evidence of each bin, from the training rows: a few numbers a column, held by the caller."""
    out = {}
    for c in columns:
        cuts = discrete_cuts(train, c, shares(n)).first()
        cuts = list(cuts["cuts"]) if cuts else []
        binned = train.withColumn("bin", bin_of(c, F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")))
        out[c] = cuts, {r["bin"]: r["woe"] for r in woe_iv(binned, label).collect()}  # at most n + 1 rows
    return out


def with_woe(df: DataFrame, table: dict[str, tuple[list, dict[int, float]]]) -> DataFrame:
    """Adds `<column>_woe`. A null has the weight of the training nulls; a bin that training never saw has 0, no evidence."""
    for c, (cuts, weights) in table.items():
        at = bin_of(c, F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"))
        woe = F.lit(0.0)
        for b, w in weights.items():
            woe = F.when(at == b, F.lit(w)).otherwise(woe)
        df = df.withColumn(f"{c}_woe", woe)
    return df


def fit_pd(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Logistic model of the default probability on standardised features. Rows with a null feature or label are no training rows."""
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, regParam=1e-4, maxIter=50)]
    return Pipeline(stages=stages).fit(train.dropna(subset=[*features, label]))


def fit_challenger(train: DataFrame, features: list[str], label: str = "label", seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees on the same features, and on the same rows."""
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=10, maxDepth=3, seed=seed)]
    return Pipeline(stages=stages).fit(train.dropna(subset=[*features, label]))


def score_batch(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds `pd` by a fitted model, partition by partition. Every row stays; one with a null feature has a null pd (impute or bin it first)."""
    drop = [c for c in ("_x", "_z", "rawPrediction", "probability", "prediction") if c not in df.columns]
    features = model.stages[0].getInputCols()
    known = F.lit(True)
    for c in features:
        known &= F.col(c).isNotNull()
    return model.transform(df).withColumn("pd", F.when(known, vector_to_array("probability")[1])).drop(*drop)


def score_foreign(df: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray], features: list[str]) -> DataFrame:
    """Adds `pd` by a model of another library, given as a function from a frame of the features to scores, in Arrow batches. It is sent to the tasks with them. Rows with a null feature have a null pd."""

    @F.pandas_udf("double")
    def scored(columns: pd.DataFrame) -> pd.Series:
        whole = columns.notna().all(axis=1)
        out = pd.Series(np.nan, index=columns.index)
        if whole.any():
            out[whole] = np.asarray(predict(columns[whole]), float)
        return out

    found = scored(F.struct(*features))
    return df.withColumn("pd", found).withColumn("pd", F.when(~F.isnan("pd"), F.col("pd")))


def score_loaded(df: DataFrame, make_model: Callable[[], Callable[..., np.ndarray]], features: list[str], batch: int = 4096) -> DataFrame:
    """Adds `pd` by a model of another library, in numpy batches of `batch` rows. `make_model` is called once a worker, so a large model is read there and not sent with the rows; it
    returns a function from one array per feature to scores. Rows with a null feature are not given to it; their pd is null.
    """

    def load():
        model = make_model()

        def predict(rows: np.ndarray) -> np.ndarray:
            known = ~np.isnan(rows).any(axis=1)
            out = np.full(len(known), np.nan)
            if known.any():
                out[known] = model(*rows[known].T)
            return out

        return predict

    score = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[len(features)]])
    found = score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]))
    return df.withColumn("pd", found).withColumn("pd", F.when(~F.isnan("pd"), F.col("pd")))


def fit_counts(rows: DataFrame, features: list[str], label: str, steps: int = 8) -> dict[str, float]:
    """Coefficients (`intercept` and one per feature) of the logistic model without a penalty, by `steps` Newton steps.

    Rows are counted once per combination of feature values, which for weights of evidence are few however many rows there are; a step is one aggregate over the combinations: the
    Gram matrix and the gradient, of a size that the number of features sets. Rows with a null feature or label don't count. Where the matrix has no inverse (a feature that doesn't
    vary, or a combination of others) the shortest step is taken; without rows all coefficients are 0.
    """
    names = ["intercept", *features]
    known = rows.dropna(subset=[*features, label])
    counts = known.groupBy(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(features, 1)]).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_bads"))
    counts = written(counts).withColumn("_x0", F.lit(1.0))
    x = [F.col(f"_x{i}") for i in range(len(names))]
    beta = np.zeros(len(names))
    for _ in range(steps):
        p = logistic(sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0)))
        off, weight = F.col("_bads") - F.col("_n") * p, F.col("_n") * p * (F.lit(1.0) - p)
        pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
        row = counts.agg(*[F.sum(weight * x[i] * x[j]) for i, j in pairs], *[F.sum(off * c) for c in x]).first()
        if row[0] is None:
            break
        gram = np.zeros((len(x), len(x)))
        for (i, j), value in zip(pairs, row):
            gram[i, j] = gram[j, i] = value
        beta = beta + np.linalg.pinv(gram) @ np.array(row[len(pairs) :], float)
    return dict(zip(names, beta.tolist()))


def log_odds(card=SCORECARD) -> Column:
    z = F.lit(card[0])
    for _, value, weight in card[1]:
        z = z + F.lit(weight) * F.expr(value)
    return z


def apply_scorecard(accounts: DataFrame, card=SCORECARD) -> DataFrame:
    """Adds pd and points from given coefficients, both rounded to 6 decimals, by column arithmetic alone. Null attributes give nulls; where the probability is 0 or 1 as a double, the points are null."""
    odds = logistic(log_odds(card))
    return accounts.withColumns({"pd": F.round(odds, 6), "points": F.round(points(odds), 6)})


def reason_codes(accounts: DataFrame, k: int = 2, card=SCORECARD) -> DataFrame:
    """Per account the k attributes that add most to its log-odds of default, in order; ties by name. A null attribute adds nothing."""
    parts = F.array(*[F.struct((-F.coalesce(F.round(F.lit(w) * F.expr(v), 9), F.lit(0.0))).alias("order"), F.lit(name).alias("name")) for name, v, w in card[1]])
    return accounts.select("account", F.array_join(F.transform(F.slice(F.array_sort(parts), 1, k), lambda p: p["name"]), ",").alias("reasons"))


def rank_within(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
