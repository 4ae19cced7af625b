"""Toxicity by cumulative-link ordinal regression on sparse text features.

A grade y from 0 (clean) to 3 has P(y > k) = sigmoid(w . x - t_k) with one weight
vector and increasing thresholds t_0 < t_1 < t_2; the expected severity is the sum of
P(y > k). Features are words and the beginnings of words, valued log(1 + count), so inflected forms of an insult share
weights. The label table only says toxic or not; a toxic row's grade comes from how many
of its words hardly ever occur in clean rows.

The model is fitted on at most `rows` labelled documents, chosen by a spread of their ids; every
document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import md5_int, written

GRADE_FROM = (1, 3, 6)  # telling words that make a toxic row grade 1, 2, 3
PREFIXES = (4, 5, 6)
MAX_LABELLED = 12_000
FEATURES = 3_000
_WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def text_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORDS.findall((text or "").lower())).items():
        for f in word_features(word):
            out[f] += n
    return out


@dataclass
class OrdinalModel:
    """index: feature to column; weights; thresholds, increasing. Without any feature no document is judged toxic."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, z: np.ndarray) -> np.ndarray:
        """P(y > k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """w . x of each text; most words have no feature, which is looked up once per word."""
        known: dict[str, tuple[int, ...]] = {}
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            counts: dict[int, int] = {}
            for word, n in Counter(_WORDS.findall(text.lower())).items() if text else ():
                at = known.get(word)
                if at is None:
                    if len(known) > 100_000:
                        known.clear()
                    at = known[word] = tuple(self.index[f] for f in word_features(word) if f in self.index)
                for j in at:
                    counts[j] = counts.get(j, 0) + n
            if counts:
                out[i] = math.fsum(self.weights[j] * math.log1p(c) for j, c in sorted(counts.items()))
        return out


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, steps: int = 400, rate: float = 0.1, decay: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam over all rows; the design matrix is sparse (rows, cols, values)."""
    n, top = len(grades), len(GRADE_FROM)
    share = [np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(top)]
    first = [math.log((1 - s) / s) for s in share]
    # thresholds as a first one and logs of the gaps, so that they stay ordered
    p = np.concatenate([np.zeros(features), [first[0]], [math.log(max(1e-2, b - a)) for a, b in zip(first, first[1:])]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, t = p[:features], np.cumsum(np.concatenate([p[features : features + 1], np.exp(p[features + 1 :])]))
        z = np.bincount(rows, values * w[cols], n)
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -50, 50))), np.zeros((n, 1))])
        here = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[at, grades], slope[at, grades + 1]
        dz = -(up - down) / here / n
        g = np.zeros_like(p)
        g[:features] = np.bincount(cols, values * dz[rows], features) + decay * w
        dt = np.array([(np.where(grades == k + 1, up, 0) - np.where(grades == k, down, 0)) @ (1 / here) / n for k in range(top)])
        g[features] = dt.sum()
        g[features + 1 :] = [dt[k:].sum() * math.exp(p[features + k]) for k in range(1, top)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:features], np.cumsum(np.concatenate([p[features : features + 1], np.exp(p[features + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED, features: int = FEATURES) -> OrdinalModel:
    """Fits on about `rows` labelled documents at most; the labels sent to the executors and the rows taken to the driver are bounded by it.

    Of labels that repeat for an id the greatest counts; documents that repeat an id are each a row. Where ids repeat so much that the chosen labels have more than twice `rows` documents, these are
    sampled in turn: of n documents of one id and text n * share are taken, rounded down or up by the text's hash. Labels or ids that are null teach nothing; null texts have
    no features. Without rows of both classes the model judges nothing toxic. The sample is written to the checkpoint folder.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = 16**8 if total <= rows else int(16**8 * rows / total)
    chosen = known.where(md5_int(F.col("doc_id")) < share)
    found = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    if found > 2 * rows:
        same = sample.groupBy("doc_id", "text", "toxic").agg(F.count("*").alias("n"))
        spread = md5_int(F.concat_ws("\n", F.col("doc_id").cast("string"), "text")) / float(16**8)
        take = F.floor(F.col("n") * (rows / found) + spread).cast("int")
        sample = same.withColumn("take", take).where("take > 0").select("doc_id", "text", "toxic", F.explode(F.sequence(F.lit(1), F.col("take")))).drop("col")
    sample = written(sample)

    def frequencies(batches):
        seen: dict[tuple[str, int], int] = {}
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                for f in text_features(text):
                    seen[f, toxic] = seen.get((f, toxic), 0) + 1
        yield pd.DataFrame([(f, t, n) for (f, t), n in seen.items()], columns=["feature", "toxic", "n"])

    sizes = {int(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return OrdinalModel({}, np.zeros(0), np.array([50.0] * len(GRADE_FROM)))
    counts = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInPandas(frequencies, "feature string, toxic int, n long")
    n0, n1 = float(sizes[0]), float(sizes[1])
    table = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where("a >= 3")
    lift = F.log(((F.col("a") + 0.5) / n1) / ((F.col("b") + 0.5) / n0))
    best = table.withColumn("score", lift * F.sqrt("a")).orderBy(F.desc("score"), "feature").limit(features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}
    telling = {i for i, r in enumerate(best) if r["feature"][0] == "=" and r["b"] / n0 <= 0.02 * r["a"] / n1}

    def design(batches):
        for b in batches:
            out = []
            for doc, text, toxic in zip(b["doc_id"], b["text"], b["toxic"]):
                at = sorted((index[f], n) for f, n in text_features(text).items() if f in index)
                out.append((doc, int(toxic > 0), [i for i, _ in at], [n for _, n in at]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "at", "n"])

    data = sample.mapInPandas(design, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, at array<int>, n array<int>").toArrow().combine_chunks()  # bounded by rows
    # in an order that doesn't depend on the tasks
    data = data.take(np.lexsort((np.asarray([hash(tuple(x)) for x in data["at"].to_pylist()]), data["doc_id"].to_numpy())))
    length = np.asarray(pc.list_value_length(data["at"]), np.int64)
    at, n = (np.asarray(pc.list_flatten(data[c])) for c in ("at", "n"))
    row = np.repeat(np.arange(len(data)), length)
    hits = np.bincount(row, n * np.isin(at, list(telling)), len(data))
    grades = np.where(data["toxic"].to_numpy() == 0, 0, np.maximum(1, (hits[:, None] >= np.array(GRADE_FROM)).sum(1)))
    weights, thresholds = fit_cumulative_link(row, at, np.log1p(n), grades, len(index))
    return OrdinalModel(index, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Adds to doc_id: severity (expected grade), grade (most probable), p_toxic and toxic (p_toxic of at least 0.5).

    Null and empty texts have no features and get what the thresholds alone give. Repeated rows are scored alike; an empty
    table gives an empty result; without labels of both classes no document is toxic.
    """

    def judged(batches):
        for b in batches:
            above = model.exceeds(model.scores(b["text"].tolist()))
            cells = np.hstack([np.ones((len(b), 1)), above]) - np.hstack([above, np.zeros((len(b), 1))])
            yield pd.DataFrame({"doc_id": b["doc_id"], "severity": above.sum(1), "grade": cells.argmax(1), "p_toxic": above[:, 0], "toxic": above[:, 0] >= 0.5})

    return docs.select("doc_id", "text").mapInPandas(judged, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, grade int, p_toxic double, toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """The documents that aren't judged toxic, with their columns; row by row, so nothing is joined."""
    model = fit(docs if fitted_on is None else fitted_on, labels)

    def kept(batches):
        for b in batches:
            toxic = model.exceeds(model.scores(b.column("text").to_pylist()))[:, 0] >= 0.5
            yield b.filter(pa.array(~toxic))

    return docs.mapInArrow(kept, docs.schema)
