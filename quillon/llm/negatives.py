"""Hard negatives by inner product, searched in length buckets with pruned coordinates.

Vectors are sorted by length and cut into buckets; a bucket holds its vectors' integer components and, per coordinate, its vectors in
order of that component. An anchor q that still needs a score of at least t takes from a bucket of largest length L only vectors whose component at
coordinate f can be part of such a score: with q[f] = |q| cos a and d = arccos(t / (|q| L)) that is L cos(a + d) to L cos(a - d). The ranges of the
anchor's largest coordinates are looked up in the sorted lists and intersected, and what is left is scored exactly. The score that is needed rises with what has been found,
longest bucket first. The same search finds the positives (the best of the same label) and then, within bounds set by each positive's score, the negatives.

Anchors go to the tasks in passes of at most MAX_ANCHORS; each pass reads all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.centroids import whole
from quillon.llm.common import written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: vectors of a bucket, coordinates that are looked up per anchor, anchors of a pass
BUCKET, FOCUS, MAX_ANCHORS = 4096, 3, 1 << 14
#: stands for a missing id, which comes last among ties
NO_ID = np.iinfo(np.int64).max
#: below every score; its negative is a long too
LEAST = -NO_ID


class Bucket(NamedTuple):
    """Vectors of similar length: `order[f]` lists them by component f, whose values are then `sorted[f]`."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    sorted: np.ndarray
    longest: float


def scaled(arrays: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) as rows of one matrix, zeros where a vector is shorter than the longest."""
    at = arrays.offsets.to_numpy()
    sizes = np.diff(at)
    flat = np.floor(scale * np.asarray(arrays.flatten(), np.float64))
    if flat.size and np.abs(flat).max() >= 1 << 31:
        raise OverflowError("a component doesn't fit in 32 bits after scaling")
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def widened(vectors: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1]))) if vectors.shape[1] < dims else vectors


def buckets(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (id, label, anchor, vector) as buckets by falling length: bucket, ids, labels, anchors, vectors (32-bit components) and orders (16-bit positions per coordinate)."""
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("length", length).repartitionByRange(F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"))

    def cut(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BUCKET:
                table = pa.Table.from_batches(held)
                for at in range(0, n - BUCKET + 1, BUCKET):
                    yield packed(table.slice(at, BUCKET))
                held = table.slice(n - n % BUCKET).to_batches()
                n %= BUCKET
        if n:
            yield packed(pa.Table.from_batches(held))

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        vectors = scaled(table["vector"].chunk(0), scale)
        orders = np.argsort(vectors.T, axis=1, kind="stable").astype("<u2")
        lists = [[table[c].chunk(0)] for c in ("id", "label", "anchor")]
        types = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*lists, [vectors.tobytes()], [orders.tobytes()]], types)], ["ids", "labels", "anchors", "vectors", "orders"])

    made = dealt.select("id", "label", "anchor", "vector").mapInArrow(cut, "ids array<long>, labels array<long>, anchors array<boolean>, vectors binary, orders binary")
    return made.withColumn("bucket", F.monotonically_increasing_id())


def opened(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Bucket]:
    """The buckets of a task, with at least `dims` coordinates."""
    for b in batches:
        for i in range(b.num_rows):
            ids = b["ids"][i].values
            vectors = np.frombuffer(b["vectors"][i].as_buffer(), "<i4").reshape(len(ids), -1)
            order = np.frombuffer(b["orders"][i].as_buffer(), "<u2").reshape(-1, len(ids))
            if vectors.shape[1] < dims:
                order = np.concatenate([order, np.tile(np.arange(len(ids), dtype="<u2"), (dims - len(order), 1))])
                vectors = widened(vectors, dims)
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max()))
            yield Bucket(b["bucket"][i].as_py(), ids.fill_null(NO_ID).to_numpy(), b["labels"][i].values.to_numpy(), vectors, order, np.take_along_axis(vectors.T, order.astype(np.int64), 1), longest)


class Anchors(NamedTuple):
    """The anchors of a pass, and where each is stored: (bucket, place)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    bucket: np.ndarray
    place: np.ndarray


def scores(bucket: Bucket, anchors: Anchors, need: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each wanted anchor (anchor, positions in the bucket, their exact scores): all positions whose score is at least what the anchor needs, and maybe others."""
    dims = bucket.vectors.shape[1]
    q = widened(anchors.vectors, dims).astype(np.float64)
    lengths = np.sqrt((q**2).sum(1))
    reach = lengths * bucket.longest
    if reach.max(initial=0) >= 1 << 63:
        raise OverflowError("a score doesn't fit in a long")
    exact = np.float64 if reach.max(initial=0) < 1 << 53 else np.int64
    vectors = bucket.vectors.astype(exact)
    act = np.flatnonzero(wanted & (need <= reach * (1 + 1e-9) + 1))
    if not len(act):
        return
    q, lengths, reach, need = q[act], lengths[act], reach[act], need[act].astype(np.float64)
    focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :FOCUS]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.arccos(np.clip(np.nan_to_num(np.take_along_axis(q, focus, 1) / lengths[:, None]), -1, 1))
        d = np.arccos(np.clip(np.where(reach > 0, need / reach, np.where(need > 0, 1.0, -1.0)), -1, 1))[:, None]
    slack = 1e-6 * bucket.longest + 1e-6
    low, high = bucket.longest * np.cos(np.minimum(np.pi, a + d)) - slack, bucket.longest * np.cos(np.maximum(0, a - d)) + slack
    begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for f in np.unique(focus):
        at = focus == f
        begin[at], end[at] = np.searchsorted(bucket.sorted[f], low[at], "left"), np.searchsorted(bucket.sorted[f], high[at], "right")
    narrow = (end - begin).argmin(1)
    rows = np.arange(len(act))
    few = (end - begin)[rows, narrow] * 4 < len(bucket.ids)
    for k in np.flatnonzero(few).tolist():
        f = focus[k, narrow[k]]
        found = bucket.order[f, begin[k, narrow[k]] : end[k, narrow[k]]]
        for j in range(focus.shape[1]):
            if j != narrow[k]:
                x = bucket.vectors[found, focus[k, j]]
                found = found[(x >= low[k, j]) & (x <= high[k, j])]
        if len(found):
            yield act[k], found.astype(np.int64), (vectors[found] @ q[k].astype(exact)).astype(np.int64)
    everything = np.arange(len(bucket.ids))
    many = np.flatnonzero(~few)
    for at in range(0, len(many), 256):  # ranges that hold most of a bucket are scored together
        part = many[at : at + 256]
        block = (q[part].astype(exact) @ vectors.T).astype(np.int64)
        for k, row in zip(part.tolist(), block):
            yield act[k], everything, row


def first(n: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the n best scores, ties by smaller id, best first."""
    if len(score) > 4 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:n]]
    return np.lexsort((ids, -score))[:n]


def best_positives(chunks: DataFrame, anchors: Anchors, n: int) -> DataFrame:
    """anchor (its number in the pass), k, score, id: the n best rows of the anchor's label other than itself, k from 1."""
    sent = chunks.sparkSession.sparkContext.broadcast(tuple(anchors))  # plain arrays: workers need no import to read them

    def find(batches):
        q = Anchors(*sent.value)
        have_s, have_i = np.full((len(q.ids), n), LEAST), np.full((len(q.ids), n), NO_ID)
        for b in opened(batches, q.vectors.shape[1]):
            for a, at, s in scores(b, q, have_s[:, -1], np.isin(q.labels, b.labels)):
                keep = (b.labels[at] == q.labels[a]) & (s >= have_s[a, -1])
                if q.bucket[a] == b.number:
                    keep &= at != q.place[a]
                at, s = at[keep], s[keep]
                if len(at):
                    s, i = np.concatenate([have_s[a], s]), np.concatenate([have_i[a], b.ids[at]])
                    top = first(n, s, i)
                    have_s[a], have_i[a] = s[top], i[top]
        a, k = np.nonzero(have_s > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(have_s[a, k]), pa.array(have_i[a, k])], ["anchor", "score", "id"])

    local = chunks.select("bucket", "ids", "labels", "vectors", "orders").mapInArrow(find, "anchor int, score long, id long")
    return local.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))).where(F.col("k") <= n)


def best_negatives(chunks: DataFrame, anchors: Anchors, low: np.ndarray, high: np.ndarray, n: int) -> DataFrame:
    """anchor, k (the positive's), rank, score, id: the n best rows of another label whose score is between low[anchor, k] and high[anchor, k]."""
    sent = chunks.sparkSession.sparkContext.broadcast((tuple(anchors), low, high))

    def find(batches):
        stored, low, high = sent.value
        q, open_ = Anchors(*stored), low <= high
        have_s, have_i = np.full((*low.shape, n), LEAST), np.full((*low.shape, n), NO_ID)
        need, most = np.where(open_, low, NO_ID).min(1), np.where(open_, high, LEAST).max(1)
        for b in opened(batches, q.vectors.shape[1]):
            for a, at, s in scores(b, q, need, open_.any(1)):
                keep = (s >= need[a]) & (s <= most[a]) & (b.labels[at] != q.labels[a])
                at, s = at[keep], s[keep]
                if not len(at):
                    continue
                i = b.ids[at]
                order = np.lexsort((i, -s))
                s, i = s[order], i[order]
                for k in np.flatnonzero(open_[a]).tolist():
                    begin = np.searchsorted(-s, -high[a, k], "left")
                    take = slice(begin, min(begin + n, np.searchsorted(-s, -low[a, k], "right")))
                    if take.stop > take.start and s[take.start] >= have_s[a, k, -1]:
                        more_s, more_i = np.concatenate([have_s[a, k], s[take]]), np.concatenate([have_i[a, k], i[take]])
                        top = np.lexsort((more_i, -more_s))[:n]
                        have_s[a, k], have_i[a, k] = more_s[top], more_i[top]
                need[a] = np.where(open_[a], np.maximum(low[a], have_s[a, :, -1]), NO_ID).min()
        a, k, r = np.nonzero(have_s > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(k + 1, pa.int32()), pa.array(have_s[a, k, r]), pa.array(have_i[a, k, r])], ["anchor", "k", "score", "id"])

    local = chunks.select("bucket", "ids", "labels", "vectors", "orders").mapInArrow(find, "anchor int, k int, score long, id long")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)


def stored_anchors(chunks: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """All anchors (part, bucket, place, id, label, vector), dealt into parts of at most `limit`, and the number of parts."""

    def take(batches):
        names, types = ["bucket", "place", "id", "label", "vector"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            for i in range(b.num_rows):
                at = np.flatnonzero(np.asarray(b["anchors"][i].values))
                vectors = np.frombuffer(b["vectors"][i].as_buffer(), "<i4").reshape(len(b["anchors"][i].values), -1)
                ids, labels = (b[c][i].values.take(pa.array(at)) for c in ("ids", "labels"))
                values = np.full(len(at), b["bucket"][i].as_py()), at, ids, labels, [vectors[k].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    rows = written(chunks.select("bucket", "ids", "labels", "anchors", "vectors").mapInArrow(take, "bucket long, place int, id long, label long, vector binary"))
    parts = max(1, -(-2 * rows.count() // limit)) if rows.count() > limit else 1
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("bucket", "place"), F.lit(parts)).cast("int"))
        if parts == 1 or dealt.groupBy("part").count().agg(F.max("count")).first()[0] <= limit:
            return (dealt if parts == 1 else written(dealt.repartitionByRange("part").sortWithinPartitions("part"))), parts
        parts *= 2


def loaded(rows: DataFrame) -> Anchors:
    """A part's anchors, in the order of where they are stored."""
    table = rows.select("bucket", "place", "id", "label", "vector").toArrow().sort_by([("bucket", "ascending"), ("place", "ascending")])
    vectors = [np.frombuffer(v, "<i4") for v in table["vector"].to_pylist()]
    dims = max((len(v) for v in vectors), default=1)
    matrix = np.zeros((len(vectors), dims), np.int32)
    for row, v in zip(matrix, vectors):
        row[: len(v)] = v
    ids = table["id"].combine_chunks().fill_null(NO_ID)
    return Anchors(ids.to_numpy(), table["label"].to_numpy(), matrix, table["bucket"].to_numpy(), table["place"].to_numpy())


def mine(df: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """Per anchor, each of its best `positives` rows of the same label and the best `negatives` rows of another label that score between `low` and `high` hundredths of the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows (vec_id, label, embedding) with a null label, a null vector or a component that is null or not finite take no part. Components are floor(scale * x); a score is an integer inner
    product, where a shorter vector counts as filled up with zeros; ties go to the smaller vec_id, a null one last. Rows that repeat an id are rows of their own. Pairs of an anchor and a
    positive without a negative in range give no row, so a positive score below zero gives none. Other columns are ignored; an empty table gives no row. Raises where
    scores don't fit in a long.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("vector"))
    chunks = written(buckets(rows.where(F.col("label").isNotNull() & whole(F.col("vector"))), scale))
    stored, parts = stored_anchors(chunks, max_anchors)
    found = []
    for part in range(parts):
        anchors = loaded(stored.where(F.col("part") == part))
        best = best_positives(chunks, anchors, positives).select("anchor", "k", "score", "id").toArrow()
        a, k = best["anchor"].to_numpy(), best["k"].to_numpy() - 1
        score = np.full((len(anchors.ids), positives), LEAST)
        ids = np.full(score.shape, NO_ID)
        score[a, k], ids[a, k] = best["score"].to_numpy(), best["id"].to_numpy()
        ranges = [[(-(-low * s // 100), high * s // 100) if s != LEAST else (0, -1) for s in row] for row in score.tolist()]
        bounds = np.array(ranges, np.int64).reshape(-1, positives, 2)
        mined = best_negatives(chunks, anchors, bounds[:, :, 0], bounds[:, :, 1], negatives)
        pairs = pa.table({"anchor": a.astype(np.int32), "k": (k + 1).astype(np.int32), "anchor_id": anchors.ids[a], "positive_id": ids[a, k], "positive_score": score[a, k]})
        named = spark.createDataFrame(pairs, "anchor int, k int, anchor_id long, positive_id long, positive_score long")
        missing = F.lit(int(NO_ID))
        columns = "anchor_id", F.nullif("positive_id", missing).alias("positive_id"), "rank", F.nullif("id", missing).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        found.append(written(mined.join(named, ["anchor", "k"]).select(*columns)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
