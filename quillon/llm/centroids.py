"""Exact k-means on integer vectors, with distances looked up in dictionaries of subvectors.

Vectors are stored in chunks. A chunk keeps, for each block of dimensions, its distinct subvectors once, and per vector the number of
its subvector; nothing is rounded away. In a round the distances of a chunk's distinct subvectors to the centroids are computed once, and a
vector's distance is the sum over its blocks of what its numbers look up. New centroids come from how often each subvector is in each
cluster. Dictionaries belong to a chunk, so they are bounded however many vectors there are; what the rounds send
about is the centroids, and per task one sum per cluster and dimension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: vectors of a chunk
CHUNK = 1 << 14
#: blocks are widened while the distinct subvectors are at most this share of all
SHARE = 0.25
#: components from here on would give squared distances beyond a long
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """Whether a vector has no null and no component that is not finite; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(arrays: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of `dims` components, in double arithmetic. Raises where a component is too large for exact distances."""
    out = np.floor(scale * np.asarray(arrays.flatten(), np.float64)).reshape(-1, dims)
    if out.size and np.abs(out).max() >= LARGEST:
        raise OverflowError(f"a component of {np.abs(out).max():.0f} gives squared distances that don't fit in a long")
    return out.astype(np.int64)


def dictionaries(vectors: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """Block width, the distinct subvectors of each block, and the number of each vector's subvector in each block.

    Single dimensions are numbered first; blocks are joined in pairs while the pairs' dictionaries stay small.
    """
    n, dims = vectors.shape
    columns = [np.unique(vectors[:, j], return_index=True, return_inverse=True) for j in range(dims)]
    first, codes, width = [c[1] for c in columns], [c[2] for c in columns], 1
    while dims % (2 * width) == 0:
        pairs = [np.unique(a * (int(b.max()) + 1) + b, return_index=True, return_inverse=True) for a, b in zip(codes[::2], codes[1::2])]
        if sum(len(p[0]) for p in pairs) > SHARE * n * len(pairs):
            break
        first, codes, width = [p[1] for p in pairs], [p[2] for p in pairs], 2 * width
    return width, [vectors[f, k * width : (k + 1) * width] for k, f in enumerate(first)], np.stack(codes, 1)


def encoded(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Chunks of the vectors (id, vector): n, width, ids, sizes (subvectors per block), entries and codes."""
    kind = vectors.schema["id"].dataType
    names, id_type = ["n", "width", "ids", "sizes", "entries", "codes"], to_arrow_type(kind)

    def chunk(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                for at in range(0, rows - CHUNK + 1, CHUNK):
                    yield packed(table.slice(at, CHUNK))
                held = table.slice(rows - rows % CHUNK).to_batches()
                rows %= CHUNK
        if rows:
            yield packed(pa.Table.from_batches(held))

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, rows = table["id"].chunk(0), scaled(table["vector"].chunk(0), dims, scale)
        width, entries, codes = dictionaries(rows)
        values = [len(rows)], [width], [ids], [[len(e) for e in entries]], [np.concatenate(entries).astype("<i4").tobytes()], [codes.astype("<u2").tobytes()]
        types = pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    return vectors.select("id", "vector").mapInArrow(chunk, f"n int, width int, ids array<{kind.simpleString()}>, sizes array<int>, entries binary, codes binary")


def nearest(row: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For a chunk: each vector's cluster and squared distance (ties: the smaller number), the dictionaries and the codes."""
    width, sizes = row["width"].as_py(), np.array(row["sizes"].as_py())
    codes = np.frombuffer(row["codes"].as_buffer(), "<u2").reshape(-1, len(sizes))
    entries = np.split(np.frombuffer(row["entries"].as_buffer(), "<i4").astype(np.int64).reshape(-1, width), np.cumsum(sizes)[:-1])
    total = np.zeros((len(codes), len(centroids)), np.int64)
    for k, (subvectors, numbers) in enumerate(zip(entries, codes.T)):
        partial = ((subvectors[:, None, :] - centroids[None, :, k * width : (k + 1) * width]) ** 2).sum(2)
        total += partial[numbers]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster], entries, codes


def cluster_sums(chunks: DataFrame, centroids: np.ndarray) -> list:
    """Per cluster and dimension the sum of its vectors' components, and at dimension -1 their number, where there are any."""
    k, dims = centroids.shape

    def add(batches):
        sums = [[0] * (dims + 1) for _ in range(k)]
        for b in batches:
            for i in range(b.num_rows):
                cluster, _, entries, codes = nearest({c: b[c][i] for c in b.schema.names}, centroids)
                parts = [np.bincount(cluster, minlength=k)[:, None]]
                for subvectors, numbers in zip(entries, codes.T):
                    times = np.bincount(cluster * len(subvectors) + numbers, minlength=k * len(subvectors)).reshape(k, -1)
                    parts.append(times @ subvectors)
                for have, more in zip(sums, np.concatenate(parts, 1).tolist()):
                    have[:] = [x + y for x, y in zip(have, more)]
        rows = [(c, at - 1, value) for c, have in enumerate(sums) if have[0] for at, value in enumerate(have)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int32(), pa.int64()))], ["cluster", "at", "value"])

    return chunks.select("width", "sizes", "entries", "codes").mapInArrow(add, "cluster int, at int, value long").groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect()


def assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    kind = chunks.schema["ids"].dataType.elementType

    def assign(batches):
        for b in batches:
            for i in range(b.num_rows):
                cluster, distance, _, _ = nearest({c: b[c][i] for c in b.schema.names}, centroids)
                yield pa.RecordBatch.from_arrays([b["ids"][i].values, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return chunks.select("ids", "width", "sizes", "entries", "codes").mapInArrow(assign, f"id {kind.simpleString()}, cluster int, distance long")


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors (`embedding`) of exactly `dims` components, none null or not finite; each component x is floor(scale * x). The first centroids are the vectors
    with the smallest sha256 of `seed:vec_id` (null: `seed:`; ties by components), fewer where there are fewer vectors. Repeated rows are vectors of their own;
    other columns are ignored; an empty table, or one without such a vector, gives no row. A centroid without vectors stays. The number of clusters
    times dimensions bounds what the driver holds. Raises where a component is so large that squared distances exceed a long.
    """
    spark = df.sparkSession
    kept = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where((F.size("vector") == dims) & whole(F.col("vector")))
    chunks = written(encoded(kept, dims, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.withColumn("_order", order).orderBy("_order", F.transform("vector", lambda x: F.floor(scale * x.cast("double")))).limit(clusters).select("vector").toArrow()
    centroids = scaled(first["vector"].combine_chunks(), dims, scale)
    for _ in range(rounds if len(centroids) else 0):
        sums = cluster_sums(chunks, centroids)
        count = {r["cluster"]: r["value"] for r in sums if r["at"] < 0}
        for r in sums:
            if r["at"] >= 0:
                centroids[r["cluster"], r["at"]] = r["value"] // count[r["cluster"]]
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    found = written(assigned(chunks, centroids))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), name) for c, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
