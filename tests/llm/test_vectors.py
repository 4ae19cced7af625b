"""Hard negatives, packing and clustering against brute force, and on odd, repeated and missing rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import centroids, negatives, packing
from quillon.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ["id", "anchor", "vector", "bucket", "row", "length", "n", "k", "score", "part", "cluster", "ids", "_order", "rank"]


def table(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASH})


def counted(rows):
    return Counter(tuple(r) for r in rows)


def mined_by_hand(rows, is_anchor, scale=256, positives=5, negatives_=3):
    kept = []
    for at, (i, v, y) in enumerate(rows):
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((at, i, [math.floor(scale * float(np.float32(x))) for x in v], y))
    out = []
    last = lambda i: (i is None, i or 0)
    for at, i, v, y in kept:
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), last(j), j, z) for o, j, w, z in kept if o != at]
        for s, _, j, _ in sorted((r for r in scored if r[3] == y), key=lambda r: r[:2])[:positives]:
            good = sorted((r for r in scored if r[3] != y and -50 * s <= -100 * r[0] <= -95 * s), key=lambda r: r[:2])
            out += [(i, j, rank, r[2], -s, -r[0]) for rank, r in enumerate(good[:negatives_], 1)]
    return counted(out)


def vector_rows(seed, n=240, dims=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    rows = [(i, (centre[i % 4] * rng.random() * 2 + rng.normal(size=dims) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[5][1], 2), (1000, [0.0] * dims, 1), (1010, [0.5], 2), (1020, [], 0)]
    return rows + [(2000, None, 1), (2010, rows[0][1], None), (2020, [1.0, None], 1), (2030, [float("nan")] * dims, 1), (2040, [float("inf")] * dims, 1)]


@pytest.mark.parametrize("bucket,limit", [(4096, 1 << 14), (16, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, limit):
    """In one bucket and pass, and in many of both."""
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rows = vector_rows(bucket)
    found = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, max_anchors=limit)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert counted(found.collect()) == mined_by_hand(rows, lambda i: i % 10 == 0)


def test_negatives_with_copies_and_small_labels(spark):
    """One vector a third of all rows, labels of one row, fewer positives than asked for."""
    rng = np.random.default_rng(2)
    one = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, one if i % 3 else rng.normal(size=6).astype(np.float32).tolist(), 1 if i % 5 else i) for i in range(150)]
    assert counted(negatives.mine(table(spark, rows), F.col("vec_id") % 7 == 0).collect()) == mined_by_hand(rows, lambda i: i % 7 == 0)
    assert negatives.mine(table(spark, []), F.col("vec_id") % 7 == 0).count() == 0


def test_coordinate_ranges_prune_and_lose_nothing(spark):
    """Vectors of one length near a few directions, so that the third best score is high."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(10, 8))[rng.integers(0, 10, 500)] + 0.1 * rng.normal(size=(500, 8))
    v = np.round(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int32)
    order = np.argsort(v.T, axis=1, kind="stable").astype("<u2")
    longest = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
    bucket = negatives.Bucket(0, np.arange(500), np.zeros(500, int), v, order, np.take_along_axis(v.T, order.astype(int), 1), longest)
    anchors = negatives.Anchors(np.arange(500), np.zeros(500, int), v, np.zeros(500, int), np.arange(500))
    exact = v.astype(np.int64) @ v.T.astype(np.int64)
    need = np.sort(exact, 1)[:, -3]
    seen, scored = {}, 0
    for a, at, s in negatives.scores(bucket, anchors, need, np.ones(500, bool)):
        assert (s == exact[a, at]).all()
        seen[int(a)] = set(at.tolist())
        scored += len(at)
    for a in range(500):
        assert set(np.flatnonzero(exact[a] >= need[a]).tolist()) <= seen.get(a, set())
    assert scored < 0.5 * exact.size


def test_scores_beyond_doubles_are_exact_or_refused(spark):
    big = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2e6, 1.0], 2), (3, [2e6, 3.0], 2)]
    assert counted(negatives.mine(table(spark, big), F.col("vec_id") == 0).collect()) == mined_by_hand(big, lambda i: i == 0)
    with pytest.raises(Exception, match="32 bits"):
        negatives.mine(table(spark, [(0, [1e30], 1), (1, [1e30], 1)]), F.col("vec_id") == 0).collect()


def clustered_by_hand(rows, clusters, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of) if o == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return counted((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize("chunk", [1 << 14, 17])
def test_clusters_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rows = vector_rows(4)
    found = centroids.cluster(table(spark, rows), dims=12, rounds=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert counted(found.collect()) == clustered_by_hand(rows, 8, 4, 12)


def test_clusters_of_few_same_and_no_vectors(spark):
    same = [(i, [0.5, -0.25], 0) for i in range(20)] + [(99, [0.5], 0)]
    assert counted(centroids.cluster(table(spark, same), dims=2, rounds=3).collect()) == clustered_by_hand(same, 8, 3, 2)
    few = same[:2] + [(50, [3.0, 1.0], 1)]
    assert counted(centroids.cluster(table(spark, few), dims=2, rounds=3).collect()) == clustered_by_hand(few, 8, 3, 2)
    assert centroids.cluster(table(spark, [(1, None, 0), (2, [1.0], 0)]), dims=2).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0], 0)]), dims=2).collect()


def test_dictionaries_are_lossless_and_widen_where_vectors_repeat():
    rng = np.random.default_rng(5)
    for vectors, want in ((rng.integers(-900, 900, (400, 16)), 1), (rng.integers(0, 3, (4000, 16)), 4), (np.repeat(rng.integers(-900, 900, (5, 16)), 80, 0), 16)):
        width, entries, codes = centroids.dictionaries(vectors)
        assert width == want
        assert (np.concatenate([e[c] for e, c in zip(entries, codes.T)], 1) == vectors).all()
        assert all(len(np.unique(e, axis=0)) == len(e) for e in entries)


def fewest(sizes, capacity):
    """The least number of sequences, by trying all packings."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(at, fills):
        if len(fills) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(fills)
            return
        for fill in set(fills):
            if fill + sizes[at] <= capacity:
                k = fills.index(fill)
                go(at + 1, fills[:k] + [fill + sizes[at]] + fills[k + 1 :])
        go(at + 1, [*fills, sizes[at]])

    go(0, [])
    return best[0]


def laid_out(packing_):
    """Per sequence its (offset, length) in order; checks that each rank of a length is used once."""
    fills, ranks = {}, {}
    for r in packing_.runs:
        for t in range(r.high - r.low):
            fills.setdefault(r.sequence + t // r.per, []).append((r.offset + t % r.per * r.length, r.length))
            ranks.setdefault(r.length, []).append(r.low + t)
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    return {s: sorted(x) for s, x in fills.items()}, {length: len(x) for length, x in ranks.items()}


def test_every_fixed_set_is_in_a_best_packing():
    rng = random.Random(6)
    rules = 0
    for _ in range(300):
        capacity = rng.randint(5, 30)
        sizes = [rng.randint(rng.choice([1, capacity // 4 or 1, capacity // 3]), capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        least = fewest(sizes, capacity)
        for j in set(sizes):
            found = packing.dominant(counts, j)
            if found is not None:
                rest = Counter(sizes) - Counter([j, *found])
                assert j + sum(found) <= capacity and fewest([*rest.elements()], capacity) + 1 == least
                rules += 1
        made = packing.Packing(Counter(sizes), capacity)
        fills, used = laid_out(made)
        assert used == Counter(sizes) and made.sequences == len(fills)
        assert all(o == sum(n for _, n in f[:k]) for f in fills.values() for k, (o, _) in enumerate(f)) and all(sum(n for _, n in f) <= capacity for f in fills.values())
        assert made.sequences == least
    assert rules > 500


def test_packing_of_many_is_near_its_bound():
    counts = {k: int(1e6 / k**1.3) + 1 for k in range(1, 2049)}
    made = packing.Packing(counts)
    assert made.sequences == -(-sum(k * n for k, n in counts.items()) // 2048) and made.fixed > 0 and len(made.runs) < 20_000
    # more of everything isn't more work: the list of runs depends on the lengths, not on how many there are
    assert len(packing.Packing({k: n * 1_000_000 for k, n in counts.items()}).runs) < 20_000


@pytest.fixture(scope="module")
def files():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


TEXTS = ["", None, " ", "plain words and more words", "café é\U0001f600 123's don't", "<|endoftext|> inside", " " * 5000 + "x", "a" * 3000, "\n" * 1500, "中文 text", " \t x  y\r\n\r\nz"]


def test_both_encoders_agree(files):
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file(files[0])
    for encode in (packing.encoder(*files), packing.encoder(files[0])):
        assert [encode(t or "") for t in TEXTS] == [truth.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def check_pieces(found, docs, files, capacity):
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file(files[0])
    want = Counter()
    for doc, text in docs:
        ids = [*truth.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    for _, group in pd.DataFrame([(r.sequence_id, r.offset, r.length) for r in found], columns=["s", "o", "n"]).sort_values("o").groupby("s"):
        assert group["o"].tolist() == [0, *group["n"].cumsum().tolist()[:-1]] and group["n"].sum() <= capacity


def test_packing_of_odd_texts(spark, files):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same id"), (3, "same id"), (50, "word " * 40_000)] + [(100 + i, "copy of a text") for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("piece", "length", "row", "part", "rank", "n", "k", "sequence_id")}).repartition(3)
    for capacity in (2048, 16):
        found = packing.pack(rows, lambda: packing.encoder(*files), capacity, keep_ids=True)
        check_pieces(found.collect(), docs, files, capacity)
        total = sum(r.length for r in found.collect())
        whole = packing.sequences(found).collect()
        assert sum(len(r.ids) for r in whole) == total and all(len(r.ids) <= capacity and r.ids[-1] is not None and r.starts[0] == 0 for r in whole)
        assert len(whole) <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(rows.limit(0), lambda: packing.encoder(*files)).count() == 0


def test_packing_query(spark, small, files):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    found = QUERIES["op12_best_fit_packing"](spark, small).collect()
    check_pieces(found, list(zip(docs["doc_id"].tolist(), docs["text"].tolist())), files, 2048)
