"""Orders over all rows that no task sees as a whole, and the ways beyond what is sent to the tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, sharding, url_filter
from quillon.llm.common import in_order
from tests.llm.test_edges import brute_components, brute_targets, documents


@pytest.fixture
def ranges(spark):
    """Sorts of small tables stay in several ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_places_and_running_sums_go_on_over_ranges(spark, ranges):
    rng = random.Random(8)
    rows = [(f"k{i:04d}", rng.randrange(100), float(rng.randrange(9))) for i in range(1000)]
    shuffled = rng.sample(rows, len(rows))
    found = in_order(spark.createDataFrame(shuffled, "k string, a long, b double").repartition(7), ["k"], ("a", "b"))
    want, a, b = [], 0, 0.0
    for i, (k, x, y) in enumerate(rows):
        want.append((k, x, y, i, a, b))
        a, b = a + x, b + y
    assert sorted(map(tuple, found.collect())) == want
    assert in_order(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_targets_of_many_sources(spark, ranges):
    rng = random.Random(9)
    sizes = {s: rng.choice([0, 1, 10, 100, 5000]) for s in [None, *(f"site{rng.randrange(10**6)}" for _ in range(800))]}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    assert {r.source: r.target for r in mixing.source_targets(frame).collect()} == pytest.approx(brute_targets(sizes))


def test_name_ranks_are_spread_evenly(spark, ranges):
    rows = [(i, f"={i * 37 % 300:05d}", "=en", float(i), 1, 1) for i in range(300)]
    points = spark.createDataFrame(rows, "point long, source string, lang string, log_size double, weight long, copies long")
    found = {r.point: (r.source, r.lang, r.log_size) for r in sharding._coordinates(points).collect()}
    assert found == {i: (pytest.approx((i * 37 % 300) / 299), 0.0, pytest.approx(i / 299)) for i in range(300)}


@pytest.mark.parametrize("operator", [lambda s: mixing.source_targets(s), lambda s: in_order(s, ["source"])])
def test_no_task_takes_all_sources(spark, ranges, operator):
    """Only sums per range go through one task: below each exchange to one partition stands an aggregate."""
    frame = spark.range(500).select(F.concat(F.lit("s"), "id").alias("source"), F.col("id").alias("source_size"))
    plan = operator(frame)._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        if "SinglePartition" in line:
            assert any("Aggregate" in x for x in plan[i + 1 : i + 3]), "\n".join(plan)


def test_jaccard_beyond_the_named_texts(spark, monkeypatch):
    """More texts to verify than are sent to the tasks: they are joined instead, with the same links."""
    rng = random.Random(10)
    rows = []
    for i in range(90):
        words = rows[rng.randrange(i)][1].split() if i % 3 and i else [f"v{rng.randrange(500)}" for _ in range(60)]
        words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (None, None)]
    monkeypatch.setattr(jaccard, "MAX_NAMED", 0)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(d, n, c if n else d) for d, n, c in brute_components(rows)]
    assert sorted(map(tuple, jaccard.near_duplicates(documents(spark, rows)).collect()), key=key) == sorted(want, key=key)


def test_urls_of_many_batches_and_empty_parts(spark):
    """Places are those of the page's own keys, wherever an Arrow batch cuts."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, None if i % 5 == 0 else f"http://{'a.' * (i % 4)}h{i % 9}.org/{'de/' if i % 2 else 'x'}{i}") for i in range(400)]
        rules = (("block", "org", "/de/"), ("allow", "h3.org", "/"), ("block", "a.h4.org", "/x"))
        found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, "none").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def plain(url):
        host, _, path = (url or "://").split("://")[1].partition("/")
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fits)[2:] if fits else (None, "none")

    assert found == {i: plain(u) for i, u in rows}
