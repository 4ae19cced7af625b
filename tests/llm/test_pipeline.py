"""Each stage of the pipeline against brute force on what it was given."""

import math
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontamination, mixing, toxicity
from quillon.llm.common import read
from quillon.llm.sql import OP5, OP10
from tests.llm.test_edges import brute_components


def test_stages(spark, small, tmp_path):
    folder, docs, seen = small, read(spark, small, "documents"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]

    given, kept = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.score(given, toxicity.fit(given, read(spark, folder, "labels"))).where("toxic").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - bad and bad

    given, kept = seen["near_copies"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    want = {d for d, n, c in brute_components(rows) if n == 0 or d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)

    given, kept = seen["decontamination"]
    dirty = {r.doc_id for r in decontamination.contamination(given, read(spark, folder, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - dirty and dirty

    given, kept = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
    assert {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}

    given, sharded = seen["sharding"]
    assert sharded.count() == given.count()
    assert sharded.agg(F.count_distinct("shard")).first()[0] == 8


def test_stages_against_plain_rules(spark, small, tmp_path):
    """Toxicity by loops over words, decontamination and mixing by SQL in another engine, sharding by its law, each on what its predecessor kept."""
    docs, kept = read(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        kept[name] = docs = spark.read.parquet(str(tmp_path / name))

    source = read(spark, small, "documents")
    model = toxicity.fit(source, read(spark, small, "labels"))

    def toxic(text):
        counts = Counter()
        for word in re.findall(r"\w+", (text or "").lower()):
            counts.update(f for f in ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)] if f in model.index)
        z = sum(model.weights[model.index[f]] * math.log1p(n) for f, n in counts.items())
        return 1 / (1 + math.exp(model.thresholds[0] - z)) >= 0.5

    want = sorted(r.doc_id for r in source.collect() if not toxic(r.text))
    assert sorted(r.doc_id for r in kept["toxicity"].collect()) == want and len(want) < source.count()

    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{small}/benchmark.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_copies/*.parquet'")
    clean = sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({OP10}) WHERE NOT contaminated").fetchall())
    assert sorted(r.doc_id for r in kept["decontamination"].collect()) == clean and len(clean) < kept["near_copies"].count()

    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/decontamination/*.parquet'")
    copies = con.sql(f"SELECT doc_id, taken FROM ({OP5.replace('(size * (floor', '(1 * (floor')}) WHERE taken > 0").fetchall()
    assert {r.doc_id: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()} == dict(copies)

    texts = {r.doc_id: (r.text or "").encode() for r in kept["mixing"].collect()}
    rows = kept["sharding"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in kept["mixing"].collect())
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 3 * max(r.size for r in rows)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_run_equals_the_stages(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and {"doc_id", "shard", "slot"} <= set(found.columns)


def test_stages_on_odd_and_empty_tables(spark, small, tmp_path):
    rows = [(i, t, "en", None if i == 2 else "s", 0) for i, t in ((1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "w " * 20_000))]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("key", "n", "row", "_row", "copies", "words", "d", "h")})
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == odd.columns
            out.write.parquet(str(tmp_path / name / stage_name))
            docs = spark.read.parquet(str(tmp_path / name / stage_name))
            assert (name == "none") == (docs.count() == 0), stage_name
