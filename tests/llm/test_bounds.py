"""What may not grow: rows taken to the driver, files of small tables, and the time of deeply nested pages."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, html_extraction, toxicity
from quillon.llm.common import shared_folder
from quillon.llm.components import components


@pytest.mark.parametrize("texts", [1, 50_000])
def test_labelled_sample_is_bounded_by_rows(spark, monkeypatch, texts):
    """Three labelled ids that 60,000 documents repeat, with one text each or with many."""
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    word = F.when(F.col("id") % 3 + 1 == 2, "vile").otherwise("kind")
    docs = spark.range(60_000).select((F.col("id") % 3 + 1).alias("doc_id"), F.concat_ws(" ", word, F.lit("words of text"), (F.col("id") % texts).cast("string")).alias("text"))
    taken = []
    write = toxicity.written

    def counting(df):
        out = write(df)
        taken.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "written", counting)
    model = toxicity.fit(docs, labels, rows=100)
    assert 60 <= taken[0] <= 150
    found = {r.doc_id: r.toxic for r in toxicity.score(docs.limit(3), model).collect()}
    assert found == {1: False, 2: True, 3: False}


@pytest.mark.parametrize("shape", [
    lambda n: "<section><article>" + "<b>" * n + "</section>" * n,
    lambda n: "<ul>" + "<div>" * n + "<li>x" * n,
    lambda n: "<table>" * n + "</b>" * n + "<td>x" * n,
    lambda n: "<p>x" * n + "</i>" * n,
    lambda n: "<div>" * n + "text" + "</div>" * n,
])
def test_time_of_a_page_is_in_proportion_to_its_size(shape):
    began = time.time()
    html_extraction.parse(shape(16_000))
    assert time.time() - began < 2.5


@pytest.mark.parametrize("rows", [None, 100])
def test_files_of_components_grow_with_links_and_not_with_partitions(spark, monkeypatch, rows):
    """Each file that a task writes starts processes on its executor; 300 links in 40 shuffle partitions need one file, or a file for each `rows`."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    known = set(folder.iterdir())
    if rows:
        monkeypatch.setattr(common, "ROWS_A_FILE", rows, raising=False)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(100 * c, 100 * c + k) for c in range(4) for k in range(1, 76)], "a long, b long")
        found = {r.node: r.root for r in components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {100 * c + k: 100 * c for c in range(4) for k in range(1, 76)}
    files = [len(list(table.glob("part-*"))) for table in set(folder.iterdir()) - known]
    assert len(files) > 1
    assert max(files) == (-(-300 // rows) if rows else 1)
