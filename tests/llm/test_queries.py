"""The registered queries against SQL, and those without SQL against brute force, on the small tables."""

import hashlib
import html as entities
import re
import zlib

import pandas as pd
import pytest
import zstandard

from quillon.llm import media
from quillon.llm.queries import QUERIES
from quillon.llm.sql import SQL
from tests.compare import same


def table(small, name):
    return pd.read_parquet(f"{small}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, oracle, name):
    assert same(QUERIES[name](spark, small), oracle, SQL[name])


def test_extraction_equals_the_article(spark, small):
    pages = table(small, "pages")
    found = QUERIES["op1_html_extraction"](spark, small).toPandas().set_index("page_id")
    assert len(found) == len(pages)
    for page, source in zip(pages["page_id"], pages["html"]):
        begin = source.index("<article>") + 9
        end = source.find("</article>", begin)
        end = source.find("<footer", begin) if end < 0 else end
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", source[begin:end] if end >= 0 else source[begin:]))
        want = "\n".join(b for b in blocks if b)
        assert (found.loc[page, "text"], found.loc[page, "n_chars"]) == (want, len(want))


def test_toxicity_on_held_out_rows(spark, small):
    from quillon.llm import toxicity
    from quillon.llm.common import read

    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 0"))
    found = toxicity.score(docs, model).toPandas().merge(table(folder, "labels"), on="doc_id")
    held = found[found["doc_id"] % 3 == 0]
    bad = held["toxic_y"] == 1
    assert held.loc[bad, "toxic_x"].mean() > 0.85
    assert held.loc[~bad, "toxic_x"].mean() < 0.02
    assert (held["severity"] >= 0).all() and held.loc[bad, "severity"].mean() > held.loc[~bad, "severity"].mean() + 0.5
    assert len(QUERIES["op4_toxicity"](spark, small).toPandas()) == len(table(small, "documents"))


def test_media_round_trip(spark, small):
    docs = table(small, "documents")
    found = QUERIES["op7_media_columns"](spark, small).toPandas().set_index("doc_id")
    for doc, text in zip(docs["doc_id"], docs["text"]):
        raw = (text or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        begin, chunks = 0, []
        for end in media.cuts(data):
            chunks.append(data[begin:end])
            begin = end
        form = media.stored_form([(hashlib.sha256(c).digest(), zstandard.ZstdCompressor(level=3).compress(c)) for c in chunks])
        assert media.read_form(form) == data
        row = found.loc[doc]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert (row["tail_crc32"], row["media_bytes"], row["media_sha256"]) == (zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest())


def test_sharding_law(spark, small):
    docs = table(small, "documents")
    found = QUERIES["op8_sharding"](spark, small).toPandas()
    assert sorted(found["doc_id"]) == sorted(docs["doc_id"])
    merged = found.merge(docs[["doc_id", "text"]], on="doc_id")
    assert (merged["size"] == merged["text"].map(lambda t: len(t.encode()) + 1)).all()
    assert (merged["text_crc32"] == merged["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    sizes = found.groupby("shard")["size"].sum()
    assert list(sizes.index) == list(range(8))
    assert sizes.max() - sizes.min() <= 3 * found["size"].max()
    for _, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    # copies share a shard unless they weigh more than a sixteenth of one
    groups = merged.groupby("text").agg(weight=("size", "sum"), shards=("shard", "nunique"))
    assert (groups.loc[groups["weight"] <= found["size"].sum() // 128, "shards"] == 1).all()


def test_mixing_meets_its_targets(spark, small):
    found = QUERIES["op5_mixing"](spark, small.replace("sf0.001", "sf0.01")).toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    total = found.drop_duplicates(["source_size", "target"])
    assert total["target"].sum() == pytest.approx(found["size"].sum())
    assert found["taken"].sum() == pytest.approx(found["size"].sum(), rel=0.05)
    again = QUERIES["op5_mixing"](spark, small.replace("sf0.001", "sf0.01")).toPandas()
    assert found.sort_values("doc_id").equals(again.sort_values("doc_id")) or (found.sort_values("doc_id").values == again.sort_values("doc_id").values).all()
