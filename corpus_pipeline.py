"""A corpus from documents: toxic ones out, near copies out, benchmark passages out, sources mixed, shards assigned.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns
of documents; the last adds each row's shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, jaccard, mixing, sharding, toxicity
from quillon.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't judge toxic. The model is fitted on the labelled ones among `docs`.

    Null and empty texts are clean; repeated rows are judged alike; without labelled rows of both classes, and so for an empty table, nothing goes.
    """
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id.

    Null and empty texts are in no group and stay, rows that repeat id and text once; an empty table stays empty.
    """
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark passage. Null and empty texts have no words and stay, repeated rows each; an empty table stays empty."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling towards the sources' target weights emits it.

    Null texts have no words; a null source is a source, the last; repeated rows are drawn one by one; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts weigh one byte; repeated rows have slots of their own; an empty table gives none."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: fitted models and hash orders have no SQL equivalent; tests/llm compares the stages with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written to the checkpoint folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
