"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import centroids, chat, decontamination, html_extraction, jaccard, media, mixing, negatives, packing, sharding, substrings, toxicity, url_filter
from quillon.llm.common import read, written


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{sample}'), (-7L, 1L, 'assistant', '{sample}') AS t(conv_id, turn, role, text)")
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("invalid_turn").cast("long").alias("invalid_turn"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.pack(read(spark, sf_dir, "documents"), lambda: packing.encoder(*files))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7's stored payloads SQL can check: their sizes and digests, as read back."""
    return op7_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on op8's shards: documents, bytes, the law, how many shards, whether slots have no gaps, and whether sizes differ by no more than three of the largest document."""
    found = written(op8_sharding(spark, sf_dir))
    per = found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.max("size").alias("largest"), F.min("law").alias("law"), F.max("law").alias("law2"))
    gapless = F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    near = F.max("bytes") - F.min("bytes") <= 3 * F.max("largest")
    return per.agg(F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.concat_ws(",", F.array_distinct(F.concat(F.collect_set("law"), F.collect_set("law2")))).alias("law"), F.count("*").alias("shards"), gapless.alias("gapless"), near.alias("near_equal"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_substring_dedup, op3_url_filters, op4_toxicity, op5_mixing, op6_ngram_jaccard, op7_media_columns, op8_sharding, op9_chat_formatting, op10_decontamination, op11_hard_negatives, op12_best_fit_packing, op13_centroid_clustering, media_payloads, shard_laws)}
