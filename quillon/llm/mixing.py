"""Mixing sources to target weights by systematic sampling.

Every source has a target of words. A document of a source is expected to be
emitted ``target / source_size`` times. The expected copies are summed up in a
fixed order within the source (by size, then by a spread of the id, then by id),
one random offset is added, and a document is emitted once for each integer that
its stretch of the running sum crosses. Ordering by size makes every size class
drawn at the same rate, so the words taken come near the target.

The running sum never needs a whole source in one task: the rank of a document is
the sum of three counts, of smaller sizes, of earlier buckets of its own size, and
of earlier rows of its bucket; the first two come from pre-aggregated counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import fan_out, in_order, md5_int, named, offsets, word_count, written

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Words that each source is to give: source, source_size, target.

    Takes one row per source (source, source_size). Sources stand in code point
    order, null last, and the weights repeat over them. A target stops at `cap`
    times its source's size; what is over goes to the others by weight until none is
    above. In order of cap per weight the capped sources come first, so the level that
    the others reach follows from running sums, without iterating. With no words at
    all every target is 0. Sources may be many (sites): both orders are made range by range.
    """
    of = F.array(*[F.lit(float(w)) for w in weights])
    by_name = in_order(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source").cast("binary")]).withColumnRenamed("at", "_at")
    capped = by_name.withColumns({"_w": F.get(of, (F.col("_at") % len(weights)).cast("int")), "_cap": (F.col("source_size") * cap).cast("double")}).withColumn("_level", F.col("_cap") / F.col("_w"))
    ranked = in_order(capped, ["_level", "_at"], ("_cap", "_w"))
    every = ranked.agg(F.sum("source_size").alias("_words"), F.sum("_w").alias("_weight"))
    levelled = ranked.crossJoin(F.broadcast(every)).withColumn("_lambda", (F.col("_words") - F.col("before__cap")) / (F.col("_weight") - F.col("before__w")))
    first = levelled.agg(F.min(F.when(F.col("_lambda") <= F.col("_level"), F.struct("_level", "_at", "_lambda"))).alias("_first"))
    full = F.col("_first").isNull() | (F.struct("_level", "_at") < F.struct(F.col("_first._level"), F.col("_first._at")))
    return levelled.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_w") * F.col("_first._lambda")).alias("target"))  # one row each


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """How often each document is emitted: doc_id, source, size, source_size, target, copies.

    A null text has size 0. Null ids and repeated rows are documents like others
    (equal rows are interchangeable, so their order doesn't matter). An empty table
    gives an empty result. Other columns of `docs` are ignored. No document gets more than `cap`
    copies; reruns agree. The sizes are written to the checkpoint folder, so texts are read once.
    """
    # rows without id that agree in source and size are interchangeable, so they may be spread by their texts
    spread = md5_int(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("spread")
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread))
    by_size = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    total = by_size.agg(F.sum("n")).first()[0] or 0
    n = fan_out(total)
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    rows = rows.withColumn("bucket", F.col("spread") % n).drop("spread")
    by_bucket = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before_size = offsets(by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n")), ["source"], ["size"], "n", "lower").drop("n")
    before_bucket = offsets(by_bucket, ["source", "size"], ["bucket"], "n", "earlier").drop("n")
    start = before_bucket.alias("b").join(before_size.alias("s"), F.expr("b.source <=> s.source AND b.size = s.size")).select("b.source", "b.size", "b.bucket", (F.col("earlier") + F.col("lower")).alias("start"))
    start = start.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.*", "t.source_size", "t.target")
    within = Window.partitionBy("source", "size", "bucket").orderBy("doc_id")
    ranked = rows.withColumn("k", F.row_number().over(within))
    placed = ranked.alias("r").join(start.alias("b"), F.expr("r.source <=> b.source AND r.size = b.size AND r.bucket = b.bucket")).select("r.doc_id", "r.source", "r.size", "b.source_size", "b.target", (F.col("start") + F.col("k")).alias("k"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # one offset a source; a multiple of 2 ** -20, so that whole rates stay whole
    start_at = md5_int(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 5) / F.lit(float(16**5))
    crossed = F.floor(F.col("k") * rate + start_at) - F.floor((F.col("k") - 1) * rate + start_at)
    return placed.withColumn("copies", crossed.cast("int"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each row as often as it is emitted, with the columns of `docs`.

    Rows meet their copies by id, source and size (null is a value of its own); of rows that agree in these the first by text gets the most copies. An empty table gives an
    empty result; further columns are kept.
    """
    same = ("_id", "_source", "_size")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), named("doc_id").alias("_id"), named("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"))
    left = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*same).orderBy("_tie")))
    counted = mix(docs, seed).where("copies > 0").select(named("doc_id").alias("_id"), named("source").alias("_source"), F.col("size").alias("_size"), "copies")
    right = counted.withColumn("_rank", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("copies"))))
    joined = left.join(right, [*same, "_rank"])
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
