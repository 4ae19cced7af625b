"""Sharding by k-d tree partitioning.

The points are texts (equal texts are one point, so that copies share a shard),
weighted by bytes. The space is metadata: source, language and size, each scaled to
its rank or logarithm. A cell is split along the dimension in which it is widest,
at the weighted median, until there are as many leaves as shards. Each median comes
from sums over the values of the dimension and, for points tied at the median value,
over two levels of 4096 buckets of a hash: no cell is ever sorted or held in one task.
A text whose copies weigh more than a sixteenth of a shard is divided into several
points by a hash of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import byte_size, fan_out, in_order, named, offsets, written

DIMENSIONS = ("source", "lang", "log_size")
LAW = "bytes"
FINE = 4096
HOT_PART = 16
#: texts of more copies than this are sent to their rows; at most HOT_TEXTS are
HOT_ROWS, HOT_TEXTS = 4096, 50_000


def _points(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, size, text_crc32, point, spread), points (point, dimensions, weight, copies), and the number of rows."""
    text = F.coalesce("text", F.lit(""))
    # what is needed of the texts is written once; rows without id are told apart by their place in that table
    narrow = docs.select("doc_id", (byte_size(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.col("text").isNull(), text, F.octet_length(text)).alias("_text"), named("source").alias("source"), named("lang").alias("lang"))
    rows = written(narrow.withColumn("spread", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.monotonically_increasing_id())))))
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    total = rows.agg(F.sum("size"), F.count("*")).first()
    limit = max(1, (total[0] or 0) // (shards * HOT_PART))
    # at most shards * HOT_PART texts are over the limit, so this side of the join is bounded
    hot = groups.where(F.col("_bytes") > limit).select("_text", F.ceil(F.col("_bytes") / limit).cast("long").alias("_parts"))
    rows = rows.join(F.broadcast(hot), "_text", "left")
    part = F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.col("spread"), F.col("_parts")))
    rows = rows.withColumn("point", F.xxhash64("_text", part)).drop("_parts")
    points = rows.groupBy("point").agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.max("size").alias("_size"), F.count("*").alias("copies"))
    return rows.drop("source", "lang", "_text"), points.withColumn("log_size", F.round(F.log2("_size") * 8) / 8).drop("_size"), total[1]


def _coordinates(points: DataFrame) -> DataFrame:
    """Names become ranks from 0 to 1, sizes are scaled to the same range. Names may be many (sites): they are put in order range by range."""
    for name in ("source", "lang"):
        ranks = in_order(points.select(name).distinct(), [name])
        last = ranks.agg(F.max("at")).first()[0] or 1
        ranks = ranks.select(name, (F.col("at") / F.lit(float(last))).alias("_r"))
        points = points.join(ranks, name).drop(name).withColumnRenamed("_r", name)
    low, high = points.agg(F.min("log_size"), F.max("log_size")).first()
    span = (high - low) if high is not None and high > low else 1.0
    return points.withColumn("log_size", (F.col("log_size") - F.lit(low or 0.0)) / F.lit(span))


def _below(value: Column, tie: Column, cut: tuple[float, int]) -> Column:
    """Whether a point is on the lower side of a cut, ties by hash."""
    return (value < F.lit(cut[0])) | ((value == F.lit(cut[0])) & (tie < F.lit(cut[1])))


def _crossing(sums: DataFrame, groups: list[str], order: str, goals: dict[int, float]) -> dict[int, tuple]:
    """Per cell the first value at which the running weight reaches the goal: value, weight before it, its weight."""
    w = Window.partitionBy(*groups).orderBy(order)
    run = sums.withColumn("_run", F.sum("weight").over(w)).withColumn("_before", F.col("_run") - F.col("weight"))
    goal = F.lit(0.0)
    for cell, want in goals.items():
        goal = F.when(F.col("cell") == cell, F.lit(float(want))).otherwise(goal)
    found = run.where((F.col("_before") < goal) & (F.col("_run") >= goal)).groupBy("cell").agg(F.min(F.struct(F.col(order), "_before", "weight")).alias("m"))
    return {r["cell"]: (r["m"][0], r["m"][1], r["m"][2]) for r in found.collect()}  # one row a cell


def kd_cells(points: DataFrame, shards: int) -> DataFrame:
    """Adds `cell`, 0 to shards - 1, to points with the dimensions, `point` and `weight`."""
    tie = F.shiftrightunsigned(F.xxhash64("point", F.lit(7)), 40).cast("long")  # 24 bits
    points = points.withColumns({"tie": tie, "cell": F.lit(0)})
    leaves = {0: shards}  # leaves below each open cell; cell numbers are the first leaf's
    while any(n > 1 for n in leaves.values()):
        wide = points.groupBy("cell").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()  # one row a cell
        axis = {r["cell"]: max(DIMENSIONS, key=lambda d: r[d]) for r in wide if leaves[r["cell"]] > 1}
        goals = {r["cell"]: r["w"] * (leaves[r["cell"]] // 2) / leaves[r["cell"]] for r in wide if r["cell"] in axis}
        if not axis:
            break
        value = F.lit(None).cast("double")
        for cell, d in axis.items():
            value = F.when(F.col("cell") == cell, F.col(d)).otherwise(value)
        open_points = points.withColumn("v", value).where(F.col("v").isNotNull())
        at = _crossing(open_points.groupBy("cell", "v").agg(F.sum("weight").alias("weight")), ["cell"], "v", goals)
        at_value = F.lit(None).cast("double")
        for cell, (v, _, _) in at.items():
            at_value = F.when(F.col("cell") == cell, F.lit(v)).otherwise(at_value)
        tied = open_points.where(F.col("v") == at_value)
        left = {c: max(goals[c] - before, 1e-9) for c, (_, before, _) in at.items()}
        coarse = _crossing(tied.withColumn("b", F.floor(F.col("tie") / FINE)).groupBy("cell", "b").agg(F.sum("weight").alias("weight")), ["cell"], "b", left)
        bucket = F.lit(None).cast("long")
        for cell, (b, _, _) in coarse.items():
            bucket = F.when(F.col("cell") == cell, F.lit(b)).otherwise(bucket)
        left = {c: max(left[c] - before, 1e-9) for c, (_, before, _) in coarse.items()}
        fine = _crossing(tied.where(F.floor(F.col("tie") / FINE) == bucket).groupBy("cell", "tie").agg(F.sum("weight").alias("weight")), ["cell"], "tie", left)
        cell_of = F.col("cell")
        grown: dict[int, int] = {}
        for cell, n in leaves.items():
            if cell not in axis:
                grown[cell] = n if n == 1 else 1
                continue
            # the point at the crossing goes to the side that leaves the halves nearer to the goal
            t, before, weight = fine[cell]
            cut = (at[cell][0], t + (1 if left[cell] - before > weight / 2 else 0))
            cell_of = F.when((F.col("cell") == cell) & ~_below(F.col(axis[cell]), F.col("tie"), cut), F.lit(cell + n // 2)).otherwise(cell_of)
            grown |= {cell: n // 2, cell + n // 2: n - n // 2}
        points, leaves = points.withColumn("cell", cell_of), grown
    return points


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1, so a null or empty text weighs 1 (its crc32 is 0). Shards are
    near equal in bytes; equal texts share a shard unless their copies weigh too much
    for that. Slots run from 0 in each shard without gaps. Null ids, sources and languages
    are values like others; repeated rows get slots of their own. An empty table gives an
    empty result.
    """
    rows, points, count = _points(docs, shards)
    points = written(_coordinates(written(points)))
    cells = written(kd_cells(points, shards).select("point", "copies", F.col("cell").alias("shard")))
    # texts of many copies are few, and are sent to their rows
    many = max(HOT_ROWS, count // HOT_TEXTS)
    hot = F.broadcast(cells.where(F.col("copies") > many).drop("copies"))
    rest = rows.join(hot.select("point"), "point", "left_anti").join(cells.where(F.col("copies") <= many).drop("copies"), "point")
    placed = rows.join(hot, "point").select(*rest.columns).union(rest)
    n = fan_out(count)
    placed = written(placed.withColumn("bucket", F.pmod(F.xxhash64("spread", "text_crc32"), F.lit(n))))
    start = offsets(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")), ["shard"], ["bucket"], "n", "start").drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    slotted = placed.withColumn("k", inside).join(start, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
