"""Connected components over links that are too many for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written_short


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For links (a, b) of longs: node and root, the least node that it is tied to; roots themselves have no row.

    Each round ties the nodes of a chain to lesser ones, so the rounds grow with the logarithm of a chain's length; the
    table is written to the checkpoint folder after each, in files as its rows need, until a round changes nothing. An edge table without rows gives none.
    Links are read twice, so they should be a written table.
    """
    state = written_short(edges.select("a", "b").where("a != b").distinct(), edges.count())
    before = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        if now[0] == 0 or before == now:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, state = now, written_short(_small_star(_large_star(state)), now[0])
