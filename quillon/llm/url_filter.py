"""URL filters by a Bloom filter cascade.

The keys are pairs of a host and a path prefix. The universe is every pair that some
url of the corpus could be listed under: each suffix of its host by labels with each
prefix of its path of a length that occurs among the rules. Level 0 holds the listed
keys; level 1 holds the keys of the universe that level 0 wrongly holds; level 2 the
listed keys that level 1 wrongly holds; and so on until a level is wrong about none.
A key of the universe is listed if and only if the first level that lacks it is odd, so the
answer is exact and no url is joined with the rules. The first level's rate is set by
the size of the universe so that the expected false positives stay below the number of rules:
the cascade's size follows the list, not the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, written

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
MAX_BITS = 1 << 31


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    hashes: int
    #: levels hash differently, else each would be wrong about the same keys
    salt: int

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, salt: int = 0) -> Bloom:
        size = max(64, math.ceil(-max(1, len(keys)) * math.log(rate) / math.log(2) ** 2))
        if size > MAX_BITS:
            raise ValueError(f"a level of {size} bits is over the bound of {MAX_BITS}")
        made = cls(np.zeros((size + 7) // 8, np.uint8), size, max(1, round(-math.log2(rate))), salt)
        for at in made._places(keys):
            np.bitwise_or.at(made.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _places(self, keys: np.ndarray):
        keys = keys.astype(np.int64).view(np.uint64) ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
        first, second = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
        for k in range(self.hashes):
            yield ((first + np.uint64(k) * second) % np.uint64(self.size)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return found


@dataclass
class Cascade:
    levels: list[Bloom]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that it was built over."""
        listed, open_ = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for k, level in enumerate(self.levels):
            inside = level.holds(keys)
            listed |= open_ & ~inside & (k % 2 == 1)
            open_ &= inside
        return listed | (open_ & (len(self.levels) % 2 == 1))


def key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("|"), path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds `keys`: per page every (host suffix, path prefix) under which a rule could fit, the longest first; of equal length the one with the longer host."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct((-(F.length(h) + F.length(p))).alias("order"), (-F.length(h)).alias("then"), h.alias("host"), p.alias("path"), key_hash(h, p).alias("key")))))
    return pages.withColumn("keys", F.array_sort(pairs))


def build_cascade(universe: DataFrame, listed: np.ndarray, size: int) -> Cascade:
    """Cascade over the distinct `key`s of the universe; what goes to the driver per level is the false positives, about as many as the list has keys."""
    listed = np.unique(listed)
    if not len(listed):
        return Cascade([])
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * len(listed) / max(1, size)))
    limit = 20 * len(listed) + 10_000
    while True:
        levels = [Bloom.of(listed, rate)]

        def wrong(batches, first=levels[0]):
            for b in batches:
                k = b["key"].to_numpy()
                yield pd.DataFrame({"key": k[first.holds(k) & ~np.isin(k, listed)]})

        false = universe.mapInPandas(wrong, "key long").limit(limit + 1).toPandas()["key"].to_numpy(np.int64)
        if len(false) <= limit:
            break
        rate /= 16  # far over the expected number: a larger first level
    inside, outside = listed, false
    while len(outside):
        level = Bloom.of(outside, 0.5, len(levels))
        levels.append(level)
        inside, outside = outside, inside[level.holds(inside)]
        if len(levels) > 200:
            raise ValueError("two keys share a hash")
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, url, host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest rule wins, of equally long ones that with the longer host. Null urls and urls
    without :// have an empty host and path, and no rule fits. Repeated rows are judged alike; other columns are ignored; an empty table
    gives an empty result. Without a rule the verdict is the default.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = sorted({len(p) for _, _, p in rules})
    keyed = candidates(parts, lengths)
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string").select("verdict", key_hash(F.col("host"), F.col("path")).alias("key")).toPandas()
    # distinct hosts and path prefixes: the universe is far smaller than the pages; it is read once for its size and once per list
    universe = written(keyed.select(F.explode("keys.key").alias("key")).distinct())
    size = universe.count()
    lists = {v: build_cascade(universe, table["key"][table["verdict"] == v].to_numpy(np.int64), size) for v in sorted({r[0] for r in rules})}

    @F.arrow_udf("place int, verdict string")
    def first_listed(keys: pa.Array) -> pa.Array:
        """Per page the place of its first key that a list holds, null if none does, and the list."""
        ends = keys.offsets.to_numpy()
        flat = keys.values.to_numpy()[ends[0] : ends[-1]]
        n = np.diff(ends)
        page, place = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
        none = np.iinfo(np.int32).max
        best, verdict = np.full(len(n), none), np.full(len(n), default, object)
        for name, cascade in lists.items():
            held, mine = cascade.holds(flat), np.full(len(n), none)
            np.minimum.at(mine, page[held], place[held])
            verdict[mine < best] = name
            best = np.minimum(best, mine)
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32), mask=best == none), pa.array(verdict, pa.string())], names=["place", "verdict"])

    # only the keys go to Python, and come back as a place among the page's keys
    judged = keyed.withColumn("first", first_listed(F.col("keys.key")))
    won = F.get("keys", F.col("first.place"))
    return judged.select("page_id", "url", "host", "path", F.concat(won["host"], won["path"]).alias("rule"), F.col("first.verdict").alias("verdict"))
