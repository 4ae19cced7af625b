"""Benchmark decontamination with a distributed positional inverted index.

1. The documents are made into words once. The postings (term, document, position) of the benchmark's terms are written as a table; a posting
   with an empty term at position 0 stands for the document itself and its number of words.
2. From the postings' counts each window of an item gets its two rarest terms. Their lists, adjusted by the terms' places in the item,
   are intersected: what both have are the shifts at which the item may stand in a document.
3. At each shift the lists of all the item's terms are intersected with the shifted item; runs of consecutive places
   as long as a window are exact phrases.

Proximity matches come from the same postings: the lists of an item's rarest terms, joined by nearness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import LOWER, UPPER, written

#: what stands between words: ASCII that is neither digit nor lower-case letter, once A-Z is lower-cased
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: the benchmark's terms and rarest terms are broadcast if its texts have up to so many characters; those of a larger one are joined by shuffles
BROADCAST_CHARS = 8_000_000
#: up to so many documents with candidates are broadcast
MAX_DOCS = 500_000
#: rarest terms of an item that must stand close, and how many words from the rarest
NEAR_TERMS, NEAR_WORDS = 3, 25


def tokens(text: Column) -> Column:
    """Lower-cased words of a text in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class Index:
    """Postings of a benchmark's terms in documents, and the benchmark's items by their terms.

    `postings`: d, h (a document: its id, and a hash of its text and of whether the id is null), n (its words), term, pos. `items`: row,
    item_id, n, words; an item given twice is there once. `terms`: term, df.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, broadcast_chars: int = BROADCAST_CHARS):
        self.small = (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) <= broadcast_chars
        items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0).groupBy("item_id", "words").count()
        self.items = written(items.select(F.xxhash64("item_id", "words").alias("row"), "item_id", F.size("words").alias("n"), "words"))
        terms = self.items.select(F.explode("words").alias("term")).distinct()
        wanted = terms.union(terms.sparkSession.range(1).select(F.lit("").alias("term")))
        kind = dict(docs.dtypes)["doc_id"]
        none = F.col("doc_id").isNull()
        corpus = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("d"), F.xxhash64("text", none).alias("h"), none.alias("none"), tokens(F.col("text")).alias("tokens"))
        # outer: else the optimizer adds a filter that splits every text once more
        words = corpus.select("d", "h", "none", F.size("tokens").alias("n"), F.posexplode_outer(F.concat(F.array(F.lit("")), "tokens")).alias("pos", "term"))
        self.postings = written(words.join(_side(wanted, self.small), "term").select("d", "h", "none", "n", "term", "pos"))
        df = self.postings.where("term != ''").groupBy("term").agg(F.count("*").alias("df"))
        self.terms = written(terms.join(_side(df, self.small), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")))

    def documents(self) -> DataFrame:
        """One row per row of the documents: doc_id, d, h, n_words."""
        return self.postings.where("term = ''").select(F.when(~F.col("none"), F.col("d")).alias("doc_id"), "d", "h", F.col("n").cast("long").alias("n_words"))

    def listed(self, terms: DataFrame) -> DataFrame:
        """The lists of the terms of a small table, with its other columns; positions count from 0."""
        return self.postings.where("term != ''").select("d", "h", "term", (F.col("pos") - 1).alias("pos")).join(_side(terms, self.small), "term")

    def placed(self) -> DataFrame:
        return self.items.select("row", "n", F.posexplode("words").alias("at", "term"))

    def phrases(self, window: int = WINDOW) -> DataFrame:
        """Where items stand in documents with at least a window of their words (all, if they have fewer) in a row: d, h, row, start, end (word positions, end not included). Longest runs, one row each."""
        span = F.least(F.lit(window), F.col("n"))
        w = Window.partitionBy("row").orderBy("at").rangeBetween(0, window - 1)
        known = self.placed().join(_side(self.terms.where("df > 0"), self.small), "term")
        lists = known.withColumns({"has": F.count("*").over(w), "rarest": F.array_sort(F.collect_list(F.struct("df", "at", "term")).over(w))})
        # a window with a term that no document has can't match
        lists = lists.where((F.col("has") == span) & (F.col("at") + span <= F.col("n")))
        two = lists.select("row", F.col("rarest")[0].alias("a"), F.get("rarest", F.lit(1)).alias("b")).select("row", F.col("a.at").alias("at"), F.col("a.term").alias("term"), F.col("b.at").alias("at2"), F.col("b.term").alias("term2")).distinct()
        two = written(two.withColumn("apart", F.col("at2") - F.col("at")))
        # windows that many items share are looked up once: as two terms and how far they stand apart
        pairs = two.select(F.col("term").alias("a"), F.col("term2").alias("b"), "apart").distinct()
        key = ["d", "h", "a", "b", "apart", "pos"]
        first = self.listed(pairs.withColumn("term", F.col("a"))).select(*key)
        second = self.listed(pairs.where("b IS NOT NULL").withColumn("term", F.col("b"))).select(*key[:-1], (F.col("pos") - F.col("apart")).alias("pos"))
        met = first.where("b IS NOT NULL").join(second, key, "left_semi").union(first.where("b IS NULL"))
        places = two.select("row", "at", F.col("term").alias("a"), F.coalesce("term2", F.lit("")).alias("b"), F.coalesce("apart", F.lit(0)).alias("apart"))
        both = met.withColumns({"b": F.coalesce("b", F.lit("")), "apart": F.coalesce("apart", F.lit(0))}).join(_side(places, self.small), ["a", "b", "apart"]).select("d", "h", "row", (F.col("pos") - F.col("at")).alias("shift"))
        shifts = written(both.distinct())
        some = shifts.select("d", "h").distinct()
        few = some.limit(MAX_DOCS + 1).count() <= MAX_DOCS
        lists = self.postings.where("term != ''").join(_side(some, few), ["d", "h"], "left_semi").select("d", "h", "term", (F.col("pos") - 1).alias("pos"))
        asked = shifts.join(_side(self.placed(), self.small), "row").select("d", "h", "row", "shift", "n", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
        met = asked.join(lists, ["d", "h", "pos", "term"]).select("d", "h", "row", "shift", "n", "at").distinct()
        run = F.col("at") - F.row_number().over(Window.partitionBy("d", "h", "row", "shift").orderBy("at"))
        runs = met.withColumn("run", run).groupBy("d", "h", "row", "shift", "n", "run").agg(F.min("at").alias("at"), F.count("*").alias("k")).where(F.col("k") >= span)
        start = F.col("shift") + F.col("at")
        return runs.select("d", "h", "row", start.alias("start"), (start + F.col("k")).cast("int").alias("end"))

    def close(self, terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
        """Where an item's rarest terms stand close: d, h, row, pos (of the rarest). Ties of counts go by term."""
        ranked = self.placed().select("row", "term").distinct().join(_side(self.terms, self.small), "term")
        ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("df", "term"))).where(F.col("k") <= terms)
        ranked = written(ranked.withColumn("need", F.max("k").over(Window.partitionBy("row"))).select("row", "term", "k", "need"))
        rare = self.listed(ranked.where("k = 1").drop("k")).select("d", "h", "row", "need", "pos")
        others = self.listed(ranked.where("k > 1").drop("need")).select("d", "h", "row", "k", F.col("pos").alias("other"), F.floor(F.col("pos") / (within + 1)).alias("cell"))
        cell = F.floor(F.col("pos") / (within + 1))
        spread = rare.where("need > 1").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        near = spread.join(others, ["d", "h", "row", "cell"]).where(F.abs(F.col("pos") - F.col("other")) <= within).select("d", "h", "row", "need", "pos", "k").distinct()
        return near.groupBy("d", "h", "row", "need", "pos").count().where("count = need - 1").select("d", "h", "row", "pos").union(rare.where("need = 1").select("d", "h", "row", "pos").distinct())

    def named(self, found: DataFrame) -> DataFrame:
        return found.join(_side(self.items.select("row", "item_id"), self.small), "row")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Where items occur in documents with `window` or more of their words in a row: doc_id, row, item_id, start, end (word positions, end not included).

    An item of fewer words must occur whole, an item without words is none. `row` tells items with the same id apart. Documents given twice are one.
    """
    index = Index(docs, benchmark, broadcast_chars)
    names = index.documents().select("d", "h", "doc_id").distinct()
    return index.named(index.phrases(window)).join(names, ["d", "h"]).select("doc_id", "row", "item_id", "start", "end")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, within: int = NEAR_WORDS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Documents in which the item's rarest distinct terms stand close: doc_id, item_id, pos (of the rarest term).

    All of the `terms` rarest terms of the item must occur within `within` words before or after the rarest. Items with fewer distinct terms
    need them all; a term that no document has is the rarest, so its item matches nowhere.
    """
    index = Index(docs, benchmark, broadcast_chars)
    names = index.documents().select("d", "h", "doc_id").distinct()
    return index.named(index.close(terms, within)).join(names, ["d", "h"]).select("doc_id", "item_id", "pos").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, broadcast_chars: int = BROADCAST_CHARS, close: bool = True) -> DataFrame:
    """Per document: doc_id, _h (a hash of its text), n_words, n_hit, n_items, items (ids, sorted as strings), n_near (items with a proximity match; null unless `close`), contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated when at least one in `one_in` of
    its words is. Null and empty texts have no words and are clean; null item texts are no items. A null item id is an item that counts, and has no name in `items`. Rows with the
    same doc_id and text are one document given once per row; rows with the same id and other texts are told apart by the text's hash. An
    empty benchmark hits nothing. The index is written to the checkpoint folder.
    """
    index = Index(docs, benchmark, broadcast_chars)
    found = written(index.named(index.phrases(window)))
    # words of overlapping phrases count once
    before = F.coalesce(F.max("end").over(Window.partitionBy("d", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    hits = found.select("d", "h", "start", "end").distinct().withColumn("new", new).groupBy("d", "h").agg(F.sum("new").alias("n_hit"))
    ids = found.select("d", "h", F.struct(F.col("item_id").cast("string").alias("id")).alias("item")).distinct().groupBy("d", "h").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item.id")).alias("items"))
    out = index.documents().join(hits.join(ids, ["d", "h"]), ["d", "h"], "left")
    near = F.lit(None).cast("long")
    if close:
        nearby = index.named(index.close()).select("d", "h", "item_id").distinct().groupBy("d", "h").agg(F.count("*").alias("n_near"))
        out, near = out.join(nearby, ["d", "h"], "left"), F.coalesce("n_near", F.lit(0))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", F.col("h").alias("_h"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), near.alias("n_near"), ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with their columns. Few documents are, so only their ids meet the rows again.

    Rows without text, with repeated ids or without id are kept or dropped each by its own text; an empty table gives none.
    """
    bad = contamination(docs, benchmark, window, one_in, close=False).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_th")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text", F.col("doc_id").isNull()).alias("_t"))
    return rows.join(bad, F.expr("_row.doc_id <=> _d AND _t <=> _th"), "left_anti").select("_row.*")
