"""N-gram Jaccard join with prefix trees.

A document is the set of its word shingles in one global order: shingles known to be frequent last,
the rest by hash. Two sets can only reach the similarity when the first quarter of each (its prefix) shares a shingle.

1. One pass counts prefix shingles, by chunks, to learn which are frequent; the order puts
   those last, so few documents meet at a shingle. Another finds, by 32 bits of their hash, the prefix
   shingles that repeat at all; the others are leaves just below the root and aren't moved.
2. A third pass gives for each text its key, set size, prefix and a parity sketch of the set.
3. Shingles whose texts are the same become one item, a node of the tree as long as they are many (its weight): a passage that a group of texts
   shares is one item, not hundreds. A text is a path of items in the global order.
4. Texts meet at their items, dealt out in blocks of BLOCK. In each block a text is tried against the block's leaders and emits the first that
   its length, place and sketch leave possible (all three are exact bounds), so a block emits no more pairs than it has texts.
5. Pairs of long texts, whose sketches are too short to tell much, first meet with finer ones, of some slots a shingle. What these leave possible is verified on
   whole sets: the partners of a text are stored in a prefix tree, which is walked once with the text's set. What is similar is tied together.
6. Where an item's texts aren't all tied, their paths from that item on are stored in a prefix tree, one a block, and the texts outside the largest tied group
   walk it: paths that begin alike share their partial overlap, and a subtree goes as soon as what remains of it, or of the
   walker, can't reach the bound. What is left has its sketch compared and is verified as before.

No pair is made before a tree or a leader has been tried in the task that holds both. Equal texts are one node from the start, told apart by 128 bits of
hashes of their words. Shingles are 63-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import cleared, written, written_at, written_short
from quillon.llm.components import components
from quillon.llm.words import Words, grams, inside, mixed

SHINGLE = 5
#: similarity as a ratio of integers
NEAR = (75, 100)
#: bytes of text that a task holds as words at once
CHUNK = 2 << 20
#: the frequent shingles sent to the tasks are at most so many
MAX_FREQUENT = 2_000_000
#: shingles counted at least so often within chunks count as frequent
FREQUENT = 64
#: up to so many prefix shingles are counted by slots, and so many slots that repeat are sent to the tasks
MAX_COUNTED, MAX_SLOTS = 1 << 30, 8_000_000
#: up to so many texts to be verified are named to the tasks; beyond, texts are joined by a shuffle
MAX_NAMED = 1_000_000
#: partners of a text in one prefix tree, and places in trees that a row brings of a text to verify
PARTNERS, JOBS = 256, 4096
#: texts of an item that meet in one block
BLOCK = 1024
#: items of more texts are sent to the tasks, rather than joined by a shuffle; they are at most HOT_ITEMS
HOT, HOT_ITEMS = 4096, 50_000
#: items of a path before and after a block's that a text brings to it; what follows counts as possible
PATH = 64
#: places at which the shingles of a prefix that no other text has are counted
MARKS = 8
#: bytes of a sketch at most, where texts meet at items and where pairs are sifted; a shorter one rules out less
SKETCH, FINE = 128, 2048


def slices(batches, limit: int = CHUNK):
    """Parts of Arrow batches of about so many bytes of text, or of one text."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        part = (np.cumsum(size) - size) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, len(size)]):
            if b > a:
                yield batch.slice(int(a), int(b - a))


class Sets:
    """Shingle sets of a slice of texts: `key` and `more` (128 bits of the word sequence), `size`, and all sets one after another in the global order (`doc`, `value`, `rank`)."""

    def __init__(self, texts: pa.Array, frequent: np.ndarray, shingle: int = SHINGLE):
        words = Words(texts, lower=True)
        h, n = words.hashes(), len(words.count)
        # the key: sums of words weighted by their places, so order counts
        power = (np.arange(len(h)) - words.first[words.doc]).astype(np.uint64)
        self.key, self.more = (self._named(words, h, power, seed) for seed in (1, 0x2545F4914F6CDD1D))
        g = grams(h, shingle)
        full = inside(words, shingle)[: len(g)]
        value, doc = g[full], words.doc[: len(g)][full]
        short = np.flatnonzero((words.count > 0) & (words.count < shingle))
        value, doc = np.concatenate([value, self.key[short] ^ np.uint64(0x5851F42D4C957F2D)]), np.concatenate([doc, short])
        value >>= np.uint64(1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
            value |= (frequent[at] == value).astype(np.uint64) << np.uint64(63)
        order = np.argsort(value)
        order = order[np.argsort(doc[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.value, self.doc = value[new], doc[new]
        self.size = np.bincount(self.doc, minlength=n)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.rank = np.arange(len(self.value)) - self.begin[self.doc]

    @staticmethod
    def _named(words: Words, h: np.ndarray, power: np.ndarray, seed: int) -> np.ndarray:
        if not len(words.count):
            return np.zeros(0, np.uint64)
        weight = mixed(power * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
        sums = np.add.reduceat(np.append(h * weight, np.uint64(0)), np.minimum(words.first[:-1], len(h)))
        return mixed(sums * (words.count > 0) + words.count.astype(np.uint64) + np.uint64(seed - 1))

    def prefix(self, near: tuple[int, int] = NEAR) -> np.ndarray:
        """Whether each shingle is among the first of its set that a partner must share one of."""
        need = -(-self.size * near[0] // near[1])
        return self.rank <= (self.size - need)[self.doc]

    def sketches(self, most: int = SKETCH) -> list[bytes]:
        """Per set, parities of its shingles over 2 to 4 slots a shingle, `most` bytes at most; the number of slots is a power of two."""
        slots = np.minimum(8 * most, 8 << np.maximum(0, np.ceil(np.log2(np.maximum(1, self.size * 2) / 8)).astype(int)))
        base = np.concatenate([[0], np.cumsum(slots)])
        place = base[self.doc] + (mixed(self.value & np.uint64(2**63 - 1)) & (slots[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        bits = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [bits[a // 8 : b // 8] for a, b in zip(base[:-1], base[1:])]


def folded(sketch: bytes, most: int = SKETCH) -> bytes:
    """A sketch with `most` bytes at most, the one that `sketches` makes for that bound."""
    return sketch if len(sketch) <= most else np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, most), axis=0).tobytes()


class Sketch:
    """A parity sketch as one integer. Slots are taken modulo a power of two, so a sketch folds to fewer slots by adding parities."""

    def __init__(self, raw: bytes):
        self.bits = len(raw) * 8
        self.folded = {self.bits: int.from_bytes(raw, "little")}

    def at(self, bits: int) -> int:
        if bits not in self.folded:
            wide = self.at(2 * bits)
            self.folded[bits] = (wide ^ (wide >> bits)) & ((1 << bits) - 1)
        return self.folded[bits]

    def odd(self, other: Sketch) -> int:
        """Slots of odd difference: each holds a shingle that only one of the sets has."""
        bits = min(self.bits, other.bits)
        return (self.at(bits) ^ other.at(bits)).bit_count()


def may_reach(a: bytes, na: int, b: bytes, nb: int, need: int) -> bool:
    """Whether the sketches leave an overlap of `need` possible."""
    return na + nb - Sketch(a).odd(Sketch(b)) >= 2 * need


def overlap_needed(na, nb, near: tuple[int, int] = NEAR):
    """Least intersection of sets of these sizes that are similar."""
    return -(-(near[0] * (na + nb)) // (near[0] + near[1]))


class PrefixTree:
    """Sets in the global order, as paths; a node holds the stretch of shingles that all sets below it share next, and the range of their sizes, for the bounds."""

    def __init__(self) -> None:
        self.root: list = [np.zeros(0, np.uint64), {}, 1 << 60, 0, []]

    def add(self, values: np.ndarray, name) -> None:
        node, rest, n = self.root, np.asarray(values, np.uint64), len(values)
        while True:
            stretch = node[0]
            k = min(len(stretch), len(rest))
            unlike = np.flatnonzero(stretch[:k] != rest[:k])
            same = int(unlike[0]) if len(unlike) else k
            if same < len(stretch):  # the stretch ends where the new set leaves it
                lower = [stretch[same:], node[1], node[2], node[3], node[4]]
                node[0], node[1], node[4] = stretch[:same], {int(stretch[same]): lower}, []
            node[2], node[3] = min(node[2], n), max(node[3], n)
            rest = rest[same:]
            if not len(rest):
                node[4].append(name)
                return
            child = node[1].get(int(rest[0]))
            if child is None:
                node[1][int(rest[0])] = [rest, {}, n, n, [name]]
                return
            node = child

    def links(self, probe: np.ndarray, near: tuple[int, int] = NEAR):
        """Names of the sets similar to the probe. Overlap and depth are shared along a path; a subtree is left when neither its remaining nor the probe's remaining shingles can reach the least bound below it."""
        probe = np.asarray(probe, np.uint64)
        n = len(probe)
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, shared, passed = stack.pop()
            stretch, children, low, high, names = node
            if shared + min(high - depth, n - passed) < overlap_needed(n, low, near):
                continue
            if len(stretch) and n:
                at = np.searchsorted(probe, stretch)
                found = np.flatnonzero(probe[np.minimum(at, n - 1)] == stretch)
                if len(found):
                    shared, passed = shared + len(found), int(at[found[-1]]) + 1
                depth += len(stretch)
            if names and shared >= overlap_needed(n, depth, near):
                yield from names
            if shared + min(high - depth, n - passed) >= overlap_needed(n, low, near):
                stack.extend((child, depth, shared, passed) for child in children.values())


class Path:
    """What a text brings to a block: its key, the root of its tied group, size, what is left of its set from the block's item on, its sketch, the block's item, and its items around that in order, with their weights and tops (as arrays; read when needed)."""

    __slots__ = ("key", "root", "n", "left", "raw", "seen", "meet", "columns")

    def __init__(self, key: int, root: int, n: int, left: int, sketch: bytes, meet: int = 0, *columns: np.ndarray):
        self.key, self.root, self.n, self.left, self.raw, self.seen, self.meet, self.columns = key, root, n, left, sketch, None, meet, columns

    @property
    def sketch(self) -> Sketch:
        if self.seen is None:
            self.seen = Sketch(self.raw)
        return self.seen

    def items(self) -> tuple[list[int], list[int], list[int]]:
        return tuple(c.tolist() for c in self.columns)

    def may_reach(self, other: Path, near: tuple[int, int]) -> bool:
        """Whether lengths, places and sketches leave the similarity possible."""
        if min(self.n, other.n) * near[1] < max(self.n, other.n) * near[0]:
            return False
        need = overlap_needed(self.n, other.n, near)
        return min(self.left, other.left) >= need and self.n + other.n - self.sketch.odd(other.sketch) >= 2 * need


class ItemTree:
    """Paths of weighted items; a node keeps the least size and the most that is left among the paths below it, for the bounds.

    All paths hold the item at which the block meets. Texts that share an earlier one meet there too, so here such a subtree is left at once. An item stands for shingles
    between it and its `top` in the global order, all in the prefixes of the same texts. Of a path, what isn't in items (shingles of one text, and all beyond the
    prefix) counts as left.
    """

    def __init__(self) -> None:
        self.root: list = [{}, 1 << 60, 0, [], 0, 0]

    def add(self, path: Path) -> None:
        node = self.root
        node[1], node[2] = min(node[1], path.n), max(node[2], path.left)
        for item, weight, top in zip(*path.items()):
            child = node[0].get(item)
            if child is None:
                child = node[0][item] = [{}, 1 << 60, 0, [], weight, top]
            node = child
            node[1], node[2] = min(node[1], path.n), max(node[2], path.left)
        node[3].append(path)

    def walk(self, probe: Path, near: tuple[int, int] = NEAR):
        """The stored paths that may be similar to the probe. The overlap is shared along a path; a subtree is left when neither what is left below it nor of the probe can reach the least bound.

        An item that only one side has is lost to the overlap if all its shingles stand before the other side's last item: were they in the other set, they would be in its prefix.
        """
        items, weights, ends = probe.items()
        at = {item: j for j, item in enumerate(items)}
        meet, end, n, left = probe.meet, items[-1], probe.n, probe.left
        order = sorted((j for j, item in enumerate(items) if item >= meet), key=ends.__getitem__)
        tops, lost = [ends[j] for j in order], [0]
        for j in order:
            lost.append(lost[-1] + weights[j])
        # of the probe what is gone once item j is matched: itself, and what ends before it
        gone = [lost[bisect_left(tops, item)] + weights[j] for j, item in enumerate(items)]
        part, whole = near[0], near[0] + near[1]
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, consumed, shared, passed = stack.pop()
            for path in node[3]:
                if shared + min(path.left - consumed, left - passed) >= overlap_needed(n, path.n, near) and probe.may_reach(path, near):
                    yield path
            for item, child in node[0].items():
                eaten, both, over = consumed, shared, passed
                if item in at:
                    if item < meet:
                        continue
                    eaten, both, over = consumed + child[4], shared + child[4], gone[at[item]]
                elif meet <= item and child[5] < end:
                    eaten += child[4]
                below, mine = child[2] - eaten, left - over
                if (both + (below if below < mine else mine)) * whole >= part * (n + child[1]):
                    stack.append((child, eaten, both, over))


def column(df: DataFrame, name: str, kind=np.int64) -> np.ndarray:
    """A column on the driver; only for results of bounded size."""
    return df.select(name).toArrow().column(name).to_numpy().astype(kind)


def slot(value: np.ndarray) -> np.ndarray:
    """32 bits of a shingle's hash, without the mark of frequent ones."""
    return ((value & np.uint64(2**63 - 1)) >> np.uint64(31)).astype(np.uint32)


def marks(values: np.ndarray, sizes: np.ndarray, parts: int = MARKS) -> np.ndarray:
    """Of each of the sorted lists of these sizes the values that end its 1st, 2nd .. part; the largest long for an empty list."""
    base = np.cumsum(sizes) - sizes
    at = base[:, None] + -(-sizes[:, None] * np.arange(1, parts + 1) // parts) - 1
    out = np.append(values, np.int64(2**63 - 1))[np.where(sizes[:, None] > 0, at, len(values))]
    return out


class Order:
    """What the tasks know of the global order: the frequent shingles, and (None if too many to send) the slots of prefix shingles that repeat."""

    def __init__(self, spark, frequent: np.ndarray, repeated: np.ndarray | None = None):
        self.frequent = spark.sparkContext.broadcast(frequent)
        self.repeated = None if repeated is None else spark.sparkContext.broadcast(repeated)

    def destroy(self) -> None:
        self.frequent.destroy()
        self.forget_slots()

    def forget_slots(self) -> None:
        if self.repeated is not None:
            self.repeated.destroy()
            self.repeated = None


def _texts(docs: DataFrame, order: Order, near: tuple[int, int]) -> DataFrame:
    """Per document: doc_id, key and more, n, sketch, if that had to be shortened its fine form, its prefix as shingles `t` (signed, so that their order is the global one) and places `pos`, without those known to be in one text only; how many those are (`m`), marks of where they stand (`alone`), and the prefix's last shingle (`end`)."""
    kind, frequent, sieve = dict(docs.dtypes)["doc_id"], order.frequent, order.repeated

    def made(batches):
        for part in slices(batches):
            sets = Sets(part.column("text"), frequent.value)
            first = sets.prefix(near)
            if sieve is not None:
                found = slot(sets.value)
                at = np.minimum(np.searchsorted(sieve.value, found), max(0, len(sieve.value) - 1))
                first &= sieve.value[at] == found if len(sieve.value) else False
            signed = (sets.value ^ np.uint64(1 << 63)).view(np.int64)
            whole = sets.prefix(near)
            alone, end = marks(signed[whole & ~first], np.bincount(sets.doc[whole & ~first], minlength=len(sets.size))), marks(signed[whole], np.bincount(sets.doc[whole], minlength=len(sets.size)))[:, -1]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(sets.doc[first], minlength=len(sets.size)))]), pa.int32())
            signed = signed[first]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed, sets.rank[first].astype(np.int32))]
            names = [pa.array(x.view(np.int64)) for x in (sets.key, sets.more)]
            fine = sets.sketches(FINE)
            short = [folded(x) for x in fine]
            fine = [x if len(x) > len(y) else None for x, y in zip(fine, short)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *names, pa.array(sets.size.astype(np.int64)), pa.array(short, pa.binary()), pa.array(fine, pa.binary()), pa.array(np.bincount(sets.doc[whole & ~first], minlength=len(sets.size))), pa.array([x.tobytes() for x in alone], pa.binary()), pa.array(end), *lists], names=["doc_id", "key", "more", "n", "sketch", "fine", "m", "alone", "end", "t", "pos"])

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, key long, more long, n long, sketch binary, fine binary, m long, alone binary, end long, t array<long>, pos array<int>")


def _fresh(sets: Sets) -> np.ndarray:
    """Whether a text is the first of its slice with its key."""
    new = np.zeros(len(sets.size), bool)
    new[np.unique(sets.key, return_index=True)[1]] = True
    return new


def frequent_shingles(docs: DataFrame, near: tuple[int, int] = NEAR, least: int = FREQUENT, most: int = MAX_FREQUENT) -> tuple[np.ndarray, int]:
    """Prefix shingles, in hash order, that repeat within chunks at least so often over all documents (the most frequent `most`, sorted), and the number of all prefix shingles. Equal texts of a chunk count once."""

    def repeated(batches):
        none, total, held = np.zeros(0, np.uint64), 0, []

        def flush():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            again = count > 1
            return pa.RecordBatch.from_arrays([pa.array(value[again].view(np.int64)), pa.array(count[again].astype(np.int64))], names=["value", "n"])

        for part in slices(batches):
            sets = Sets(part.column("text"), none)
            held.append(sets.value[sets.prefix(near) & _fresh(sets)[sets.doc]])
            total += len(held[-1])
            if sum(map(len, held)) > 1 << 20:
                yield flush()
                held = []
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], names=["value", "n"])

    counted = docs.select("text").mapInArrow(repeated, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("value") < 0)).persist(StorageLevel.DISK_ONLY)
    total = counted.where("value < 0").agg(F.sum("n")).first()[0] or 0  # shingles have 63 bits, so -1 is none
    top = column(counted.where("value >= 0").orderBy(F.desc("n"), "value").limit(most), "value")
    counted.unpersist()
    return np.sort(top.view(np.uint64)), total


def repeated_slots(docs: DataFrame, order: Order, near: tuple[int, int] = NEAR, parts: int = 64) -> DataFrame:
    """Slots that occur in the prefixes of more than one text: slot. Slots travel as packed arrays, a range of them to a group."""
    frequent = order.frequent

    def packed(batches):
        held: list[np.ndarray] = []

        def flush():
            found = np.concatenate(held)
            found.sort()
            edges = np.searchsorted(found, np.arange(parts + 1, dtype=np.uint64) * (2**32 // parts))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([found[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["part", "slots"])

        for part in slices(batches):
            sets = Sets(part.column("text"), frequent.value)
            held.append(slot(sets.value[sets.prefix(near) & _fresh(sets)[sets.doc]]))
            if sum(map(len, held)) > 1 << 21:
                yield flush()
                held = []
        if held:
            yield flush()

    def again(table: pa.Table) -> pa.Table:
        found = np.sort(np.frombuffer(b"".join(table.column("slots").to_pylist()), np.uint32))
        return pa.table({"slot": np.unique(found[1:][found[1:] == found[:-1]]).astype(np.int64)})

    return docs.select("text").mapInArrow(packed, "part int, slots binary").groupBy("part").applyInArrow(again, "slot long")


def learned_order(docs: DataFrame, near: tuple[int, int] = NEAR, most_counted: int = MAX_COUNTED, most_slots: int = MAX_SLOTS) -> Order:
    """Learns the frequent shingles and, while they fit, the slots that repeat. Without the latter every prefix shingle is shuffled, with the same result."""
    spark = docs.sparkSession
    frequent, total = frequent_shingles(docs, near)
    order = Order(spark, frequent)
    if total > most_counted:
        return order
    slots = repeated_slots(docs, order, near).persist(StorageLevel.DISK_ONLY)
    if slots.count() <= most_slots:
        order.repeated = spark.sparkContext.broadcast(np.sort(column(slots, "slot", np.uint32)))
    slots.unpersist()
    return order


def dealt_jobs(left: DataFrame) -> DataFrame:
    """For pairs (a, b), each once: where the set of a text is needed, as rows key and jobs, an array of (g, a, b) of about JOBS at most.

    A group g holds the text a, whose b is null, and about PARTNERS of its partners at most. Of a pair, a is the text with more
    partners, so those of a hot text are dealt out to as many groups as it takes, and few texts are side b of many pairs.
    """
    ends = left.select(F.col("a").alias("key")).union(left.select("b")).groupBy("key").agg(F.count("*").alias("n"))
    both = left.join(ends.toDF("a", "na"), "a").join(ends.toDF("b", "nb"), "b")
    swap = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    both = both.select(side("a", "b").alias("a"), side("b", "a").alias("b"), F.greatest("na", "nb").alias("na"), F.least("na", "nb").alias("nb"))
    both = both.withColumn("groups", F.ceil(F.col("na") / PARTNERS))
    dealt = both.withColumn("g", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("groups"))))
    # a text's jobs are dealt out to rows in turn
    part = lambda n: F.pmod(F.xxhash64("g"), F.ceil(F.col(n) / JOBS)).alias("part")
    jobs = dealt.select("g", "a", "b", F.col("b").alias("key"), part("nb")).union(dealt.select("g", "a", F.lit(None).cast("long"), "a", part("groups")).distinct())
    return jobs.groupBy("key", "part").agg(F.collect_list(F.struct("g", "a", "b")).alias("jobs")).select("key", "jobs")


def sets_of_jobs(batches, frequent: np.ndarray, limit: int = CHUNK):
    """Per job of a text: g, a, b and the text's set, in batches of about `limit` bytes of sets, or of one set."""
    for part in slices(batches):
        sets = Sets(part.column("text"), frequent)
        # ids may repeat with other texts; a set belongs to the key that its text has
        mine = (sets.key.view(np.int64) == np.asarray(part.column("key"))) & (sets.more.view(np.int64) == np.asarray(part.column("more")))
        for i, wanted in enumerate(part.column("jobs").to_pylist()):
            if mine[i]:
                blob = sets.value[sets.begin[i] : sets.begin[i + 1]].tobytes()
                step = max(1, limit // max(1, len(blob)))
                for k in range(0, len(wanted), step):
                    some = wanted[k : k + step]
                    yield pa.RecordBatch.from_arrays([*(pa.array([j[c] for j in some], pa.int64()) for c in ("g", "a", "b")), pa.array([blob] * len(some), pa.binary())], names=["g", "a", "b", "values"])


def blobs(column: pa.Array):
    """Sets as they were packed, as views of the column's buffer."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).tolist() if len(column) else [0]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return (data[a:b].view(np.uint64) for a, b in zip(at, at[1:]))


def merged(batches, most: int = 256, limit: int = 4 * CHUNK):
    """Small batches as larger ones, of so many and of about so many bytes at most."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and (len(held) == most or size + b.nbytes > limit):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sifted(pairs: DataFrame, texts: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Those of the pairs (a, b) that fine sketches leave possible. Pairs of which a text has none (its sketch was whole) have been compared as finely as can be."""
    long = texts.where("fine IS NOT NULL").select("id", "n", "fine")
    met = pairs.join(long.toDF("a", "na", "fa"), "a", "left").join(long.toDF("b", "nb", "fb"), "b", "left")

    def possible(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "fa", "nb", "fb")))
            keep = [fa is None or fb is None or may_reach(fa, na, fb, nb, overlap_needed(na, nb, near)) for na, fa, nb, fb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "na", "fa", "nb", "fb").mapInArrow(possible, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, order: Order, near: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of texts that are similar, by prefix trees over whole sets."""
    left = written(sifted(pairs, texts, near))
    # a text and its partners meet in groups of about PARTNERS
    needed = dealt_jobs(left).withColumnRenamed("key", "id").join(texts.select("id", "key", "more", F.col("doc_id").alias("d")), "id").drop("id")
    if left.count() <= MAX_NAMED // 2:
        needed = F.broadcast(needed)
    else:
        needed = needed.hint("shuffle_hash")
    chosen = docs.select("doc_id", "text").join(needed, F.expr("doc_id <=> d")).select("key", "more", "text", "jobs")
    frequent = order.frequent

    sets = chosen.mapInArrow(lambda batches: merged(sets_of_jobs(batches, frequent.value)), "g long, a long, b long, values binary")

    def walked(batches):
        group, probe, tree, count = None, None, PrefixTree(), 0
        a, b = [], []

        def walk():
            if count:
                found = list(tree.links(probe[1], near))
                a.extend([probe[0]] * len(found))
                b.extend(found)

        for batch in batches:
            for g, x, y, values in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b")), blobs(batch.column("values"))):
                if y is None or g != group:
                    walk()
                    tree, count, group = PrefixTree(), 0, g
                    probe = (x, values)
                if y is not None:
                    tree.add(values, y)
                    count += 1
                    if count == PARTNERS:
                        walk()
                        tree, count = PrefixTree(), 0
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        walk()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # the text itself (b is null) comes before its partners
    return sets.repartition("g").sortWithinPartitions("g", F.col("b").asc_nulls_first()).mapInArrow(walked, "a long, b long")


def with_items(rows: DataFrame, table: DataFrame, hot: int) -> DataFrame:
    """Rows joined with a table of items. Those of more than `hot` texts, few, are sent to the rows, so that no partition gets all rows of one."""
    large = F.broadcast(table.where(F.col("texts") > hot))
    rest = rows.join(large.select("item"), "item", "left_anti").join(table.where(F.col("texts") <= hot), "item")
    return rows.join(large, "item").select(*rest.columns).union(rest)


def item_paths(texts: DataFrame) -> tuple[DataFrame, int]:
    """Per text that shares prefix shingles: id, n, sketch, path (its items in order: item, w, top, left, texts); and from how many texts an item is sent to the tasks.

    Shingles in the prefixes of the same texts (as two 64-bit sums of the texts' hashes tell) are one item, named by the first of them: w is how many they are, top the
    last of them, left what remains of the text's set from the first on.
    """
    postings = texts.select("id", "n", F.explode(F.arrays_zip("t", "pos")).alias("p")).select("id", F.col("p.t").alias("item"), (F.col("n") - F.col("p.pos")).alias("left"))
    who = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = postings.groupBy("item").agg(F.count("*").alias("texts"), *who).where("texts > 1")
    items = written(shared.groupBy("texts", "x1", "x2").agg(F.min("item").alias("item"), F.max("item").alias("top"), F.count("*").alias("w")).select("item", "top", "w", "texts"))
    total = texts.agg(F.sum(F.size("t"))).first()[0] or 0
    hot = max(HOT, total // HOT_ITEMS)
    placed = with_items(postings, items, hot).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("item", "w", "top", "left", "texts"))).alias("path"))
    return written(placed.join(texts.select("id", "n", "sketch", "m", "alone", "end"), "id")), hot


class Block:
    """The paths of a block, and their sizes to rule out walks: what is left of each set, less its shingles that no other text has, as far as they stand before the end of the other's prefix (were they in the other, they would be shared). The tree is made for the first walk that isn't ruled out."""

    #: so many paths are compared one by one
    FEW = 24

    def __init__(self) -> None:
        self.rows: list = []
        self.columns = self.tree = None
        self.inner: dict[int, bool] = {}

    @staticmethod
    def least(m, k):
        """How many of m values stand before a place that k of their marks stand before, at least."""
        return -(-m * k // MARKS)

    def before(self, m, k):
        """The same at most."""
        return np.where(k < MARKS, np.maximum(0, self.least(m, k + 1) - 1), m)

    def add(self, path: Path, inner: bool, m: int, alone: bytes, end: int) -> None:
        self.rows.append((path.n, path.left, m, end, path.root, alone, path))
        self.inner[path.key] = inner
        self.columns = self.tree = None

    def possible(self, mine: Path, m: int, alone: bytes, end: int, near: tuple[int, int]) -> bool:
        """Whether lengths leave any path of another group possible for a walker."""
        if len(self.rows) <= self.FEW:
            n, left, whole = mine.n, mine.left, near[0] + near[1]
            return any(r[4] != mine.root and min(r[0], n) * near[1] >= max(r[0], n) * near[0] and min(r[1], left) * whole >= near[0] * (r[0] + n) for r in self.rows)
        if self.columns is None:
            n, left, ms, ends, roots = (np.array(x, np.int64) for x in list(zip(*self.rows))[:5])
            at = np.frombuffer(b"".join(r[5] for r in self.rows), np.int64).reshape(-1, MARKS)
            self.columns = n, left, ms, ends, roots, at, self.before(ms, (at < mine.meet).sum(axis=1))
        n, left, ms, ends, roots, at, gone = self.columns
        own = np.frombuffer(alone, np.int64)
        theirs = left - np.maximum(0, self.least(ms, (at < end).sum(axis=1)) - gone)
        ours = mine.left - np.maximum(0, self.least(m, np.searchsorted(own, ends)) - self.before(m, np.searchsorted(own, mine.meet)))
        fits = (np.minimum(n, mine.n) * near[1] >= np.maximum(n, mine.n) * near[0]) & (roots != mine.root)
        return bool((fits & (np.minimum(theirs, ours) * (near[0] + near[1]) >= near[0] * (n + mine.n))).any())

    def walk(self, mine: Path, near: tuple[int, int]):
        if self.tree is None:
            self.tree = ItemTree()
            for r in self.rows:
                self.tree.add(r[6])
        return self.tree.walk(mine, near)


def lists(column: pa.Array):
    """The lists of a column, as slices of the array of all its values."""
    at, values = column.offsets.to_pylist(), column.values.to_numpy()
    return (values[a:b] for a, b in zip(at, at[1:]))


def _blocks(texts: Column) -> Column:
    return F.ceil(texts / BLOCK).cast("int")


def led_pairs(paths: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Pairs (a, b) to try first: in each block of an item's texts, each text with the first leader that bounds leave possible, or it becomes a leader."""
    p = F.col("p")
    met = paths.select("id", "n", "sketch", F.explode("path").alias("p"))
    g = F.xxhash64(p["item"], F.pmod(F.xxhash64("id", p["item"]), _blocks(p["texts"]))).alias("g")
    rows = met.select(g, "id", "n", p["left"].alias("left"), "sketch").repartition("g").sortWithinPartitions("g", F.xxhash64("id", "g"))

    def led(batches):
        group, leaders = None, []
        for batch in batches:
            a, b = [], []
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "n", "left", "sketch"))):
                if g != group:
                    group, leaders = g, []
                mine = Path(row[0], 0, *row[1:])
                leader = next((x for x in leaders if x.may_reach(mine, near)), None)
                if leader is None:
                    leaders.append(mine)
                else:
                    a.append(min(leader.key, mine.key))
                    b.append(max(leader.key, mine.key))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(led, "a long, b long").distinct()


def open_pairs(paths: DataFrame, tied: DataFrame, hot: int, near: tuple[int, int] = NEAR) -> DataFrame:
    """Pairs (a, b) of texts in other tied groups (id, root) that may be similar, from walks of prefix trees over the items' texts."""
    rooted = paths.join(tied, "id", "left").select("id", "n", "sketch", "m", "alone", "end", "path", F.coalesce("root", "id").alias("root"))
    p = F.col("p")
    met = rooted.select("id", "root", F.explode("path").alias("p")).groupBy(p["item"].alias("item"), p["texts"].alias("texts"), "root").agg(F.count("*").alias("k"))
    mains = written(met.groupBy("item", "texts").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1").select("item", "texts", "main"))
    from_ = F.greatest(F.col("i") - PATH, F.lit(0))
    bring = rooted.select("id", "root", "n", "sketch", "m", "alone", "end", "path", F.posexplode("path").alias("i", "p")).select("id", "root", "n", "sketch", "m", "alone", "end", p["item"].alias("item"), p["left"].alias("left"), F.slice("path", from_ + 1, F.col("i") - from_ + PATH).alias("path"))
    opened = with_items(bring, mains, hot)
    blocks = _blocks(F.col("texts"))
    own = F.array(F.struct(F.pmod(F.xxhash64("id", "item"), blocks).cast("int").alias("block"), F.lit(True).alias("stored")))
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("block"), F.lit(False).alias("stored")))
    # all are stored, each in one block; those outside the item's largest group walk the trees of all blocks
    dealt = opened.withColumn("at", F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(F.concat(own, every))))
    rows = dealt.select(F.xxhash64("item", "at.block").alias("g"), "at.stored", "id", "root", (F.col("root") == F.col("main")).alias("inner"), "n", "left", "sketch", "m", "alone", "end", F.col("item").alias("meet"), "path.item", "path.w", "path.top")

    def walked(batches):
        group, block = None, Block()
        for batch in batches:
            a, b = [], []
            for g, stored, inner, m, alone, end, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "stored", "inner", "m", "alone", "end", "id", "root", "n", "left", "sketch", "meet")), *(lists(batch.column(c)) for c in ("item", "w", "top"))):
                if g != group:
                    group, block = g, Block()
                mine = Path(*row)
                if stored:
                    block.add(mine, inner, m, alone, end)
                elif block.possible(mine, m, alone, end, near):
                    for other in block.walk(mine, near):
                        # two walkers meet twice
                        if other.root != mine.root and (block.inner[other.key] or other.key > mine.key):
                            a.append(min(other.key, mine.key))
                            b.append(max(other.key, mine.key))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g", F.desc("stored")).mapInArrow(walked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that similar texts lead to).

    A set is the distinct 5-word shingles of the lower-cased (A-Z) text; a text of fewer words has its whole sequence as
    one; null texts and texts without words have an empty set, and are linked with nothing, not even each other. Repeated rows and equal texts are
    linked. Where all ids of a component are null so is its id. An empty table gives an empty result; other columns are ignored.
    Intermediate tables are written to the checkpoint folder.
    """
    order = learned_order(docs, near)
    wide, path = written_at(_texts(docs, order, near))
    order.forget_slots()
    # equal texts, however many, are one text from here on; its number is fixed as it is written
    texts = wide.where("n > 0").groupBy("key", "more").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "sketch", "fine", "m", "alone", "end", "t", "pos")).alias("s")).select("key", "more", "doc_id", "s.*")
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()))
    rows = written_short(wide.select("doc_id", "key", "more", "n"), wide.count())
    cleared(docs.sparkSession, path)  # all that is read from here on is in these two
    paths, hot = item_paths(texts)
    links = written(_verified(led_pairs(paths, near), texts, docs, order, near))
    # near copies meet different leaders in different blocks; as components they are one group, whose pairs need no more trials
    tied = components(links).withColumnRenamed("node", "id")
    more = written(_verified(open_pairs(paths, tied, hot, near), texts, docs, order, near))
    order.destroy()
    tied = components(links.union(more)).withColumnRenamed("node", "id")
    ids = texts.select("id", "key", "more", "doc_id").join(tied, "id", "left").select("key", "more", "doc_id", F.coalesce("root", "id").alias("root"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    owner = ids.select("key", "more", "root").join(least, "root").select("key", "more", "component_id")
    # texts without words are in no group; were they joined, all would have one key
    linked = rows.where("n > 0").join(owner, ["key", "more"]).select("doc_id", "n", "component_id")
    out = linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """One document of each group, that of the smallest id, with its columns; of rows that repeat id and text, one.

    Texts without words are in no group and stay. An id stands for one document: of rows with one id and other texts all stay if
    one is its group's smallest.
    """
    found = near_duplicates(docs, near)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(name).distinct()
    kept = docs.select(F.struct(*docs.columns).alias("_row"), name, F.xxhash64("text").alias("_t")).join(keep, "_id", "left_semi")
    # the join's partitions serve the window too, so the texts move once
    first = F.row_number().over(Window.partitionBy("_id", "_t").orderBy(F.col("_row.doc_id").isNull()))
    return kept.withColumn("_n", first).where("_n = 1").select("_row.*")
