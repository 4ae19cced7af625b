"""Best-fit packing of token pieces, after a reduction by dominance.

Pieces of one length can stand for each other, so a packing is decided on how many there are of each length: at most
`capacity` numbers, whatever the corpus. On these the reduction fixes sets that are in some best packing (Martello and
Toth): a set of pieces beside a given piece dominates where every other set that fits could be exchanged for it piece by
piece. What no rule fixes is packed best fit, longest first. The packing is a short list of runs (length, ranks, first
sequence, how many per sequence, offset), and each piece finds its place by its length and its rank among the pieces of
that length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import offsets, written

CAPACITY, END = 2048, 0
#: characters that are encoded at a time, so that a task holds few ids
BATCH_CHARS = 1 << 20


class Run(NamedTuple):
    """Pieces of `length` with ranks `low` to `high` - 1, `per` of them in each sequence from `sequence` on, the first at `offset`."""

    length: int
    low: int
    high: int
    sequence: int
    per: int
    offset: int


def dominant(counts: np.ndarray, j: int) -> tuple[int, ...] | None:
    """Lengths that, beside one piece of length j, are in some best packing of the pieces in `counts` (by length, up to the capacity); None where no rule decides."""
    room = len(counts) - 1 - j
    rest = counts.copy()
    rest[j] -= 1
    there = np.flatnonzero(rest)
    small = np.repeat(there[:3], np.minimum(rest[there[:3]], 3))[:3]  # the three smallest others
    if not len(small) or small[0] > room:
        return ()
    best = int(there[bisect_left(there, room + 1) - 1])
    if best == room or len(small) < 2 or small[:2].sum() > room:
        return (best,)
    if len(small) > 2 and small.sum() <= room:
        return None
    # at most two others fit: the fullest pair, with its longer piece as long as possible
    below = np.zeros(len(counts), np.int64)
    below[there] = there
    below = np.maximum.accumulate(below)
    a = there[there < room]
    b = below[np.minimum(room - a, a)]
    twice = (b == a) & (rest[a] < 2)
    b[twice] = below[a[twice] - 1]
    full = np.where(b > 0, a + b, 0)
    at = len(full) - 1 - int(np.argmax(full[::-1]))
    a, b = int(a[at]), int(b[at])
    if best >= a + b:
        return (best,)
    if a != best:
        return None
    rest[a] -= 1
    above = np.flatnonzero(rest[b + 1 :])[:2] + b + 1
    next_two = np.repeat(above, np.minimum(rest[above], 2))[:2]
    return (a, b) if len(next_two) < 2 or next_two.sum() > room else None


class Packing:
    """A packing of `counts[length]` pieces: `runs`, the number of `sequences`, and how many of them the reduction fixed."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, np.int64)
        self.ranks = dict.fromkeys(counts, 0)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of length {length} in sequences of {capacity}")
            self.left[length] = n
        while self._reduce():
            pass
        self.fixed = self.sequences
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        low = self.ranks[length]
        self.ranks[length] = low + n
        self.left[length] -= n
        self.runs.append(Run(length, low, low + n, sequence, per, offset))

    def _reduce(self) -> bool:
        """One pass over the lengths, longest first, that fixes dominant sets as often as their pieces last; fewer pieces leave fewer sets that fit, so a set stays dominant. Whether it fixed any."""
        before = self.sequences
        for j in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[j] and (others := dominant(self.left, j)) is not None:
                members = (j, *others)
                times = min(int(self.left[m]) // members.count(m) for m in members)
                offset = 0
                for m in members:
                    self._take(m, times, self.sequences, 1, offset)
                    offset += m
                self.sequences += times
        return self.sequences > before

    def _best_fit(self) -> None:
        """Longest first, each piece into the fullest sequence with room for it. Sequences of one fill are kept as ranges."""
        open_ones: dict[int, list[tuple[int, int]]] = {}

        def fill(s: int, room: int, first: int, n: int, per: int) -> None:
            self._take(s, n * per, first, per, self.capacity - room)
            if room > per * s:
                open_ones.setdefault(room - per * s, []).append((first, n))

        for s in np.flatnonzero(self.left)[::-1].tolist():
            for room in sorted(r for r in open_ones if r >= s):
                per = room // s
                ranges = open_ones.pop(room)
                while ranges and self.left[s]:
                    first, n = ranges.pop()
                    whole = min(n, int(self.left[s]) // per)
                    if whole:
                        fill(s, room, first, whole, per)
                    if whole < n and self.left[s]:  # fewer than one sequence takes
                        fill(s, room, first + whole, 1, int(self.left[s]))
                        whole += 1
                    if whole < n:
                        ranges.append((first + whole, n - whole))
                if ranges:
                    open_ones.setdefault(room, []).extend(ranges)
                if not self.left[s]:
                    break
            per = self.capacity // s
            for n, each in ((int(self.left[s]) // per, per), (1, int(self.left[s]) % per)):
                if n and each:
                    fill(s, self.capacity, self.sequences, n, each)
                    self.sequences += n


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Token ids of a text by the tokenizer file `vocabulary`, without special tokens added.

    `ranks` and `pattern` may give the same byte-level vocabulary as a rank file, which encodes several times faster; texts with a
    special token's string or with very long white space then still go to the tokenizer.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    odd = re.compile("|".join([r"\s{1000}", *(re.escape(t.content) for t in slow.get_added_tokens_decoder().values())]))
    return lambda text: (slow.encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text))


def pieces(docs: DataFrame, make_encoder: Callable[[], Callable[[str], list[int]]], capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, with `keep_ids`, ids.

    A document is its ids and END. One of more than `capacity` ids is cut from its end into pieces of that many, so only its first piece is shorter. A
    null text is an empty one: a piece of END alone.
    """
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "array<int>"} if keep_ids else {})

    def rows_of(doc, ids: np.ndarray) -> Iterator[tuple]:
        first = (len(ids) - 1) % capacity + 1
        begin = 0
        for k, end in enumerate(range(first, len(ids) + 1, capacity)):
            part = ids[begin:end]
            yield (doc, k, begin, end - begin, zlib.crc32(part.tobytes()), *([part.view("<i4")] if keep_ids else []))
            begin = end

    def cut(batches):
        encode = make_encoder()
        out: list[tuple] = []
        chars = 0
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encode(text.as_py() or "")
                ids.append(END)
                out += rows_of(doc.as_py(), np.array(ids, "<u4"))
                chars += len(ids)
                if chars > BATCH_CHARS:
                    yield batch(out)
                    out, chars = [], 0
        yield batch(out)

    schema = ", ".join(f"{name} {kind if isinstance(kind, str) else kind.simpleString()}" for name, kind in kinds.items())
    names = list(kinds)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kinds["doc_id"]), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def placed(ranked: DataFrame, runs: list[Run]) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, rank). There are a few runs per length, so they go with the tasks."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    names = [c for c in ranked.columns if c != "rank"]
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(batches):
        for b in batches:
            at = np.searchsorted(keys, (b["length"].to_numpy() << 48) | b["rank"].to_numpy(), "right") - 1
            length, low, _, sequence, per, offset = table[at].T if len(table) else np.zeros((6, 0), np.int64)
            t = b["rank"].to_numpy() - low
            yield pd.DataFrame({n: b[n] for n in names} | {"sequence_id": sequence + t // per, "offset": offset + t % per * length})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, make_encoder: Callable[[], Callable[[str], list[int]]], capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids with `keep_ids`.

    Null texts are pieces of one id; null and repeated ids keep their rows; other columns are ignored; an empty table gives no piece. Only
    counts per length reach the driver. Pieces of a length are ranked within the parts that wrote them, so that a length which a third of all pieces have is not one task's work.
    """
    cut = written(pieces(docs, make_encoder, capacity, keep_ids).withColumn("row", F.monotonically_increasing_id()))
    parts = cut.withColumn("part", F.shiftright("row", 33))
    counts = written(parts.groupBy("length", "part").agg(F.count("*").alias("n")))
    packing = Packing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = offsets(counts, ["length"], ["part"], "n", "before").select("length", "part", "before")
    ranked = parts.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))).join(before, ["length", "part"])
    names = [c for c in cut.columns if c != "row"]
    return placed(ranked.select(*names, (F.col("before") + F.col("k") - 1).alias("rank")), packing.runs)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of pieces that kept their ids: sequence_id, ids, and starts (where a new piece begins). A group is one sequence, at most the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts")
    )
