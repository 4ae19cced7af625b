"""Substring dedup with prefix-partitioned sparse suffix trees.

Windows of `window` words are removed where the same words also start earlier. Suffixes are taken at anchors only: the anchor of
a window is the start of its 8-word gram of least hash, which depends on the window's words alone, so equal windows have equal anchors
and the trees hold about one suffix in seven.

1. The first 8 words of the suffixes are counted over all documents. A suffix whose prefix occurs once repeats nowhere and is dropped.
2. The rest is dealt out by prefix. A suffix brings its words (as text) as far as its windows reach, to the right and to the
   left. Where too many suffixes share 8 words, prefixes are as long as the window and suffixes start at every window; a group is then one node of the
   tree and is read as a stream. Stretches that a chunk of documents has twice are settled there, so a passage in a third of all documents reaches
   its group once per chunk.
3. A group's suffixes are sorted by their words, and lengths of common prefixes of neighbours give the nodes of the suffix tree at every
   depth; the words to the left, sorted from the anchor back, give those of the reversed tree. A window that reaches d words to the left of its anchor repeats where
   suffixes share a node of depth window - d and a reversed node of depth d. In document order all but the first of them are removed. The nodes that
   no longer prefix holds too are the maximal repeats; as every window in them is removed, they come out as runs of starts.

Words are sorted by 64-bit hashes; what is removed has been compared as words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written
from quillon.llm.jaccard import slices
from quillon.llm.words import Words, grams, inside, mixed, sliding_argmin

WINDOW = 20
GRAM = 8
#: anchors that occur more often get prefixes as long as the window
MAX_GROUP = 5_000
#: up to so many repeated anchors are sent to the tasks as a sorted array; beyond, texts are joined with theirs by a shuffle
MAX_SENT = 4_000_000
#: suffixes that a task holds as a tree at once
BLOCK = 1 << 18
#: up to so many documents with removals, and removed stretches, are broadcast
MAX_DOCS, MAX_RUNS = 500_000, 4_000_000
NO_ID = -(1 << 63)


class Anchored:
    """Windows of a slice of texts: `start` (word), `anchor` (word), and the anchor's gram."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.words = Words(texts)
        self.hash = self.words.hashes()
        g = grams(self.hash, gram)
        g[~inside(self.words, gram)[: len(g)]] = np.uint64(2**64 - 1)
        least = sliding_argmin(g, window - gram + 1) if len(g) >= window - gram + 1 else np.zeros(0, np.int64)
        self.start = np.flatnonzero(inside(self.words, window)[: len(least)])
        self.anchor = least[self.start]
        self.gram = g


def anchor_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """How often each anchor occurs: anchor, n. Equal texts of a chunk count once, or twice if they have other ids."""

    def counted(batches):
        for part in slices(batches):
            at = Anchored(part.column("text"), window)
            value, n = np.unique(at.gram[np.unique(at.anchor)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.select("text").mapInArrow(counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


_STRETCH = "grp long, whole boolean, id long, key long, at int, last int, mid int, words binary"


def _emit(grp, whole, ids, keys, at, last, mid, words) -> pa.RecordBatch:
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (at, last, mid)]
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(whole, pa.bool_()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *ints, pa.array(words, pa.binary())], names=["grp", "whole", "id", "key", "at", "last", "mid", "words"])


def stretches(batches, wanted, window: int = WINDOW):
    """Suffixes whose prefixes repeat, with the windows (at to last) whose anchor they start at; mid is the anchor's place after the first window's start. `wanted` gives for a slice and its anchors' grams whether they repeat and whether their groups are large.

    Rows without words are removals that the chunk itself settles.
    """
    for part in slices(batches):
        column = part.column("text")
        texts, ids, keys = column.to_pylist(), np.asarray(pc.fill_null(part.column("id"), NO_ID), np.int64), np.asarray(part.column("key"), np.int64)
        order = np.lexsort((ids, keys))
        same = np.zeros(len(ids), bool)
        same[1:] = [keys[i] == keys[j] and texts[i] == texts[j] for i, j in zip(order[1:], order)]
        copy = np.zeros(len(ids), bool)
        copy[order] = same
        head = np.zeros(len(ids), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))] if len(ids) else order
        at = Anchored(column, window)
        first, count = at.words.first, at.words.count
        whole = np.flatnonzero(copy & (ids != ids[head]) & (count >= window))  # a later copy goes altogether
        if len(whole):
            zero = np.zeros(len(whole), np.int64)
            yield _emit(mixed(ids[whole].view(np.uint64)).view(np.int64), zero > 0, ids[whole], keys[whole], zero, count[whole] - window, zero, [None] * len(whole))
        start, anchor = at.start, at.anchor
        keep, large = wanted(part, at, start, anchor)
        keep &= ~copy[at.words.doc[start]]
        start, anchor, large = start[keep], anchor[keep], large[keep]
        if not len(start):
            continue
        doc = at.words.doc[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | large[1:]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(start)) - 1
        s0, s1, doc, large = start[lo], start[hi], doc[lo], large[lo]
        raw = at.words.buffer.tobytes()
        words = [raw[a:b] for a, b in zip(at.words.start[s0].tolist(), at.words.end[s1 + window - 1].tolist())]
        w = grams(at.hash, window)
        # as stretches are shorter than two windows, the first and last window have all their words
        name = mixed(mixed(w[s0] * np.uint64(3) + w[s1]) + (s1 - s0).astype(np.uint64))
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((keys, ids))] = np.arange(len(ids))
        order = np.lexsort((s0, rank[doc], name))
        again = np.zeros(len(s0), bool)
        lead = 0
        for i, j in zip(order[1:][name[order][1:] == name[order][:-1]].tolist(), order[:-1][name[order][1:] == name[order][:-1]].tolist()):
            lead = lead if again[j] else j
            again[i] = words[i] == words[lead] or words[i].split() == words[lead].split()
        group = np.where(large, mixed(w[s0]), at.gram[anchor[lo]]).view(np.int64)
        group[again] = mixed(ids[doc[again]].view(np.uint64)).view(np.int64)
        mid = np.where(large, 0, anchor[lo] - s0)
        yield _emit(group, large, ids[doc], keys[doc], s0 - first[doc], s1 - first[doc], mid, [None if r else x for r, x in zip(again.tolist(), words)])


def _nodes(group: np.ndarray, steps: list[np.ndarray]) -> list[np.ndarray]:
    """For sequences given by their 1st, 2nd .. words: node of each at depth 0, 1 .. of the tree of its group, from the sorted sequences and the lengths that neighbours share."""
    order = np.lexsort((*reversed(steps), group))
    apart = np.ones(len(order), bool)
    apart[1:] = group[order][1:] != group[order][:-1]
    out = []
    for words in [None, *steps]:
        if words is not None:
            apart[1:] |= words[order][1:] != words[order][:-1]
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(apart)
        out.append(node)
    return out


def subtree_repeats(group: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, last: np.ndarray, mid: np.ndarray, texts: list[bytes], window: int = WINDOW):
    """Windows of one or more groups that aren't the first of their node: (row, offset in the row's stretch). Rows stand by group, then in document order."""
    words = Words(pa.array(texts, pa.large_binary()))
    h, first, size = np.append(words.hashes(), np.uint64(0)), words.first[:-1], words.count
    anchor, deepest = first + mid, int(mid.max(initial=0))
    none = len(h) - 1
    right = _nodes(group, [h[np.where(mid + k < size, anchor + k, none)] for k in range(window)])
    left = _nodes(group, [h[np.where(mid >= k, anchor - k, none)] for k in range(1, deepest + 1)])
    found = [(np.zeros(0, np.int64),) * 3]
    for d in range(deepest + 1):
        mine = np.flatnonzero((mid >= d) & (mid - d <= last - at))
        node = right[window - d][mine] * np.int64(len(group) + 1) + left[d][mine]
        order = np.argsort(node, kind="stable")
        inner = np.zeros(len(mine), bool)
        inner[1:] = node[order][1:] == node[order][:-1]
        head = np.maximum.accumulate(np.where(inner, 0, np.arange(len(mine)))) if len(mine) else order
        a, b = mine[order[inner]], mine[order[head[inner]]]
        itself = (ids[a] == ids[b]) & (keys[a] == keys[b]) & (at[a] + mid[a] == at[b] + mid[b])  # a repeated row of the table
        found.append((a[~itself], b[~itself], np.full((~itself).sum(), d)))
    row, lead, d = (np.concatenate(x) for x in zip(*found))
    # chance of hashes makes no repeat: compare each row with its leads, all windows of a pair at once
    order = np.lexsort((d, lead, row))
    row, lead, d = row[order], lead[order], d[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])
    begin = np.flatnonzero(new)
    unlike: set[int] = set()
    for i, j in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist()):
        r, t, far, near = int(row[i]), int(lead[i]), int(d[j - 1]), int(d[i])
        x, y = texts[r].split()[mid[r] - far : mid[r] - near + window], texts[t].split()[mid[t] - far : mid[t] - near + window]
        if x != y:
            unlike.add(int(group[r]))
    offset = mid[row] - d
    if unlike:  # groups with colliding hashes are read word by word
        sure = ~np.isin(group[row], list(unlike))
        slow = [_in_order(r, ids, keys, at, last, texts, window) for r in (np.flatnonzero(group == g) for g in unlike)]
        return np.concatenate([row[sure], *(x[0] for x in slow)]), np.concatenate([offset[sure], *(x[1] for x in slow)])
    return row, offset


def _in_order(rows: np.ndarray, ids, keys, at, last, texts, window: int):
    """As subtree_repeats, for the rows of one group, by the words themselves."""
    heads: dict[tuple, tuple] = {}
    out: list[tuple[int, int]] = []
    for r in rows.tolist():
        words = texts[r].split()
        for o in range(int(last[r] - at[r]) + 1):
            place = (ids[r], keys[r], at[r] + o)
            if heads.setdefault(tuple(words[o : o + window]), place) != place:
                out.append((r, o))
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def removals(rows: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Starts of the windows to remove as stretches (id, key, at, last), from suffixes dealt out by prefix."""

    def settle(table: pa.Table):
        group, ids, keys, at, last, mid = (table.column(c).to_numpy() for c in ("grp", "id", "key", "at", "last", "mid"))
        r, o = subtree_repeats(group, ids, keys, at, last, mid, table.column("words").to_pylist(), window)
        order = np.lexsort((o, r))
        r, o = r[order], o[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(r))[: len(lo)] - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[r[lo]]), pa.array(keys[r[lo]]), pa.array((at[r[lo]] + o[lo]).astype(np.int32)), pa.array((at[r[lo]] + o[hi]).astype(np.int32))], names=["id", "key", "at", "last"])

    def trees(batches):
        held: list[pa.RecordBatch] = []
        count, stream, heads = 0, None, {}
        for batch in batches:
            settled = batch.column("words").is_null()
            yield batch.filter(settled).select(["id", "key", "at", "last"])
            # a prefix as long as the window: the first of the group stays, whatever their number
            single = batch.filter(pc.and_(batch.column("whole"), pc.invert(settled)))
            gone = []
            for i, (g, *place, text) in enumerate(zip(*(single.column(c).to_pylist() for c in ("grp", "id", "key", "at", "words")))):
                if g != stream:
                    stream, heads = g, {}
                gone.append(heads.setdefault(b" ".join(text.split()), place) != place)
            yield single.filter(pa.array(gone, pa.bool_())).select(["id", "key", "at", "last"])
            batch = batch.filter(pc.invert(pc.or_(batch.column("whole"), settled)))
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= block // 8:
                table = pa.Table.from_batches(held)
                group = table.column("grp").to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on; it has as many suffixes as its prefix was counted
                if cut:
                    yield settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                count = len(group) - cut
        if held:
            yield settle(pa.Table.from_batches(held))

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "id", "key", "at")
    return dealt.mapInArrow(trees, "id long, key long, at int, last int")


def _merged(runs: DataFrame, window: int) -> DataFrame:
    """Per document (id) its removed words per text: list of (key, [(from, to)])."""
    per_text = runs.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("runs"))

    def merge(batches):
        for batch in batches:
            out = []
            for runs_ in batch.column("runs").to_pylist():
                spans: list[list[int]] = []
                for r in runs_:
                    if spans and r["at"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + window)
                    else:
                        spans.append([r["at"], r["last"] + window])
                out.append([x for s in spans for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(out, pa.list_(pa.int32()))], names=["id", "key", "spans"])

    return per_text.mapInArrow(merge, "id long, key long, spans array<int>")


def deduplicated(docs: DataFrame, window: int = WINDOW, max_sent: int = MAX_SENT, max_group: int = MAX_GROUP, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its words that stay, joined by one space).

    A word is removed when a window that covers it has the same words as a window that starts earlier: in a document of a smaller id, or in
    the same document. A null id is the smallest. Rows of one id and text are one document and get the same result; of one id and other
    texts, the text's hash orders them. Null and empty texts and texts below the window's length lose nothing. Ids are integers. An empty table gives an empty
    result; other columns are ignored. The list of removals is written to the checkpoint folder.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    counts = anchor_counts(rows, window).where("n > 1").persist(StorageLevel.DISK_ONLY)
    if counts.count() <= max_sent:
        sent = counts.select("anchor", (F.col("n") > max_group).alias("large")).toArrow()  # bounded by max_sent
        value = sent.column("anchor").to_numpy().view(np.uint64)
        order = np.argsort(value)
        known = rows.sparkSession.sparkContext.broadcast((value[order], sent.column("large").to_numpy()[order]))
        del sent, value, order

        def wanted(part, at, start, anchor):
            value, large = known.value
            if not len(value):
                return np.zeros(len(start), bool), np.zeros(len(start), bool)
            g = at.gram[anchor]
            i = np.minimum(np.searchsorted(value, g), len(value) - 1)
            # equal texts of a chunk are settled by their key, so their anchors needn't repeat elsewhere
            return value[i] == g, large[i]

        source = rows.select("id", "key", "text")
    else:
        known = None
        source, wanted = _with_anchors(rows, counts, window, max_group), _listed_anchors
    found = source.mapInArrow(lambda batches: stretches(batches, wanted, window), _STRETCH)
    merged = written(_merged(removals(found, window), window))
    counts.unpersist()
    if known is not None:
        known.destroy()
    size = merged.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("runs")).first()
    small = size["n"] <= max_docs and (size["runs"] or 0) <= 2 * MAX_RUNS
    keyed = rows.select("doc_id", "text", F.coalesce("id", F.lit(NO_ID)).alias("id"), "key")
    joined = keyed.join(F.broadcast(merged) if small else merged.hint("shuffle_hash"), ["id", "key"], "left").select("doc_id", "text", "spans")

    def kept(batches):
        for batch in slices(batches):
            n, gone, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode().split()  # bytes split at ASCII white space only
                n.append(len(words))
                at, left = 0, []
                for a, b in zip(spans[::2], spans[1::2]) if spans else ():
                    left += words[at:a]
                    at = b
                left += words[at:]
                gone.append(len(words) - len(left))
                texts.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(kept, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")


def _with_anchors(rows: DataFrame, counts: DataFrame, window: int, max_group: int) -> DataFrame:
    """Each text with those of its anchors that repeat, by shuffles: for corpora whose repeated anchors are too many to send."""

    def listed(batches):
        for part in slices(batches):
            at = Anchored(part.column("text"), window)
            anchors = np.unique(at.anchor)
            doc = at.words.doc[anchors] if len(anchors) else anchors
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("key"), np.int64)[doc]), pa.array(at.gram[anchors].view(np.int64))], names=["key", "anchor"])

    anchors = rows.select("text", "key").mapInArrow(listed, "key long, anchor long").distinct()
    repeated = anchors.join(counts, "anchor").groupBy("key").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"), F.collect_list(F.when(F.col("n") > max_group, F.col("anchor"))).alias("large"))
    return rows.select("id", "key", "text").join(repeated.hint("shuffle_hash"), "key", "left").select("id", "key", "text", "anchors", "large")


def _listed_anchors(part, at, start, anchor):
    g, doc = at.gram[anchor].view(np.int64), at.words.doc[start]
    keep, large = np.zeros(len(start), bool), np.zeros(len(start), bool)
    first = np.searchsorted(doc, np.arange(len(part.column("text")) + 1))
    for i, (a, b) in enumerate(zip(part.column("anchors").to_pylist(), part.column("large").to_pylist())):
        if a:
            mine = slice(first[i], first[i + 1])
            keep[mine], large[mine] = np.isin(g[mine], np.array(a, np.int64)), np.isin(g[mine], np.array(b, np.int64))
    return keep, large
