"""Media columns: content-defined chunks, stored once, read back and verified.

A payload is cut where a rolling gear hash of its last 32 bytes has its low bits zero, so an insertion moves few
cuts. Chunks are named by their SHA-256 and stored compressed; a payload is the ordered list of
its chunks' names. Reading joins the lists with the store, in which each
chunk is once, checks every chunk against its name and puts the payload together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
LEAST, MASK_BITS, MOST = 2 << 10, 13, 64 << 10
MAGIC = b"GCDC"
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.int64).astype(np.uint32)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of 64; null is empty."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def cuts(data: bytes, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of a payload, the last included."""
    n, out, at = len(data), [], 0
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    k = 1
    while k < 32:  # the sum over the last 32 bytes of gear << age, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    marks = np.flatnonzero((h & np.uint32(((1 << bits) - 1) << (32 - bits))) == 0) + 1
    while n - at > least:
        j = np.searchsorted(marks, at + least)
        end = min(int(marks[j]) if j < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def stored_form(parts: list[tuple[bytes, bytes]]) -> bytes:
    """A payload as it is stored: magic, number of chunks, and of each its digest, the length of its compressed bytes, and these."""
    return MAGIC + struct.pack("<I", len(parts)) + b"".join(digest + struct.pack("<I", len(packed)) + packed for digest, packed in parts)


def read_form(media: bytes) -> bytes:
    """The payload of a stored form. Raises where a chunk isn't what its name says."""
    if media[:4] != MAGIC:
        raise ValueError("not a chunked payload")
    (n,), at, out, unpack = struct.unpack_from("<I", media, 4), 8, [], zstandard.ZstdDecompressor()
    for _ in range(n):
        digest, (size,) = media[at : at + 32], struct.unpack_from("<I", media, at + 32)
        chunk = unpack.decompress(media[at + 36 : at + 36 + size], max_output_size=MOST)
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError("a stored chunk differs from its digest")
        out.append(chunk)
        at += 36 + size
    return b"".join(out)


def cut_table(texts: DataFrame, pack_them: bool) -> DataFrame:
    """The chunks of each text (key, text): key, at, of (chunks of the payload), digest, and with `pack_them` the compressed bytes where the task sends the chunk for the first time (null: sent before)."""

    def cut(batches):
        pack = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        done: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(b["key"], b["text"]):
                if key in done:  # equal payloads of a task are cut once
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(key)
                data, begin = payload(text), 0
                ends = cuts(data)
                for at, end in enumerate(ends):
                    chunk = data[begin:end]
                    digest, begin = hashlib.sha256(chunk).digest(), end
                    packed = None
                    if pack_them and digest not in seen:
                        if len(seen) > 200_000:  # what is forgotten is sent again
                            seen.clear()
                        seen.add(digest)
                        packed = pack.compress(chunk)
                        held += len(packed)
                    rows.append((key, at, len(ends), digest, packed))
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=["key", "at", "of", "digest", "packed"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["key", "at", "of", "digest", "packed"])

    return texts.select("key", "text").mapInPandas(cut, "key binary, at int, of int, digest binary, packed binary")


def stored_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The payloads of all documents: the store (digest, packed; each chunk once), the lists (key, at, of, digest), and the documents' keys (doc_id, n_bytes, key). To keep them, write the three."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    store = cut_table(keyed, True).where("packed IS NOT NULL").groupBy("digest").agg(F.first("packed").alias("packed"))
    lists = cut_table(keyed, False).select("key", "at", "of", "digest").distinct()
    names = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    return store, lists, names


def describe(data: bytes, chunks: int) -> str:
    """A few features of a payload as text."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return f"chunks={chunks};distinct={len(p)};entropy={-(p * np.log2(p)).sum() + 0.0:.6f};mean={float((counts * np.arange(256)).sum()) / len(data):.6f}"


def reassemble(listed: DataFrame) -> DataFrame:
    """Per key from its chunks [(at, digest, packed)]: the stored form, and what is read from it: size, digests and features."""

    def build(batches):
        for b in batches:
            out = []
            for key, parts in zip(b["key"], b["parts"]):
                media = stored_form([(p["digest"], p["packed"]) for p in sorted(parts, key=lambda p: p["at"])])
                data = read_form(media)
                out.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(data, len(parts))))
            yield pd.DataFrame(out, columns=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return listed.mapInPandas(build, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text is an empty payload of 64 zeros. Equal texts are stored once and get equal values; null ids and
    repeated rows keep their rows; other columns are ignored; an empty table gives an empty result.
    A payload of one chunk is read right after the join with the store; only the chunks of longer ones are moved once more, to the key
    that puts them in order. A chunk that many payloads share is one row of the store. The media columns are the size and digest of the form that was
    stored: names and compressed chunks.
    """
    store, lists, names = stored_media(docs)
    found = lists.join(store, "digest")
    part = F.struct("at", "digest", "packed")
    single = found.where("of = 1").select("key", F.array(part).alias("parts"))
    several = found.where("of > 1").groupBy("key").agg(F.collect_list(part).alias("parts"))
    built = reassemble(single.unionByName(several))
    return names.join(built, "key").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
