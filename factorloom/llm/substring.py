"""Substring dedup with Rabin-Karp hashes of every window of ``WINDOW`` words.

Documents are dealt to blocks by a hash of id and text. A first pass over the blocks rolls a 64-bit Rabin-Karp hash over
every window and sends, for each bucket of hashes, one row with the block's distinct hashes and the smallest doc_id that
each has in the block. The buckets find the smallest doc_id of all blocks. Only one bit for each distinct hash goes back
to the blocks: whether another block has a smaller doc_id than this one. There a second pass rolls the same hashes, marks
windows that a smaller document has, merges them into maximal removal intervals and cuts the words out. A passage that a
third of all documents share reaches its bucket once for each block, not for each document.

Blocks and buckets are dealt to as many tasks as the bytes of the texts ask for, so a task stays as large as it is when the
table grows.

Nulls: a null text has no words. A row with a null ``doc_id`` is never smaller than another, and loses no words, so it
takes no part in the shuffles. Rows repeated under one doc_id are one document: they do not remove each other's words. Empty texts give empty texts, an empty
table an empty table. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

WINDOW = 13
#: Documents for each block, and bytes of text for each bucket; both set how much one task holds.
DOCS_PER_BLOCK = 1_024
BYTES_PER_BUCKET = 32_000_000
#: Bytes of text whose blocks or hashes one task should get.
BYTES_PER_TASK = 16_000_000
#: Hash buckets are a power of two, at least 2**8, so that 7 bytes hold the rest of a hash.
LEAST_BUCKET_BITS = 8
#: The base of the rolling hash, an odd number, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """Word to 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)])[:n]


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The Rabin-Karp hash (modulo 2**64) of every window of ``words``, by prefix sums."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    known = WordHashes()
    values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.empty(len(words) - window + 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(out), 1 << 20):
            part = values[lo : lo + (1 << 20) + window - 1]
            sums = np.cumsum(np.r_[np.uint64(0), part * _powers(INVERSE, len(part))], dtype=np.uint64)
            n = len(part) - window + 1
            out[lo : lo + n] = (sums[window:] - sums[:-window]) * _powers(BASE, n + window - 1)[window - 1 :]
    return out


class Block:
    """The documents of a block in a fixed order, with the hashes of all windows that lie within one document."""

    def __init__(self, rows: pd.DataFrame, window: int):
        rows = rows.sort_values(["doc_id", "content"], kind="stable")
        self.ids = [int(x) for x in rows["doc_id"]]
        self.words = [t.encode().split() for t in rows["text"]]
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.counts = np.maximum(self.lengths - window + 1, 0)
        hashes = window_hashes([w for doc in self.words for w in doc], window)
        first = np.cumsum(self.lengths) - self.lengths
        at = np.repeat(first - (np.cumsum(self.counts) - self.counts), self.counts) + np.arange(self.counts.sum())
        self.hashes = hashes[at] if len(at) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.words)), self.counts)
        self.id = np.array(self.ids, np.int64)

    def groups(self, bits: int) -> "Groups":
        """The windows, grouped by hash; groups in the order of buckets, which are the low bits of the hash."""
        h = self.hashes
        key = (h << np.uint64(64 - bits)) | (h >> np.uint64(bits))
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        owner = self.id[self.doc[order]]
        least = np.minimum.reduceat(owner, starts) if len(starts) else np.empty(0, np.int64)
        bucket = (key[starts] >> np.uint64(64 - bits)).astype(np.int64)
        buckets, begin = np.unique(bucket, return_index=True)
        return Groups(order, starts, key[starts], least, owner, buckets, np.r_[begin, len(starts)])


@dataclass
class Groups:
    """Windows in the order of their keys; groups of equal keys, with the smallest doc_id of each; and which groups each
    bucket has."""

    windows: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    least: np.ndarray
    owner: np.ndarray
    buckets: np.ndarray
    begin: np.ndarray


def _by_planes(ids: np.ndarray) -> bytes:
    """Ids with all first bytes, then all second bytes and so on, as high bytes repeat and compress to nothing."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _emit(bits: int, window: int):
    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        g, out, block = Block(rows, window).groups(bits), [], int(rows["block"].iloc[0])
        rest = g.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        for b, s, e in zip(g.buckets.tolist(), g.begin[:-1].tolist(), g.begin[1:].tolist()):
            out.append((b, block, _by_planes(g.least[s:e]), rest[s:e].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "ids", "hashes"])

    return of_block


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block, the bits of one bucket's hashes that another block has under a smaller doc_id."""
    sizes = [len(h) // 7 for h in rows["hashes"]]
    raw = np.frombuffer(b"".join(rows["hashes"]), np.uint8).reshape(-1, 7)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :7] = raw
    hashes = whole.view("<u8").ravel()
    doc = np.concatenate([_from_planes(x) for x in rows["ids"]])
    order = np.argsort(hashes)
    ordered, owner = hashes[order], doc[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    least = np.minimum.reduceat(owner, np.flatnonzero(first))
    marked = np.empty(len(hashes), bool)
    marked[order] = owner > least[np.cumsum(first) - 1]
    out, at = [], 0
    for block, n in zip(rows["block"], sizes):
        bits = marked[at : at + n]
        at += n
        if bits.any():
            out.append((block, rows["bucket"].iloc[0], np.packbits(bits).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "bits"])


def _cut(bits: int, window: int):
    def of_block(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(rows, window), []
        marked = np.zeros(len(block.hashes), bool)
        g = block.groups(bits)
        elsewhere = np.zeros(len(g.starts), bool)
        for b, packed in zip(marks["bucket"], marks["bits"]):
            k = int(np.searchsorted(g.buckets, b))
            s, e = g.begin[k], g.begin[k + 1]
            elsewhere[s:e] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(e - s)).astype(bool)
        sizes = np.diff(np.r_[g.starts, len(g.windows)])
        marked[g.windows] = (g.owner > np.repeat(g.least, sizes)) | np.repeat(elsewhere, sizes)
        last = np.cumsum(block.counts)
        for doc_id, words, a, z in zip(block.ids, block.words, (last - block.counts).tolist(), last.tolist()):
            spans: list[dict[str, int]] = []
            for s in np.flatnonzero(marked[a:z]).tolist():
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = s + window
                else:
                    spans.append({"start": s, "end": s + window})
            kept, at = [], 0
            for x in spans:
                kept += words[at : x["start"]]
                at = x["end"]
            kept += words[at:] if spans else words
            out.append((str(doc_id), len(words), spans, b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "removed", "kept_text"])

    return of_block


def dedup_substrings(docs: DataFrame, window: int = WINDOW, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """(doc_id, n_words, removed, kept_text): removal intervals in words, ends exclusive, and the words left."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # The ids travel as text, so that pandas does not turn long ids with nulls into floats.
    rows = every.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("string"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // docs_per_block))
    bits = max(LEAST_BUCKET_BITS, ((size["bytes"] or 0) // BYTES_PER_BUCKET).bit_length())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // BYTES_PER_TASK))
    dealt = rows.withColumn("content", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", "content"), F.lit(blocks)))
    dealt = dealt.select("block", "doc_id", "content", "text").repartition(tasks, "block")
    sent = dealt.groupBy("block").applyInPandas(_emit(bits, window), "bucket long, block long, ids binary, hashes binary")
    marks = sent.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_mark, "block long, bucket long, bits binary")
    cut = (
        dealt.groupBy("block")
        .cogroup(marks.repartition(tasks, "block").groupBy("block"))
        .applyInPandas(_cut(bits, window), "doc_id string, n_words long, removed array<struct<start:long,end:long>>, kept_text string")
    )
    words = words_of(F.col("text"))
    nameless = every.where("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.array_join(words, " ").alias("kept_text")
    )
    return cut.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(nameless)
