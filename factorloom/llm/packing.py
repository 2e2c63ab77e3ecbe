"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents are tokenised where they are read and cut into pieces of at most ``CAPACITY`` tokens. Only (key, length) of
the pieces is dealt to packing partitions. Each partition packs best-fit decreasing and computes lower bounds for its
bin count from dual feasible functions; a partition whose count meets its bound is certified and is left alone. The
pieces of the unfilled bins of the other partitions are exchanged, dealt anew to fewer partitions, and packed again,
for as long as that saves bins. Full bins stay as they are. Every row carries the bin count and the bound of the
partition that packed it last, so that a certificate (``certificates``) can be read from the result.

Nulls: a null text counts as empty, that is one piece with the end mark alone. Rows are packed one by one, repeated
ones and those with a null ``doc_id`` included (a row is known by its id, text and number among its equals). Ties are
broken by key. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

CAPACITY = 1024
END_ID = 2
#: Pieces that one packing task should get.
PIECES_PER_TASK = 50_000
ROUNDS = 3
#: Entries of a worker's cache of encoded chunks; it starts anew beyond that.
CACHE = 200_000


#: White space as the vocabulary's pattern has it; texts with a character of ODD are not cut, as libraries differ over those.
SPACE = " \t\n\v\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
#: Characters over whose classes both libraries agree (the tests go through all of them), and the added token.
COMMON = re.compile("[\x00-\u024f]*").fullmatch
ADDED = "<|endoftext|>"
#: Longer chunks are not kept in the cache.
LONGEST = 64


class Encoder:
    """Byte-level BPE ids of the named tokenizer as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never matches white space after another character, so the tokenizer cuts a text before
    every run of white space in any case. The text is cut there, and chunks, a run of white space with what follows up
    to the next, are encoded and looked up from then on. The added token has no white space in it. New chunks of common
    characters go to a faster library with the same vocabulary and pattern, all others to the tokenizer itself; the tests
    hold both against the tokenizer called as it is.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        # Every core has a task of its own already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
        self.chunks: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> dict[str, bytes]:
        out, other = {}, []
        for text in texts:
            if COMMON(text) and ADDED not in text:
                ids = self.plain(text)
                out[text] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                other.append(text)
        if other:
            out |= zip(other, (np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(other, add_special_tokens=False)))
        return out

    def __call__(self, text: str) -> bytes:
        if ODD(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, known = CHUNKS(text), self.chunks
        out = [known.get(c) for c in chunks]
        if None in out:
            found = self._encode(list({c for c, ids in zip(chunks, out) if ids is None}))
            out = [found[c] if ids is None else ids for c, ids in zip(chunks, out)]
            if len(known) + len(found) > CACHE:
                known.clear()
            known.update((c, ids) for c, ids in found.items() if len(c) <= LONGEST)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, ranks: str) -> Encoder:
    """A worker's encoder, kept for its next tasks."""
    return Encoder(vocabulary, ranks)


def vocabulary_paths() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, content, piece, start, length, ids_crc32, narrow): pieces, the checksum of their ids as little-endian 32-bit
    bytes, and, if wanted, the ids themselves, as 16-bit ones where all of them fit.

    Only documents longer than ``capacity`` are cut; the first piece takes the remainder. ``vocabulary``: the paths of the
    two files, by default the installed ones of each executor.
    """

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(*(vocabulary or vocabulary_paths())), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, content, text in zip(batch["doc_id"], batch["content"], batch["text"]):
                ids = encoder(text) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                start, stop, k = 0, min(first, total), 0
                while start < total:
                    own = ids[4 * start : 4 * stop]
                    rows.append((doc_id, content, k, start, stop - start, zlib.crc32(own), _narrow(own) if with_ids else None))
                    start, stop, k = stop, stop + capacity, k + 1
            yield pd.DataFrame(rows, columns=["doc_id", "content", "piece", "start", "length", "ids_crc32", "narrow"])

    body = text_or_empty(F.col("text").cast("string"))
    # doc_id travels as text, so that pandas does not turn long ids with nulls into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(body).alias("content"), body.alias("text"))
    cut = rows.mapInPandas(of_batches, "doc_id string, content long, piece int, start long, length long, ids_crc32 long, narrow binary")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


def _narrow(ids: bytes) -> bytes:
    """Ids of 16 bits each if they fit, as they are stored and shuffled; else as they are."""
    found = np.frombuffer(ids, "<u4")
    return found.astype("<u2").tobytes() if found.max(initial=0) < 1 << 16 else ids


def _widened(narrow: pd.Series, length: pd.Series) -> pd.Series:
    """Ids of 32 bits each."""
    return pd.Series([x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(narrow, length)], dtype=object)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each length. Bins with equal room are used last opened first."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, opened = 0, 0  # bit r of open_rooms: some bin has exactly r tokens of room
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fits = open_rooms >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            b, room, opened = opened, capacity, opened + 1
        bins[k], room = b, room - need
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual feasible functions give for the number of bins.

    Two families: the rounding functions u_k, and the functions that count pieces over capacity - t as a whole bin and
    leave out pieces under t.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    total, mass = np.cumsum(counts), np.cumsum(counts * size)
    for t in range(1, capacity // 2 + 1):
        whole = total[capacity] - total[capacity - t]
        rest = mass[capacity - t] - mass[t - 1]
        best = max(best, int(whole) - (-int(rest) // capacity))
    return best


def _pack_partition(capacity: int):
    def of_partition(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "content", "piece", "key"], ascending=[False, True, True, True, True], na_position="first")
        lengths = rows["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        load = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        rows, bins, lengths = rows.iloc[order], bins[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.r_[True, bins[1:] != bins[:-1]]
        offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
        return rows.assign(bin=bins, offset=offset, room=capacity - load[bins], bins=len(load), bound=bound)

    return of_partition


PACKED = "doc_id string, content long, piece int, key long, length long, part long, bin long, offset long, room long, bins long, bound long"


def _packed(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    # By key, as equal rows of one id may be a third of all.
    part = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts))
    dealt = rows.select("doc_id", "content", "piece", "key", "length", part.alias("part"))
    return stored(dealt.groupBy("part").applyInPandas(_pack_partition(capacity), PACKED), "packing-round")


def pack(lengths: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """(key, sequence_id, offset, part_bins, part_bound) for rows (doc_id, content, piece, key, length) with unique keys.

    A sequence is named by the round in which it was settled, its partition and its bin; its offsets have no gaps.
    ``part_bins`` and ``part_bound`` are the bin count of the partition that packed the row last and the least count that
    its pieces need.
    """
    rows = lengths.select(F.col("doc_id").cast("string").alias("doc_id"), "content", "piece", "key", "length")
    now, settled = _packed(rows, max(1, -(-rows.count() // per_task)), 0, capacity), None
    turn = 0
    while turn < rounds:
        unsure = now.where("bins > bound and room > 0")
        size = unsure.agg(F.count("*").alias("n"), F.count_distinct("part", "bin").alias("bins"), F.count_distinct("part").alias("parts")).first()
        if size["parts"] < 2:
            break
        again = _packed(unsure, max(1, -(-size["n"] // per_task)), turn + 1, capacity)
        if again.select("part", "bin").distinct().count() >= size["bins"]:
            break
        done = now.where("bins = bound or room = 0").withColumn("turn", F.lit(turn))
        settled = done if settled is None else settled.unionByName(done)
        now, turn = again, turn + 1
    last = now.withColumn("turn", F.lit(turn))
    everything = last if settled is None else settled.unionByName(last)
    sequence = F.col("turn") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 30) + F.col("bin")
    return everything.select("key", sequence.alias("sequence_id"), "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))


def certificates(packed: DataFrame) -> DataFrame:
    """(turn, part, sequences, part_bins, part_bound): for each packing of a partition how many of its bins stayed, how
    many it made and how many its pieces need. Where ``part_bins = part_bound`` the count is certified as the least."""
    turn = F.floor(F.col("sequence_id") / F.lit(1 << 58)).cast("int")
    part = F.shiftright(F.col("sequence_id") - turn.cast("long") * F.lit(1 << 58), 30)
    rows = packed.select(turn.alias("turn"), part.alias("part"), "sequence_id", "part_bins", "part_bound").distinct()
    return rows.groupBy("turn", "part", "part_bins", "part_bound").agg(F.count("*").alias("sequences")).select("turn", "part", "sequences", "part_bins", "part_bound")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each document: (doc_id, piece, start, length, [ids,] ids_crc32, sequence_id, offset,
    part_bins, part_bound)."""
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = ["narrow"] if with_ids else []
    # The key tells equal rows apart; it is fixed once the table is written.
    cut = pieces(docs, capacity, vocabulary, with_ids).select(*out, *held, "content", F.monotonically_increasing_id().alias("key"))
    cut = stored(cut, "packing-pieces")
    placed = pack(cut.select("doc_id", "content", "piece", "key", "length"), capacity)
    ids = [F.pandas_udf(_widened, "binary")("narrow", "length").alias("ids")] if with_ids else []
    return cut.join(placed, "key").select(*out[:4], *ids, "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound")
