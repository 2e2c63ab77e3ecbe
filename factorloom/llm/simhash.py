"""SimHash near-duplicates, searched with BK-trees over shards of the fingerprints.

A BK-tree keeps under every node at most one child for each integer Hamming distance; a search of radius r follows,
from a node at distance d, only the edges d-r to d+r. One tree over all fingerprints would be neither small nor
parallel, so the fingerprints are dealt to shards first: two fingerprints that differ in at most 2 bits agree on at
least one of three blocks of bits, so every block value is a shard, and no link is lost. A shard with more than
``MAX_TREE`` fingerprints is dealt again by three blocks of the bits that are still free; after four such rounds
at most 14 bits are free, so that no tree has more than 2**14 nodes, whatever the texts are. The trees of a shard
meet the shard's queries in the shard's own task (a shuffle), not through the driver, because the fingerprints of all
documents grow with the corpus. Each shard hands on a spanning forest of its links, never all pairs.

Nulls and empty texts have fingerprint zero and are linked like any other. Exact copies share a fingerprint and cost
one tree node; nodes are named by their fingerprint, so a row with a null ``doc_id`` carries links like any other and only
can't name its component, which is null where no member has an id. One id with several texts is several nodes. Repeated
rows stay repeated. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

RADIUS = 2
MAX_TREE = 2048
ROUNDS = 4
#: Rows that one task of the tree stage should get: whole shards, several at a time.
ROWS_PER_TASK = 20_000
QUERIES_AT_ONCE = 2_048
SEED = 42
WIDTH = 3


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles of ``width`` words in order, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops[last:])), np.uint64, n)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included."""
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        part = hashes[lo : lo + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each document, the fingerprint as a signed long."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps})

    # The id travels as text, so that pandas does not turn long ids with nulls into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    return rows.mapInPandas(of_batches, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _children(mask: int) -> list[int]:
    """The three masks that add one third of the free bits each to ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * k / 3) for k in range(4)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(nodes: DataFrame, max_tree: int = MAX_TREE, rounds: int = ROUNDS) -> DataFrame:
    """(mask, key, rep, fp): every fingerprint in each shard that it shares with another.

    ``nodes`` has (rep, fp) with distinct fp. ``mask`` tells which bits all members agree on.
    """
    spark = nodes.sparkSession
    masks, open_rows, closed = [0], nodes.select(F.lit(0).cast("long").alias("mask"), "rep", "fp"), None
    for k in range(rounds):
        deal = [(_signed(m), _signed(c)) for m in masks for c in _children(m)]
        masks = [c for m in masks for c in _children(m)]
        # A fixed table of 3, 9, 27 or 81 rows.
        table = F.broadcast(spark.createDataFrame(deal, "mask long, child long"))
        dealt = (
            open_rows.join(table, "mask")
            .select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("key"), "rep", "fp")
        )
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("members")).where("members > 1")
        if k + 1 < rounds:
            sizes = sizes.withColumn("large", F.col("members") > max_tree)
        else:
            sizes = sizes.withColumn("large", F.lit(False))
        # Sizes are a table, so that a shard of a third of all fingerprints can be split in the join.
        found = stored(dealt.join(stored(sizes, "simhash-sizes"), ["mask", "key"]).select("mask", "key", "rep", "fp", "large"), "simhash-shards")
        small = found.where("not large").drop("large")
        closed = small if closed is None else closed.unionByName(small)
        if k + 1 == rounds or found.where("large").isEmpty():
            break
        open_rows = found.where("large").select("mask", "rep", "fp")
    return closed


class BkForest:
    """One BK-tree for each shard of a sorted table, built and searched a level at a time for all of them."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = first[np.cumsum(np.r_[False, shard[1:] != shard[:-1]])]
        edges: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        item = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[item]
        while len(item):
            edge = at * 65 + np.bitwise_count(fp[item] ^ fp[at]).astype(np.int64)
            order = np.argsort(edge, kind="stable")
            edge, item = edge[order], item[order]
            is_child = np.r_[True, edge[1:] != edge[:-1]]
            child = item[is_child]
            edges.append(edge[is_child])
            ends.append(child)
            below = child[np.cumsum(is_child) - 1]
            item, at = item[~is_child], below[~is_child]
        self.edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        order = np.argsort(self.edge)
        self.edge, self.end = self.edge[order], self.end[order]

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (query, node) within the radius in the query's own tree, some at a time."""
        at = self.root[query]
        while len(query):
            d = np.bitwise_count(self.fp[query] ^ self.fp[at]).astype(np.int64)
            hit = d <= radius
            yield query[hit], at[hit]
            if not len(self.edge):
                return
            wanted = (at * 65 + d)[:, None] + np.arange(-radius, radius + 1)
            wanted[(wanted // 65) != at[:, None]] = -1
            place = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
            there = self.edge[place] == wanted
            query, at = np.repeat(query, there.sum(1)), self.end[place[there]]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hooks the roots of linked positions to the smaller one until all pairs agree; returns flat parents."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_pairs = ra != rb
        a, b, ra, rb = a[open_pairs], b[open_pairs], ra[open_pairs], rb[open_pairs]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def links(sharded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, by representative, of the links inside every shard."""

    def of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mask", "key", "rep"])
        mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
        shard = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        forest, parent = BkForest(shard, fp), np.arange(len(fp))
        for lo in range(0, len(fp), QUERIES_AT_ONCE):
            for a, b in forest.search(np.arange(lo, min(lo + QUERIES_AT_ONCE, len(fp))), radius):
                parent = _union(parent, a, b)
        tied = np.flatnonzero(parent != np.arange(len(fp)))
        return pd.DataFrame({"a": rep[tied], "b": rep[parent[tied]]})

    buckets = max(1, -(-sharded.count() // ROWS_PER_TASK))
    dealt = sharded.withColumn("bucket", F.pmod(F.xxhash64("mask", "key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(of_bucket, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches, by star contraction.

    Every round joins each node's larger neighbours, then its smaller ones, to the smallest it knows. The edges never
    grow, and the number of rounds grows with the logarithm of the longest chain.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # As tables, so that the joins can split a node with very many neighbours.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "cc-large")
        small_least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = stored(small, "cc")
        # Done when no node has two parents and no parent has a parent.
        loose = after.groupBy("u").count().where("count > 1").select("u").unionByName(
            after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v").select(F.col("v").alias("u"))
        )
        if loose.isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = after


def near_duplicates(docs: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(doc_id, fp, component_id) for every document; ``component_id`` is the smallest doc_id that links reach."""
    if radius > 2:
        raise ValueError("three blocks find radius 2 at most")
    prints = stored(fingerprints(docs), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    tied = stored(components(links(shards(nodes.select(F.col("fp").alias("rep"), "fp"), max_tree), radius)), "simhash-tied")
    ids = tied.join(nodes, tied["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("known"))
    ids = stored(ids, "simhash-least")
    # The smallest member has its own fingerprint as component, so it is not in ``tied``.
    roots = ids.join(nodes, ids["component"] == nodes["fp"]).select("component", F.least("known", "least").alias("known"))
    groups = tied.join(roots, "component").select(F.col("node").alias("fp"), "known").unionByName(roots.select(F.col("component").alias("fp"), "known"))
    # Tables of their own, so that the joins have plain exchanges on both sides, and a component or a fingerprint that a
    # third of all documents share can be split.
    groups = stored(groups, "simhash-groups")
    named = stored(nodes.join(groups, "fp", "left").select("fp", F.coalesce("known", "least").alias("component_id")), "simhash-named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
