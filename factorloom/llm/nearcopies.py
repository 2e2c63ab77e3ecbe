"""Near copies by exact Jaccard similarity of word shingles, found by prefixes that no similar pair can avoid.

Two texts are near copies where their sets of five-word shingles (ASCII lower case, any white space between words) have a
Jaccard similarity of at least 4/5; groups are what links reach. Candidates come from SimHash first: fingerprints of the
sets, searched with BK-trees over shards (``simhash.py``), and whole sets are compared with one of their component. That
alone would lose links: pairs at this similarity differ in 5 to 10 of 64 bits, and blocks for such a radius hold a large
share of all fingerprints. Prefix lists find all others, and one exact check judges the candidates of both.

For the lists every shingle gets a place in one order, common ones last. Of two sets of at least that similarity the first
``n - ceil(4n/5) + 1`` shingles of each share one, whatever the order is, so no link is lost; the order only keeps
the lists short. It comes from counts of shingles by the first 16 bits of their hash, a table of fixed size. Lists are
read in two steps. First every member of a list is compared with the member whose list shingle stands foremost; what
that links is one group, and a list with one group is settled. In the others all pairs between groups are compared.
Pairs are met only at places so early in both sets that the overlap which their sizes ask for still fits behind them; then
whole sets are compared. Shingles are compared by 64-bit hashes.

Nulls: a null text counts as empty; texts without words are one group. Shorter texts than five words are one shingle.
A row without a ``doc_id`` takes part like any other and is chosen last. Equal sets are one node. Rows are told apart by id
and a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .simhash import SEED, components, fingerprint_of, links, shards, shingle_hashes

WIDTH = 5
SLOT_BITS = 16
#: Hash slots that tell which rows may be wanted or gone: eight for each row named, within these powers of two.
FEWEST_SLOTS, MOST_SLOTS = 20, 23
#: Possible pairs of a list for each of its members beyond which its shingle is hot.
LONGEST = 2_000
#: Hot shingles that are put last in one round, at 8 bytes each, and rounds. What is left after them is joined as it is.
MOST_HOT, ROUNDS = 1 << 20, 4
NODE = "node long, n int, print long, counts binary, outline binary"
#: Texts whose sets a worker keeps at once.
TEXTS = 500
#: Buckets of an outline, by the first bits of a hash.
OUTLINE_BITS = 8


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, WIDTH))


def _node(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED), np.uint64).view(np.int64))


def outline(hashes: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bucket; nothing for a set too large for counts of two bytes."""
    counts = np.bincount((hashes >> np.uint64(64 - OUTLINE_BITS)).astype(np.int64), minlength=1 << OUTLINE_BITS)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""


def _text() -> Column:
    return text_or_empty(F.col("text").cast("string"))


def _content() -> Column:
    return F.xxhash64(_text()).alias("content")


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, content, node, n, print, counts, outline): what names a row, the hash of its shingle set, the set's size, fingerprint
    and outline, without its text.

    The first row of each batch of texts also carries how many shingles of the batch fall into each slot.
    """

    bits = SLOT_BITS

    @F.pandas_udf(NODE)
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        # One set at a time: those of a whole batch took some 60 MB of a worker.
        counts, rows = np.zeros(1 << bits, np.int64), []
        for text in texts:
            s = shingle_set(text)
            # A set has a shingle once, but several may fall into a slot.
            slots, more = np.unique((s >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            counts[slots] += more
            rows.append((_node(s), len(s), np.array(fingerprint_of(s), np.uint64).view(np.int64), None, outline(s)))
        out = pd.DataFrame(rows, columns=["node", "n", "print", "counts", "outline"]).astype({"node": np.int64, "n": np.int32, "print": np.int64, "counts": object})
        if rows:
            used = np.flatnonzero(counts)
            out.at[0, "counts"] = used.astype("<u4").tobytes() + counts[used].astype("<u4").tobytes()
        return out

    rows = docs.select("doc_id", _content(), of_texts(_text()).alias("x"))
    return stored(rows.select("doc_id", "content", "x.node", "x.n", "x.print", "x.counts", "x.outline"), "near-rows")


def slot_ranks(rows: DataFrame) -> np.ndarray:
    """The place of each slot of shingle hashes in the order of how many shingles it has, rarest first."""

    bits = SLOT_BITS

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for raw in batch["counts"]:
                slots, more = np.frombuffer(raw, "<u4").reshape(2, -1)
                counts[slots] += more
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": used, "count": counts[used]})

    # At most 2**16 rows, whatever the number of documents is.
    found = rows.where("counts is not null").select("counts").mapInPandas(of_batches, "slot long, count long").groupBy("slot").agg(F.sum("count").alias("count")).collect()
    counts = np.zeros(1 << bits, np.int64)
    for r in found:
        counts[r["slot"]] = r["count"]
    ranks = np.empty(1 << bits, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << bits, dtype=np.uint64)
    return ranks


NO_TOKENS = np.empty(0, np.int64)


def prefix(hashes: np.ndarray, ranks: np.ndarray, hot: np.ndarray = NO_TOKENS) -> np.ndarray:
    """The first shingles of a set, as signed longs: in the order of their slots' ranks, those of ``hot`` (sorted) after all others."""
    below = 64 - (len(ranks).bit_length() - 1)
    low = np.uint64(below)
    placed = (ranks[(hashes >> low).astype(np.int64)] << low) | (hashes & np.uint64((1 << below) - 1))
    placed = (np.sort(placed) ^ np.uint64(1 << 63)).view(np.int64)
    if len(hot):
        last = np.isin(placed, hot)
        placed = np.concatenate([placed[~last], placed[last]])
    return placed[: len(hashes) - (4 * len(hashes) + 4) // 5 + 1] if len(hashes) else placed


def postings(texts: DataFrame, ranks: np.ndarray, hot: np.ndarray = NO_TOKENS) -> DataFrame:
    """(token, node, n, place, head, m): the prefix shingles of every node of ``texts`` (text) whose shingle another node's prefix has.

    ``place`` is that of the shingle in its set, from 0. ``head`` is the node in which the list's shingle stands foremost,
    ``m`` the size of its set. A task sends a node once, however
    many copies it reads, and lists are dealt by their shingle once for all that is asked of them.
    """

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        for batch in batches:
            # A few hundred texts at a time, as long ones give thousands of rows each.
            for lo in range(0, len(batch), TEXTS):
                sets = {}
                for text in batch["text"].iloc[lo : lo + TEXTS]:
                    hashes = shingle_set(text)
                    if (node := _node(hashes)) not in known:
                        known.add(node)
                        sets[node] = hashes
                if not sets:
                    continue
                found = [prefix(x, ranks, hot) for x in sets.values()]
                size = np.array([len(x) for x in found], np.int32)
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(found),
                        "node": np.repeat(np.fromiter(sets, np.int64, len(sets)), size),
                        "n": np.repeat(np.array([len(x) for x in sets.values()], np.int32), size),
                        "place": np.concatenate([np.arange(len(x), dtype=np.int32) for x in found]),
                    }
                )

    every = texts.mapInPandas(of_batches, "token long, node long, n int, place int")
    once = every.repartition("token").groupBy("token", "node").agg(*[F.first(c).alias(c) for c in ("n", "place")])
    of_token = Window.partitionBy("token")
    lists = once.withColumn("nodes", F.count("*").over(of_token)).withColumn("head", F.min(F.struct("place", "node", "n")).over(of_token)).where("nodes > 1")
    return stored(lists.select("token", "node", "n", "place", F.col("head.node").alias("head"), F.col("head.n").alias("m")), "near-lists")


def _slots_of(names: DataFrame) -> tuple[DataFrame, Column]:
    """The hash slots of rows named (doc_id, content), and the slot of a row. Slots are as many as the names ask for, but no more
    than can be broadcast whatever the number of rows is."""
    bits = min(max((8 * names.count()).bit_length(), FEWEST_SLOTS), MOST_SLOTS)
    slot = F.pmod(F.xxhash64("doc_id", "content"), F.lit(1 << bits)).cast("int").alias("slot")
    return F.broadcast(stored(names.select(slot).distinct(), "near-slots")), slot


def _same(names: DataFrame) -> Column:
    return F.col("doc_id").eqNullSafe(names["name_id"]) & (F.col("content") == names["name_content"])


def _names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "name_id", "content": "name_content"})


def texts_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) for the nodes of ``nodes``: one row stands for each, and its text is fetched by the row's name. Texts that share
    no slot with a wanted one are not shuffled."""
    named = rows.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("name")).join(nodes, "node")
    named = stored(named.select("node", "name.doc_id", "name.content"), "near-wanted")
    slots, slot = _slots_of(named)
    likely = docs.select("doc_id", _content(), _text().alias("text")).withColumn("slot", slot).join(slots, "slot", "left_semi")
    to = _names(named).hint("merge")
    return likely.join(to, _same(to)).groupBy("node").agg(F.first("text").alias("text"))


def likely_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` without those that can't be similar: two sets share no more than the smaller count of each bucket of their outlines.

    Most pairs of unlike texts with a common passage end here, at 512 bytes a set, before their texts are fetched."""

    @F.pandas_udf("boolean")
    def may_be(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if not len(x) or not len(y):
                out.append(True)
                continue
            x, y = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
            out.append(9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum()))
        return pd.Series(out, dtype=bool)

    outlines = rows.groupBy("node").agg(F.first("outline").alias("outline"))
    left = pairs.join(outlines.select(F.col("node").alias("a"), F.col("outline").alias("x")).hint("merge"), "a")
    both = left.join(outlines.select(F.col("node").alias("b"), F.col("outline").alias("y")).hint("merge"), "b")
    return stored(both.where(may_be("x", "y")).select("a", "b"), "near-likely")


def similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have a similarity of at least 4/5."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.iloc[lo : lo + TEXTS]
                yield pd.DataFrame({"node": part["node"], "hashes": [shingle_set(t).astype("<u8").tobytes() for t in part["text"]]})

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(9 * both >= 4 * (len(x) + len(y)))
        return pd.Series(out, dtype=bool)

    pairs = likely_pairs(pairs, rows)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(texts_of(wanted, rows, docs).select("node", "text").mapInPandas(sets_of, "node long, hashes binary"), "near-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    return stored(both.where(near("x", "y")).select("a", "b"), "near-links")


def _sizes_fit(n: str, m: str) -> Column:
    return (F.col(n) * 5 >= F.col(m) * 4) & (F.col(m) * 5 >= F.col(n) * 4)


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each node with the smallest one whose fingerprint is within reach of its own by steps of two bits or fewer, where their
    sizes fit."""
    nodes = stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("print").alias("fp")), "near-prints")
    tied = components(links(shards(nodes.select(F.col("fp").alias("rep"), "fp").distinct()))).withColumnRenamed("node", "fp")
    named = stored(nodes.join(tied.hint("merge"), "fp", "left").select("node", "n", F.coalesce("component", "fp").alias("component")), "near-named")
    heads = named.groupBy("component").agg(F.min(F.struct("node", "n")).alias("head")).select("component", F.col("head.node").alias("head"), F.col("head.n").alias("m"))
    met = named.join(heads.hint("merge"), "component").where((F.col("node") != F.col("head")) & _sizes_fit("n", "m"))
    return met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))


def first_links(lists: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between the nodes that fingerprints bring together, and between the members of each list and the one in which
    the list's shingle stands foremost."""
    met = lists.where((F.col("node") != F.col("head")) & _sizes_fit("n", "m"))
    pairs = met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
    return similar(stored(pairs.unionByName(simhash_pairs(rows)).distinct(), "near-pairs"), rows, docs)


def other_links(lists: DataFrame, tied: DataFrame, rows: DataFrame, docs: DataFrame, ranks: np.ndarray, hot: np.ndarray = NO_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links between different groups of ``tied`` (node, component) that share a list."""
    grouped = lists.join(tied.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = stored(grouped, "near-grouped")
    sizes = grouped.groupBy("token", "component").agg(F.count("*").alias("members"), F.count_if(F.col("place") * 9 <= F.col("n")).alias("early"))
    sums = [F.sum(c).alias(c) for c in ("members", "early")]
    largest = sizes.groupBy("token").agg(F.max(F.struct("members", "component", "early")).alias("x"), F.count("*").alias("groups"), *sums).where("groups > 1")
    # Sets that share enough stand, both together, in the first ninths of their sizes; so one of them does by itself.
    most = (F.col("early") - F.col("x.early")) * F.col("members") + (F.col("members") - F.col("x.members")) * F.col("early")
    largest = stored(largest.select("token", F.col("x.component").alias("largest"), (most / F.col("members")).alias("pairs")), "near-largest")
    now, again = largest, None
    if rounds:
        # 8 bytes a token, and no more tokens than there are postings over LONGEST; those left out are joined as they are.
        found = largest.where(F.col("pairs") > LONGEST).orderBy(F.desc("pairs"), "token").limit(MOST_HOT).select("token").toPandas()["token"].to_numpy(np.int64)
        new = np.setdiff1d(found, hot)
        if len(new):
            marked = grouped.sparkSession.createDataFrame(pd.DataFrame({"token": new}), "token long")
            now = largest.join(F.broadcast(marked), "token", "left_anti")
            nodes = grouped.join(F.broadcast(marked), "token", "left_semi").select("node").distinct()
            hot = np.union1d(hot, new)
            texts = stored(texts_of(nodes, rows, docs).select("text"), "near-texts")
            again = other_links(postings(texts, ranks, hot), tied, rows, docs, ranks, hot, rounds - 1)
    members = stored(grouped.join(now.select("token", "largest").hint("merge"), "token"), "near-members")
    columns = ("node", "n", "place", "component")
    a = members.where("component != largest").select("token", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = members.select("token", (F.col("component") == F.col("largest")).alias("b_main"), *[F.col(c).alias(f"b_{c}") for c in columns])
    # So many shingles similar sets of these sizes must share. Of two sets that share as many, one shared shingle stands
    # in each before only fewer are left; so the pair is met in that list if in no other.
    due = F.expr("(4 * (a_n + b_n) + 8) div 9")
    foremost = (F.col("a_place") + due <= F.col("a_n")) & (F.col("b_place") + due <= F.col("b_n"))
    apart = (F.col("a_component") != F.col("b_component")) & (F.col("b_main") | (F.col("a_node") < F.col("b_node")))
    met = a.join(b.hint("merge"), "token").where(apart & _sizes_fit("a_n", "b_n") & foremost)
    pairs = met.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    links = similar(stored(pairs.distinct(), "near-pairs"), rows, docs)
    return links if again is None else links.unionByName(again)


def near_copies(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``rows`` (``docs`` as ``tagged``) that are linked to others."""
    ranks = slot_ranks(rows)
    lists = postings(docs.select(_text().alias("text")), ranks)
    first = first_links(lists, rows, docs)
    other = other_links(lists, components(first), rows, docs, ranks)
    return components(first.unionByName(other))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest (doc_id, hash of the text); null ids come last, and of
    rows with one id and one text the one stays whose other columns have the smallest hash. ``docs`` is read several times."""
    rows = tagged(docs)
    tied = near_copies(rows, docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    best = stored(rows.groupBy("node").agg(F.min(order).alias("best")), "near-best")
    named = best.join(tied.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    kept = _names(stored(named.select("best.doc_id", "best.content"), "near-kept")).hint("merge")
    # The rows that stay grow with the documents, so they are never broadcast. Rows that share no slot with one that goes,
    # or that is there more than once, stay where they are; only the others are shuffled to be told apart.
    there = rows.groupBy("doc_id", "content").agg(F.count("*").alias("times"))
    unsure = there.join(kept, _same(kept), "left").where("name_content is null or times > 1")
    slots, slot = _slots_of(unsure.select("doc_id", "content"))
    every = docs.select(F.struct("*").alias("row"), "doc_id", _content()).withColumn("slot", slot)
    stay = every.join(slots, "slot", "left_anti").select("row")
    told = every.join(slots, "slot", "left_semi").join(kept, _same(kept), "left_semi").groupBy("doc_id", "content").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return stay.unionByName(told).select(*[F.col("row")[c].alias(c) for c in docs.columns])
