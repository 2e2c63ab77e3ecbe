"""Benchmark decontamination over a distributed positional inverted index.

The index stores postings (term, document, position) of the training tokens whose term occurs in the benchmark; it is
written by the tasks that read the documents, so its segments hold whole documents and no term, however frequent,
gathers in one place. Term frequencies come from the index. For every window of ``WINDOW`` item words the two rarest
terms are looked up; subtracting the place in the item from the place in the document gives the alignment of item and
document, and only alignments that both lists share go on. Those are compared word for word. The same lists give the
proximity matches: both terms of a window near each other, in either order, whatever stands between them.

Only texts that have an alignment are shuffled to be compared. Which these are is told by ``SLOTS`` hash slots, a table of
that many rows at most, so it can be broadcast for a corpus of any size; slots that others share cost a shuffle, no more.
The benchmark side is broadcast only up to ``BROADCAST_ROWS`` rows and is shuffled beyond that.

Nulls: a null text has no words; such a document is clean, such an item matches nothing. Empty texts likewise. A null
``doc_id`` is judged like any other; a null ``item_id`` is left out of item lists but its words count as hits. Documents
are keyed by id and text, so repeated rows get equal answers and one id with two texts two separate answers.
Repeated items count once in item lists. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, text_or_empty

WINDOW = 10
#: Items, places and terms of the benchmark are broadcast up to this many rows (each under 200 bytes).
BROADCAST_ROWS = 200_000
#: Hash slots that tell which documents have an alignment.
SLOTS = 1 << 20
#: Words that may come between the terms of a proximity match beside those between them in the item.
SLOP = 5
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, content, words): ``content`` tells apart texts under one id."""
    body = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("content"), terms_of(body).alias("words"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): distinct word sequences by item_id."""
    words = terms_of(text_or_empty("text"))
    found = benchmark.select("item_id", words.alias("words")).where(F.size("words") > 0).distinct()
    return stored(found.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words"), "decontam-items")


def build_index(docs: DataFrame, vocabulary: DataFrame, vocabulary_rows: int) -> DataFrame:
    """Postings (term, doc_id, content, place) of the terms in ``vocabulary`` (word, term), as a stored table."""
    tokens = keyed(docs).select("doc_id", "content", F.posexplode("words").alias("place", "word"))
    return stored(
        tokens.join(bounded(vocabulary, vocabulary_rows), "word").select("term", "doc_id", "content", "place"), "decontam-postings"
    )


def rarest_pairs(items: DataFrame, vocabulary: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """(item, first, second): the places and terms of the two rarest terms of every window of every item, in the order of
    their places. In items of one word, for which one list decides, ``second`` is null."""
    places = (
        items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
        .join(vocabulary, "word")
        .join(frequencies, "term", "left")
        .select("item", "n", "place", "term", F.coalesce("frequency", F.lit(0)).alias("frequency"))
    )
    per_item = places.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("place", "frequency", "term"))).alias("p"))

    def of_window(start: Column) -> Column:
        ranked = F.sort_array(F.transform(F.slice("p", start + 1, window), lambda x: F.struct(x["frequency"], x["place"], x["term"])))
        return F.sort_array(F.transform(F.slice(ranked, 1, 2), lambda x: F.struct(x["place"].alias("place"), x["term"].alias("term"))))

    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    pairs = per_item.select("item", F.explode(F.array_distinct(F.transform(starts, of_window))).alias("x"))
    return pairs.select("item", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@dataclass
class Search:
    """The stored index over the documents, the items of the benchmark, and the pairs of terms to look up."""

    index: DataFrame
    items: DataFrame
    pairs: DataFrame
    window: int


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Search:
    items = item_words(benchmark)
    vocabulary = stored(items.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("term")), "decontam-terms")
    index = build_index(docs, vocabulary, vocabulary.count())
    frequencies = index.groupBy("term").agg(F.count("*").alias("frequency"))
    return Search(index, items, stored(rarest_pairs(items, vocabulary, frequencies, window), "decontam-rare"), window)


def alignments(of: Search) -> DataFrame:
    """(doc_id, content, item, shift): where the rarest terms of some window meet."""
    ends = F.explode(F.filter(F.array("first", "second"), lambda x: x.isNotNull())).alias("x")
    rare = of.pairs.select("item", F.col("second").isNull().alias("lone"), ends)
    rare = stored(rare.select("item", F.col("x.place").alias("item_place"), "x.term", "lone").distinct(), "decontam-places")
    met = (
        of.index.join(bounded(rare, rare.count()), "term")
        .groupBy("doc_id", "content", "item", (F.col("place") - F.col("item_place")).alias("shift"))
        .agg(F.count("*").alias("lists"), F.max("lone").alias("lone"))
        .where("lists >= 2 or lone")
        .select("doc_id", "content", "item", "shift")
    )
    return stored(met, "decontam-candidates")


def _runs(words: Column, item: Column, shift: Column, window: int) -> Column:
    """Starts, in the item, of the windows that occur in ``words`` at ``shift``: those between two unequal words."""
    width = F.least(F.lit(window), F.size(item))
    at = lambda k: k + shift
    unequal = F.transform(
        item, lambda w, k: F.when((at(k) >= 0) & (at(k) < F.size(words)) & F.coalesce(F.get(words, at(k)) == w, F.lit(False)), F.lit(None)).otherwise(k)
    )
    bounds = F.concat(F.array(F.lit(-1)), F.filter(unequal, lambda k: k.isNotNull()), F.array(F.size(item)))

    def between(b: Column) -> Column:
        free = F.transform(b, lambda x, k: F.struct((x + 1).alias("a"), (F.get(b, k + 1) - width).alias("z")))
        return F.flatten(F.transform(F.filter(free, lambda r: r["z"] >= r["a"]), lambda r: F.sequence(r["a"], r["z"])))

    return let(bounds, between)


MATCHES = "array<struct<item_id:bigint,width:int,starts:array<int>>>"


def _slot(doc_id: Column, content: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, content), F.lit(SLOTS)).cast("int")


def _wanted(of: Search) -> tuple[DataFrame, DataFrame]:
    """(wanted, slots). The first is (wanted_id, wanted_content, wanted): for each document with alignments its items and
    the alignments with them. The second has the slots of these documents.

    A document that repeats a passage has many alignments with an item, but the item's words once.
    """
    aligned = alignments(of).groupBy("doc_id", "content", "item").agg(F.collect_list("shift").alias("shifts"))
    wanted = (
        aligned.join(bounded(of.items, of.items.count()), "item")
        .groupBy(F.col("doc_id").alias("wanted_id"), F.col("content").alias("wanted_content"))
        .agg(F.collect_list(F.struct("item_id", F.col("words").alias("item"), "shifts")).alias("wanted"))
    )
    wanted = stored(wanted, "decontam-wanted")
    slots = stored(wanted.select(_slot(F.col("wanted_id"), F.col("wanted_content")).alias("slot")).distinct(), "decontam-slots")
    return wanted, F.broadcast(slots)


def _is_wanted() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("content") == F.col("wanted_content"))


def _found(words: Column, window: int) -> Column:
    """The items of ``wanted`` that occur in ``words``, with the starts of their windows."""
    every = F.transform(
        "wanted",
        lambda c: F.struct(
            c["item_id"].alias("item_id"),
            F.least(F.lit(window), F.size(c["item"])).alias("width"),
            F.array_distinct(
                F.flatten(F.transform(c["shifts"], lambda s: F.transform(_runs(words, c["item"], s, window), lambda k: k + s)))
            ).alias("starts"),
        ),
    )
    return F.filter(every, lambda c: F.size(c["starts"]) > 0)


def phrase_matches(docs: DataFrame, of: Search) -> DataFrame:
    """(doc_id, content, n_words, matches) for every row of ``docs``.

    ``matches`` has for each item the document positions at which its windows start, and their width.
    """
    wanted, slots = _wanted(of)
    body = text_or_empty("text")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("content"), body.alias("text"))
    texts = texts.withColumn("slot", _slot(F.col("doc_id"), F.col("content"))).join(slots.withColumn("due", F.lit(True)), "slot", "left")
    # Texts are shuffled as they are and cut into words after the join, as arrays of words are twice as large; those of
    # documents without an alignment are counted here and stay behind.
    count = F.when(F.col("due").isNull(), F.size(terms_of(F.col("text"))))
    texts = texts.select("doc_id", "content", F.when(F.col("due"), F.col("text")).alias("text"), count.alias("counted"))
    rows = texts.join(wanted, _is_wanted(), "left")
    rows = rows.select("doc_id", "content", "wanted", "counted", F.when(F.col("text").isNotNull(), terms_of(F.col("text"))).alias("words"))
    found = F.when(F.col("wanted").isNotNull(), _found(F.col("words"), of.window))
    return rows.select(
        "doc_id", "content", F.coalesce("counted", F.size("words")).cast("long").alias("n_words"), F.coalesce(found, F.array().cast(MATCHES)).alias("matches")
    )


def hit_positions(matches: Column) -> Column:
    """Distinct document positions inside the matches."""
    places = F.flatten(F.transform(matches, lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["width"] - 1)))))
    return F.array_distinct(places)


def item_ids(matches: Column) -> Column:
    """Distinct ids of the matched items as strings, in the order of strings."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(matches, lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull())))


def proximity_matches(of: Search, slop: int = SLOP) -> DataFrame:
    """(doc_id, content, item_id, place): loose matches. The two rarest terms of one window stand in two places of the
    document that are no further apart than their places in the item by more than ``slop`` words, in either order;
    ``place`` is the first of the two."""
    pairs = of.pairs.where("second is not null")
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c)["term"].alias("term")) for k, c in enumerate(("first", "second"))])).alias("x")
    # All that a match depends on are the terms and how far apart they are.
    wide = pairs.select("item", F.col("first.term").alias("a"), F.col("second.term").alias("b"), (F.col("second.place") - F.col("first.place")).alias("gap"), sides)
    wide = stored(wide.select("item", F.xxhash64("a", "b", "gap").alias("pair"), "gap", "x.side", "x.term").distinct(), "decontam-pairs")
    hits = of.index.join(bounded(wide, wide.count()), "term").select("doc_id", "content", "item", "pair", "gap", "side", "place")
    # The nearest place of the other term is the next one in this order, or there is one before this.
    onward = Window.partitionBy("doc_id", "content", "item", "pair").orderBy("place", "side")
    near = hits.withColumn("next", F.lead(F.struct("place", "side")).over(onward)).where(
        (F.col("next.side") != F.col("side")) & (F.col("next.place") > F.col("place")) & (F.col("next.place") - F.col("place") <= F.col("gap") + slop)
    )
    names = of.items.select("item", "item_id")
    return near.join(bounded(names, names.count()), "item").select("doc_id", "content", "item_id", "place").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any word inside a benchmark window."""
    wanted, slots = _wanted(search(docs, benchmark, window))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("content"))
    rows = rows.withColumn("slot", _slot(F.col("doc_id"), F.col("content")))
    due = rows.join(slots, "slot", "left_semi").join(wanted, _is_wanted(), "left")
    words = terms_of(text_or_empty(F.col("row")["text"]))
    # Only documents with candidates are shuffled and cut into words, once each.
    dirty = F.when(F.col("wanted").isNotNull(), let(words, lambda w: F.size(_found(w, window)) > 0)).otherwise(F.lit(False))
    kept = rows.join(slots, "slot", "left_anti").select("row").unionByName(due.where(~dirty).select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
