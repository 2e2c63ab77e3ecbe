"""Mixing sources to target weights: how often each document is taken, so that sources come near their shares.

Words are added up for each source. Sources in the order of their names weigh 5, 2, 1, 5, 2, 1, ... and share one and a half
times all words; no source gets more than twice its own words, and what is beyond that is shared again by weight among the others
until none is above. A source's rate is its target over its words. Each of its documents is taken floor(rate) times, and once
more if a number drawn from a hash of the document and a seed is below the fraction that is left. Sixteen seeds are tried for
each source, all in one pass over small rows, and the one is taken whose words come nearest to the target, so that the words
of few or long documents do so as well as chance allows. Nothing depends on partitions or the order of rows, so reruns agree.

Equal rows (id, source, text) are counted before they are shuffled, and each draws a number of its own; a group of many is dealt
out again by chunks. The table of sources is broadcast up to 100,000 rows, and joined by sorting beyond that.

Nulls: a null text has no words and is taken as often as any other. A null source is a source, the last one. Rows without an id
draw by their text. A source without words has target and rate 0. Empty tables give empty tables. Other columns are carried
along by ``mix``, where of equal rows one stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEEDS = 16
SMALL = 100_000
CHUNK = 4_096
KEY = ("doc_id", "source", "content")


def _body() -> Column:
    return text_or_empty(F.col("text").cast("string"))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, content, size, times): each different row once. ``content`` is the MD5 of the text."""
    rows = docs.select("doc_id", "source", F.md5(_body().cast("binary")).alias("content"), F.regexp_count(_body(), F.lit(WORD_PATTERN)).cast("long").alias("size"))
    return stored(rows.groupBy(*KEY, "size").agg(F.count("*").alias("times")), "mix-rows")


def in_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, in the order of code points, null last. No task sees more than its range of names."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    # Written once, as two samples of the names may draw different borders.
    ranged = stored(ranged, "mix-names")
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    # One row for each partition.
    parts = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = ranged.withColumn("within", F.row_number().over(own)).join(F.broadcast(parts.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    return placed.withColumn("place", F.col("before") + F.col("within") - 1).drop("part", "before", "within")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate): a fair sharing by weight under a limit for each source."""
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(in_order(sizes).select("source", "source_size", weight.alias("weight")), "mix-sources")
    first = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, spent, heavy, full = share * (first["size"] or 0), 0.0, first["weight"] or 0, -1
    while True:
        level = (budget - spent) / heavy if heavy else 0.0
        above = F.lit(most) * F.col("source_size") < F.col("weight") * F.lit(level)
        # Three numbers a round; a round is due only after more sources have met their limit.
        got = sources.agg(F.count_if(above).alias("full"), F.sum(F.when(above, most * F.col("source_size"))).alias("spent"), F.sum(F.when(~above, F.col("weight"))).alias("heavy")).first()
        if got["full"] in (full, 0) or not got["heavy"]:
            break
        full, spent, heavy = got["full"], got["spent"], got["heavy"]
    target = F.when(above, F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * F.lit(level))
    found = sources.withColumn("target", target.cast("double"))
    return found.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "name")
    small = sources.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(named) if small else named.hint("merge"), F.col("source").eqNullSafe(F.col("name"))).drop("name")


def extra(seed: Column | int) -> Column:
    """1 if the number drawn with the seed is below the fraction of the rate, else 0."""
    number = (F.col("h1") + F.col("h2") * (F.lit(seed) if isinstance(seed, int) else seed)) % (1 << 32)
    return F.when(number / F.lit(float(1 << 32)) < F.col("rate") - F.floor("rate"), 1).otherwise(0)


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h1`` and ``h2``, two numbers of 32 bits from the MD5 of id, number among equals and text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("number").cast("string"), "content"))
    part = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    return rows.withColumn("digest", digest).withColumn("h1", part(0)).withColumn("h2", part(1)).drop("digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row ``times`` times with its ``number``, from 1. Many equals leave their task in chunks."""
    few = rows.where(F.col("times") <= CHUNK).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("number"))
    chunks = rows.where(F.col("times") > CHUNK).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {CHUNK}"))).alias("chunk")).repartition("content", "chunk")
    begin = F.col("chunk") * CHUNK
    many = chunks.select("*", F.explode(F.sequence(begin + 1, F.least(begin + CHUNK, "times"))).alias("number")).drop("chunk")
    return few.unionByName(many)


def drawn(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, content, size, source_size, target, rate, copies): one row for each row of the documents."""
    every = _with(hashed(_numbered(rows)), sources)
    whole = F.floor("rate")
    sums = every.groupBy("source").agg(*[F.sum(F.col("size") * (whole + extra(s))).alias(f"s{s}") for s in range(SEEDS)])
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("gap"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
    seeded = _with(sums, sources.select("source", "target")).select("source", near["seed"].alias("seed"))
    seeded = stored(seeded, "mix-seeds")
    return _with(every, seeded).withColumn("copies", (whole + extra(F.col("seed"))).cast("long")).select(*KEY, "size", "source_size", "target", "rate", "copies")


def plan(docs: DataFrame) -> DataFrame:
    """``drawn`` for the documents and the targets of their sources."""
    rows = counted(docs)
    return drawn(rows, stored(targets(rows), "mix-targets"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix: every row as often as it is taken. ``docs`` is read twice, and its texts are shuffled once."""
    totals = plan(docs).groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.count("*").alias("equals")).where("copies > 0")
    totals = stored(totals, "mix-copies").withColumnsRenamed({c: f"name_{c}" for c in KEY}).hint("merge")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.md5(_body().cast("binary")).alias("content"))
    same = [F.col(c).eqNullSafe(F.col(f"name_{c}")) for c in KEY]
    rows = rows.join(totals, same[0] & same[1] & same[2])
    one = rows.where("equals = 1").select("row", "content", F.col("copies").alias("times"))
    # Of equal rows the one with the smallest hash of all columns is taken for all of them.
    many = rows.where("equals > 1").groupBy(*KEY).agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("copies").alias("times")).select("row", "content", "times")
    return _numbered(one.unionByName(many)).select("row.*")
