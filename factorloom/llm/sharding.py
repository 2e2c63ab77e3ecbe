"""Sharding by fixed virtual slots.

Every record falls into one of ``SLOTS`` virtual slots by a hash of its id; that never changes. Bytes are added up for
each slot, and a small versioned table says which shard owns each slot. Version 1 deals the slots round; rebalancing
edits it into the next version: an overloaded shard keeps its largest slots up to the mean load and gives up the rest,
and the slots given up go, largest first, to the shard with the fewest bytes. Records never move for any other reason.
The law is ``bytes``: the shards' sizes are near equal.

Nulls: a null text has no bytes of its own; records with a null ``doc_id`` are spread by their text. Empty texts count 8
bytes. Repeated rows are dealt together and numbered one by one. Empty tables give empty tables. Other columns are
carried along by ``shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored, text_or_empty

SLOTS = 8_192
SHARDS = 24
RECORD_BYTES = 8


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, slot, shard)."""
    return spark.range(slots, numPartitions=1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of ``slot_map`` (version, slot, shard) for the loads (slot, bytes).

    All windows and folds here run over the slots, whose number is fixed, not over records.
    """
    latest = slot_map.withColumn("newest", F.max("version").over(Window.partitionBy(F.lit(1)))).where("version = newest")
    loads = latest.join(slot_bytes, "slot", "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / shards
    kept = F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("mean")
    marked = loads.withColumn("mean", mean).withColumn("kept", kept & (F.col("shard") < shards))
    one = marked.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct("bytes", "slot"))), asc=False).alias("moved"),
        F.collect_list(F.when(F.col("kept"), F.struct("slot", "shard", "bytes"))).alias("kept"),
    )
    zero = F.array_repeat(F.lit(0).cast("long"), shards)

    def add(loads: Column, shard: Column, more: Column) -> Column:
        return F.transform(loads, lambda v, k: F.when(k == shard, v + more).otherwise(v))

    start = F.aggregate("kept", zero, lambda acc, x: add(acc, x["shard"], x["bytes"]))

    def place(acc: Column, x: Column) -> Column:
        return let(
            (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int"),
            lambda s: F.struct(
                add(acc["loads"], s, x["bytes"]).alias("loads"),
                F.concat(acc["out"], F.array(F.struct(x["slot"].alias("slot"), s.alias("shard")))).alias("out"),
            ),
        )

    empty = F.array().cast("array<struct<slot:int,shard:int>>")
    placed = F.aggregate("moved", F.struct(start.alias("loads"), empty.alias("out")), place, lambda acc: acc["out"])
    both = F.concat(F.transform("kept", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"))), placed)
    return one.select("version", F.explode(both).alias("m")).select((F.col("version") + 1).alias("version"), "m.slot", "m.shard")


def plan(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, map): (doc_id, content, size, text_crc32, virtual_slot) by record, and all versions of the slot map.

    ``slot_map``: the versions so far; without one, the first is made here. One more version is added to it.
    """
    body = text_or_empty("text")
    doc_id = F.col("doc_id").cast("long")
    digest = stored(
        docs.select(
            doc_id.alias("doc_id"),
            (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            slot_of(doc_id, body, slots).alias("virtual_slot"),
        ),
        "sharding-digest",
    )
    before = first_map(docs.sparkSession, shards, slots) if slot_map is None else slot_map
    loads = digest.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"))
    return digest, stored(before.unionByName(rebalanced(before, loads, shards)), "sharding-map")


def latest(slot_map: DataFrame) -> DataFrame:
    """(virtual_slot, shard) of the newest version."""
    newest = F.max("version").over(Window.partitionBy(F.lit(1)))
    return slot_map.withColumn("newest", newest).where("version = newest").select(F.col("slot").alias("virtual_slot"), "shard")


def shard(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` with the column ``shard`` by the newest version of the map. Only the map is broadcast: ``slots`` rows."""
    kept = [c for c in docs.columns if c not in ("virtual_slot", "shard")]
    return docs.select(*kept, slot_of(F.col("doc_id").cast("long"), text_or_empty("text"), slots).alias("virtual_slot")).join(F.broadcast(latest(slot_map)), "virtual_slot").drop("virtual_slot")


def places(digest: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``digest`` with shard and place, numbered from 0 in each shard: by virtual slot, then by id.

    Records are ranked inside their virtual slot, and each slot begins where the shard's slots before it end, so no task
    holds a whole shard.
    """
    owner = latest(slot_map)
    counts = digest.groupBy("virtual_slot").agg(F.count("*").alias("records"))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot")
    begins = counts.join(F.broadcast(owner), "virtual_slot").select(
        "virtual_slot", "shard", (F.sum("records").over(in_shard) - F.col("records")).alias("begin")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    # One row for each virtual slot, a fixed number.
    return digest.withColumn("rank", rank).join(F.broadcast(begins), "virtual_slot").withColumn("place", F.col("begin") + F.col("rank") - 1).drop("begin", "rank")
