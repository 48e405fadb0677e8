"""Sharding by fixed virtual slots, in DataFrame and SQL functions only.

A row's doc_id hashes into one of ``SLOTS`` = 8,192 virtual slots for ever. Bytes are summed per slot (with partial sums
before the shuffle), and a slot-to-shard map assigns whole slots: heaviest first, each to the lightest shard so far. The
map has a row per slot, whatever the corpus, so it is broadcast; it is stored under a version, and rebalancing edits the
last version: only the slots that must move change their shard.

Law ``bytes``: shards' sizes are near equal (within about the lightest slots' bytes), so ``grown_shard`` is null. The law
knows no groups: equal texts under different ids may fall into different shards.

Cases: a null text has no bytes and CRC 0; rows without doc_id take their slot from their text, so that many of them
don't share one; repeated rows are sharded row by row, in the order
of doc_id, size and CRC; ties between slots go to the smaller slot and shard; an empty table returns no rows; other
columns are ignored.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import removed, shared_dir, written

SLOTS = 8192
ROW_BYTES = 16


def virtual_slot(key: Column, other: Column) -> Column:
    """The slot of a key for ever; of ``other`` where there is no key."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(other)), F.lit(SLOTS)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, vslot)`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text")).alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _assigned(slots: DataFrame, start: Column) -> DataFrame:
    """``(vslot, shard)`` of the slots in ``slots(vslot, bytes)``: heaviest first, each to the lightest shard. ``start`` is
    the array of (load, shard) before."""
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))), lambda x: F.struct(x["vslot"].alias("vslot"), (-x["less"]).alias("bytes")))

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_min(state["loads"])
        loads = F.transform(state["loads"], lambda x: F.when(x["shard"] == lightest["shard"], F.struct((x["load"] + slot["bytes"]).alias("load"), x["shard"].alias("shard"))).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), lightest["shard"].alias("shard")))).alias("placed"))

    zero = F.struct(F.col("start").alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("placed"))
    return slots.agg(order.alias("o"), start.alias("start")).select(F.inline(F.aggregate("o", zero, place)["placed"]))


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 1: ``(version, vslot, shard)`` of all slots, those without rows included."""
    spark = slots.sparkSession
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("vslot")).join(slots, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    start = F.array(*[F.struct(F.lit(0).cast("long").alias("load"), F.lit(i).alias("shard")) for i in range(shards)])
    return _assigned(every, start).select(F.lit(1).alias("version"), "vslot", "shard")


def rebalanced(old: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version after ``old(version, vslot, shard)`` for new slot bytes and shard count. A shard keeps its slots
    (lightest first) while they fit in the mean load; the rest, and the slots of shards that are gone, move."""
    every = old.join(slots.select("vslot", "bytes"), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    mean = every.agg((F.sum("bytes") / shards).alias("mean"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot"))
    marked = every.withColumn("run", running).join(F.broadcast(mean)).withColumn("stays", (F.col("run") <= F.col("mean")) & (F.col("shard") < shards))
    loads = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    version = old.agg((F.max("version") + 1).alias("version"))
    state = old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).cast("long").alias("load"), "shard"))).alias("state"))
    moving = marked.where("not stays").select("vslot", "bytes").join(F.broadcast(state))
    first = F.max("state")
    moved = _assigned(moving, first)
    return moved.union(marked.where("stays").select("vslot", "shard")).join(F.broadcast(version)).select("version", "vslot", "shard")


def stored(map_: DataFrame, folder: str) -> DataFrame:
    """Writes a map under ``folder``, a folder per version, and reads its version back; earlier versions stay."""
    map_.repartition(1).write.mode("append").partitionBy("version").parquet(folder)  # a row per virtual slot: bounded
    return read_map(map_.sparkSession, folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The given or latest version of the stored map."""
    all_ = spark.read.parquet(folder).select("version", "vslot", "shard")
    wanted = F.lit(version) if version is not None else all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == wanted)


def sharded(rows: DataFrame, slots: DataFrame, map_: DataFrame) -> DataFrame:
    """``rows`` with their shard and their gapless place in it. A slot's rows are numbered apart from other slots', and
    start after the rows of the shard's earlier slots."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = map_.join(slots, "vslot").select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("start"))  # a row per virtual slot: bounded
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("place", place).join(F.broadcast(starts), "vslot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard_documents(docs: DataFrame, shards: int = 40, folder: str | None = None) -> DataFrame:
    """Sizes, sums, maps (stored under ``folder``) and shards all rows of ``docs``."""
    spark = docs.sparkSession
    rows = sized(docs)
    slots = written(slot_bytes(rows), "slots")  # at most a row per virtual slot; the texts are read for it and for the rows
    if folder is None:
        folder = f"{shared_dir(spark)}/lodestrata-slot-map-{uuid.uuid4().hex}"
        atexit.register(removed, spark, folder)
    return sharded(rows, slots, stored(first_map(slots, shards), folder))
