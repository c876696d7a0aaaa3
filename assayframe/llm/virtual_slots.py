"""Sharding by fixed virtual slots.

Each record belongs to one of a fixed number of virtual slots by a hash of its id
and its text's checksum. Bytes are summed per slot, and a small versioned table maps slots to
shards: version 1 places the slots, largest first, each on the shard that is
lightest so far; a rebalance writes the next version, in which only the slots that
must move have another shard. The law is `bytes`: the shards' sizes come out near
equal. Within a shard, positions count from 0 without gaps: a slot starts where the
slots before it in the shard end, and rows are numbered within their slot, so no
task sorts a whole shard.

The map has n_slots rows, whatever the data, so it is joined by broadcast and placed
in one small ordered pass.

Defined results: a null text has no bytes and CRC 0; rows with a null id go by their
text; repeated rows (equal id and text) share a slot; empty tables give no rows.
Other columns stay unless they bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SLOTS = 8_192
RECORD_OVERHEAD = 8
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def virtual_slot(doc_id: Column, text_crc32: Column, n_slots: int = N_SLOTS) -> Column:
    """By the first 32 bits of an MD5 over id and checksum."""
    key = F.concat_ws(":", doc_id.cast("string"), text_crc32.cast("string"))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, n_rows, n_bytes of records that have virtual_slot and size."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def place(slots: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """A new map of virtual_slot, n_bytes, shard, map_version. slots: as of slot_bytes, one row a slot.

    The fold runs over an array of at most n_slots entries, once.
    """
    ordered = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("n_bytes")).alias("key"), "virtual_slot"))).alias("s"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(acc: Column, x: Column) -> Column:
        at = _lightest(acc["loads"])
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["key"]).otherwise(v)).alias("loads"), F.concat(acc["shards"], F.array(at)).alias("shards")
        )

    placed = ordered.select("s", F.aggregate("s", start, step)["shards"].alias("shards"))
    return placed.select(F.explode(F.arrays_zip("s", "shards")).alias("z")).select(
        F.col("z.s.virtual_slot").alias("virtual_slot"), (-F.col("z.s.key")).alias("n_bytes"), F.col("z.shards").alias("shard"), F.lit(version).alias("map_version")
    )


def rebalance(current: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version: slots are kept where they are while their shard stays within the mean size, smallest last; the rest is placed anew.

    With one shard more, slots move into the new shard only as far as the mean asks.
    """
    version = current.agg(F.max("map_version")).first()[0] or 0
    known = slots.join(F.broadcast(current.select("virtual_slot", F.col("shard").alias("old_shard"))), "virtual_slot", "left")
    mean = (slots.agg(F.sum("n_bytes")).first()[0] or 0) / n_shards
    by_shard = Window.partitionBy("old_shard").orderBy(F.desc("n_bytes"), "virtual_slot")
    judged = known.withColumn("upto", F.sum("n_bytes").over(by_shard))
    stays = (F.col("old_shard") < n_shards) & (F.col("upto") <= F.lit(mean))
    ordered = judged.agg(
        F.sort_array(F.collect_list(F.when(~F.coalesce(stays, F.lit(False)), F.struct((-F.col("n_bytes")).alias("key"), "virtual_slot")))).alias("s"),
        F.collect_list(F.when(stays, F.struct("virtual_slot", "n_bytes", F.col("old_shard").alias("shard")))).alias("kept"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: a + F.when(k["shard"] == i, k["n_bytes"]).otherwise(F.lit(0).cast("long"))),
    )

    def step(acc: Column, x: Column) -> Column:
        at = _lightest(acc["loads"])
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["key"]).otherwise(v)).alias("loads"), F.concat(acc["shards"], F.array(at)).alias("shards")
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    placed = ordered.select("kept", F.arrays_zip(F.col("s"), F.aggregate("s", start, step)["shards"].alias("shards")).alias("z"))
    moved = F.transform("z", lambda z: F.struct(z["s"]["virtual_slot"].alias("virtual_slot"), (-z["s"]["key"]).alias("n_bytes"), z["shards"].alias("shard")))
    return placed.select(F.inline(F.concat("kept", moved))).withColumn("map_version", F.lit(version + 1))


def save_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds a version to the stored map and gives the table as stored."""
    slot_map.coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)
    return load_map(slot_map.sparkSession.read.parquet(path))


def load_map(stored: DataFrame, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest unless told otherwise."""
    if version is None:
        version = stored.agg(F.max("map_version")).first()[0]
    return stored.where(F.col("map_version") == F.lit(version))


def describe(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """df with size, text_crc32 and virtual_slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in RESULTS))
    measured = kept.withColumns({"size": (F.octet_length(body) + RECORD_OVERHEAD).cast("long"), "text_crc32": F.crc32(body.cast("binary"))})
    return measured.withColumn("virtual_slot", virtual_slot(F.col(doc_id), F.col("text_crc32"), n_slots))


def assign(records: DataFrame, slot_map: DataFrame, order: str = "doc_id", slots: DataFrame | None = None) -> DataFrame:
    """records (as of describe) with law, shard, slot, grown_shard and map_version. slots: as of slot_bytes, if the records have been counted already."""
    rows = (slot_bytes(records) if slots is None else slots).select("virtual_slot", "n_rows")
    # Both windows below go over the map, of n_slots rows at most.
    starts = slot_map.join(rows, "virtual_slot").withColumn(
        "start", F.coalesce(F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(order), F.col("text_crc32"))) - 1
    return (
        records.withColumn("_within", within)
        .join(F.broadcast(starts.select("virtual_slot", "shard", "start", "map_version")), "virtual_slot")
        .withColumns({"law": F.lit("bytes"), "slot": (F.col("start") + F.col("_within")).cast("long"), "grown_shard": F.lit(None).cast("int")})
        .drop("_within", "start")
    )
