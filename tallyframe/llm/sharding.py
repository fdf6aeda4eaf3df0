"""Shards through fixed virtual slots and a versioned slot-to-shard map.

Method: a record's slot is a hash of its key modulo a fixed number of slots, which never changes. A map from
slot to shard places slots; only the map is edited when shards are added or load is evened out, and every
edit makes a new version, so an old version still finds its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from tallyframe.plans.ordered import Running, running

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Fixed slot of a key; a null key has a slot of its own hash like any other value."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("slot")), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn, so shards differ by at most one slot."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version with shard number ``shards``: it takes an even share of every old shard's slots, nothing else moves.

    The edit depends on the map and the shard count alone, never on the rows. The map has one row per slot,
    so its windows are bounded by the number of slots.
    """
    own = W.partitionBy("shard").orderBy(F.xxhash64("virtual_slot", F.lit(shards)), "virtual_slot")
    turn = F.row_number().over(own) - 1
    return slot_map.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(turn % (shards + 1) == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def slot_bytes(placed: DataFrame) -> DataFrame:
    """Rows and bytes per slot, summed before the shuffle."""
    return placed.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """Next version that evens out bytes: slots, largest first, are dealt to shards in a snake.

    Works on one row per slot. A slot is never split; a single heavier slot stays where the snake puts it.
    """
    seen = slot_map.join(loads, "virtual_slot", "left").select("version", "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    place = F.row_number().over(W.orderBy(F.col("bytes").desc(), "virtual_slot")) - 1
    lap, at = F.floor(place / shards), place % shards
    return seen.select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(lap % 2 == 0, at).otherwise(shards - 1 - at).cast("int").alias("shard")
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version; a file per version, so readers of older versions are not disturbed."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version)


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Every row with its size, text checksum and fixed slot; map-side only.

    Size is the text's UTF-8 bytes (null: none) plus 16. A null text has the checksum of no bytes.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return df.select(
        F.col(key).alias("doc_id"),
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        slot_of(F.col(key), slots).alias("virtual_slot"),
    )


def place(assigned: DataFrame, slot_map: DataFrame, grown_map: DataFrame) -> DataFrame:
    """Shard by each map and a gapless number inside the shard.

    Numbers follow (slot, id, checksum); chunks of a slot by checksum keep a slot filled with one hot key
    split over tasks. Identical rows get different numbers in no particular order. Nulls in any column
    and repeated rows are placed like others; an empty table gives an empty result.
    """
    maps = slot_map.select("virtual_slot", "shard").join(grown_map.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    rows = assigned.join(maps, "virtual_slot")
    rows = rows.withColumn("__part", F.col("virtual_slot") * 64 + F.pmod("text_crc32", F.lit(64)).cast("int"))
    numbered = running(rows, ["shard"], ["doc_id", "text_crc32"], F.col("__part"), [Running("__n", "count")])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__n") - 1).alias("slot"), "grown_shard", "virtual_slot"
    )
