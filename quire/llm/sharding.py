"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Bytes and rows are
aggregated per slot, and a versioned table maps every slot to a shard; a
rebalance only edits that map, the records' slots never change. Two laws:
``place_by_bytes`` edits the first map by the bytes of the slots, ``grow`` deals
slots to a new shard by their number alone. All steps are DataFrame expressions; the map has ``n_slots`` rows, in ``N_LANES`` lanes
each, at any input size, which bounds its broadcast.

Defined results: a null id hashes as the empty string; a null text has no
bytes; equal rows each get a place of their own, in one slot; a slot is never
split, so a shard is above the mean by a very long text where that alone is
longer than the mean; of slots that fit equally the smallest moves; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import shared_path

from .common import written

N_SLOTS = 4096
N_LANES = 8


def virtual_slot(id_col: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5, modulo the slots."""
    key = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n_slots


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, by_text: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each row; texts go no further. ``by_text`` hashes the id and the
    text's CRC, so that different texts of one id are spread over the slots; else the id alone decides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32")) if by_text else F.col("doc_id")
    return rows.withColumn("virtual_slot", virtual_slot(key, n_slots))


def _lane(recs: DataFrame) -> DataFrame:
    """Splits a slot into lanes by text, so that rows of one repeated id are numbered by several tasks."""
    return recs.withColumn("lane", F.col("text_crc32") % N_LANES)


def slot_stats(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each occupied slot."""
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: the slots are dealt out in turn."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def grow(slot_map: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version, with shard ``n_shards`` added: each shard gives up the slots beyond its new share, to the new shard only."""
    turn = F.row_number().over(Window.partitionBy("shard").orderBy("virtual_slot"))
    share = F.floor((F.lit(n_slots) + F.lit(n_shards) - F.col("shard")) / F.lit(n_shards + 1))
    return slot_map.select((F.col("version") + 1).alias("version"), "virtual_slot",
                           F.when(turn > share, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, stats: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The next version, edited by bytes: while the fullest shard is above the mean by more than ``tolerance``, the slot
    that comes nearest to half of the difference moves from it to the emptiest. Reads ``n_slots`` rows on the driver, at
    any input size."""
    spark = slot_map.sparkSession
    rows = slot_map.join(stats, "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")).collect()
    shard = {r.virtual_slot: r.shard for r in rows}
    size = {r.virtual_slot: r.bytes for r in rows}
    load = dict.fromkeys(sorted(set(shard.values())), 0)
    for slot, s in shard.items():
        load[s] += size[slot]
    mean = sum(load.values()) / max(1, len(load))
    for _ in range(len(rows)):
        high, low = max(load, key=load.get), min(load, key=load.get)
        gap = load[high] - load[low]
        fits = [slot for slot in shard if shard[slot] == high and 0 < size[slot] < gap]
        if load[high] <= mean * (1 + tolerance) or not fits:
            break
        best = min(fits, key=lambda slot: (abs(2 * size[slot] - gap), slot))
        shard[best] = low
        load[high] -= size[best]
        load[low] += size[best]
    version = (rows[0].version if rows else 0) + 1
    return spark.createDataFrame([(version, slot, s) for slot, s in sorted(shard.items())], "version int, virtual_slot long, shard int")


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version beside the earlier ones; a stored version is never overwritten."""
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot long, shard int").parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "virtual_slot", "shard")


def assign(recs: DataFrame, slot_map: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """Each record's shard, and its place there: slots follow each other within a shard, ids within a slot."""
    maps = slot_map.select("virtual_slot", "shard")
    if grown is not None:
        maps = maps.join(grown.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    recs = _lane(recs)
    lanes = maps.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_LANES - 1).cast("long"))))
    counted = lanes.join(recs.groupBy("virtual_slot", "lane").agg(F.count("*").alias("n")), ["virtual_slot", "lane"], "left")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot", "lane").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0))).drop("n")
    turn = F.row_number().over(Window.partitionBy("virtual_slot", "lane").orderBy("doc_id", "size", "text_crc32"))
    return (recs.withColumn("turn", turn).join(F.broadcast(placed), ["virtual_slot", "lane"])
            .withColumn("slot", F.col("before") + F.col("turn") - 1).drop("turn", "before", "lane"))


def place_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> tuple[DataFrame, str, list[str]]:
    """Each record's shard under a map edited by the slots' bytes: the placed records, with the shard of version 1 as
    ``first_shard``; the folder of the map's versions; and the other paths written. Texts are read once."""
    spark = docs.sparkSession
    recs, path = written(records(docs, id_col, text_col, n_slots, by_text=True), "slot-records")
    stats, other = written(slot_stats(recs), "slot-stats")
    maps = shared_path(spark, "slot-maps")
    save_map(initial_map(spark, n_shards, n_slots), maps, 1)
    save_map(rebalance(load_map(spark, maps, 1), stats), maps, 2)
    first = load_map(spark, maps, 1).select("virtual_slot", F.col("shard").alias("first_shard"))
    placed = assign(recs, load_map(spark, maps, 2)).join(F.broadcast(first), "virtual_slot")
    return placed, maps, [path, other]
