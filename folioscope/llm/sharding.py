"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, the bytes of each slot are summed, and a
versioned table maps slots to shards. Rebalancing edits that table: slots move, records don't
hash anew. The map has one row for each virtual slot, so its size does not depend on the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.storage import shared_dir

VIRTUAL_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int"


def with_slots(records: DataFrame, key: str, text: str, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Adds size (UTF-8 bytes plus one; a null text has none) and vslot, the hash slot of the key.

    A null key hashes like any other value. Columns of these names that are already there are replaced.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return records.withColumn("size", size).withColumn("vslot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """(vslot, bytes, records): at most one row for each virtual slot."""
    return slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def first_map(sizes: dict[int, int], shards: int, slots: int = VIRTUAL_SLOTS) -> dict[int, int]:
    """Largest slots first, each to the shard with the fewest bytes; empty slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for vslot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
        held, shard = heapq.heappop(heap)
        placed[vslot] = shard
        heapq.heappush(heap, (held + max(sizes.get(vslot, 0), 1), shard))
    return placed


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Edits a map for a new number of shards or new sizes, moving few slots.

    Slots of shards that are gone, and slots above a shard's fair share (smallest first), move to
    the shards with the fewest bytes; all others stay where they are.
    """
    fair = sum(sizes.values()) / max(shards, 1)
    held = dict.fromkeys(range(shards), 0)
    by_shard: dict[int, list[int]] = {s: [] for s in range(shards)}
    moving = []
    for vslot, shard in sorted(old.items()):
        if shard < shards:
            by_shard[shard].append(vslot)
            held[shard] += sizes.get(vslot, 0)
        else:
            moving.append(vslot)
    new = dict(old)
    for shard, own in by_shard.items():
        for vslot in sorted(own, key=lambda v: (sizes.get(v, 0), v)):
            if 0 < sizes.get(vslot, 0) <= held[shard] - fair:
                held[shard] -= sizes[vslot]
                moving.append(vslot)
    heap = [(b, s) for s, b in held.items()]
    heapq.heapify(heap)
    for vslot in sorted(moving, key=lambda v: (-sizes.get(v, 0), v)):
        b, shard = heapq.heappop(heap)
        new[vslot] = shard
        heapq.heappush(heap, (b + sizes.get(vslot, 0), shard))
    return new


class SlotMap:
    """The versioned slot-to-shard table: one Parquet folder for each version, never overwritten."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        import uuid

        self.spark, self.path = spark, path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def save(self, version: int, placed: dict[int, int]) -> DataFrame:
        rows = [(version, v, s) for v, s in sorted(placed.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")


def shard_records(records: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, slots: int = VIRTUAL_SLOTS, slot_map: SlotMap | None = None, version: int = 1) -> DataFrame:
    """Adds size, vslot, shard and slot (the record's place in its shard, gapless from 0) to records.

    Shards get nearly equal bytes. Places come from counts of whole virtual slots and a row number
    within one of them, so no task sorts more than one virtual slot. Repeated keys and equal rows
    keep separate places (any order among them); null texts count one byte; an empty table gives
    an empty result. Other columns stay; columns named size, vslot, shard or slot are replaced.
    """
    slotted = with_slots(records.drop("shard", "slot"), key, text, slots)
    stats = slot_bytes(slotted).collect()  # at most one row for each virtual slot
    sizes, counts = {r.vslot: r.bytes for r in stats}, {r.vslot: r.records for r in stats}
    slot_map = slot_map or SlotMap(records.sparkSession)
    placed = slot_map.save(version, first_map(sizes, shards, slots))
    at, before = {}, dict.fromkeys(range(shards), 0)
    for row in sorted(placed.collect(), key=lambda r: r.vslot):
        at[row.vslot] = (row.vslot, row.shard, before[row.shard])
        before[row.shard] += counts.get(row.vslot, 0)
    starts = records.sparkSession.createDataFrame(list(at.values()), "vslot int, shard int, _start long")
    order = Window.partitionBy("vslot").orderBy(F.col(key).asc_nulls_first())
    return (
        slotted.join(F.broadcast(starts), "vslot")  # one row for each virtual slot
        .withColumn("slot", F.col("_start") + F.row_number().over(order) - 1)
        .drop("_start")
    )
