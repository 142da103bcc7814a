"""Sharding through fixed virtual slots [native].

A record's id is hashed into one of a fixed number of virtual slots.  Bytes and rows are summed by
slot, and a small versioned map names the shard of every slot.  Rebalancing edits the map: whole
slots move, and only as many as the balance needs.  The map has one row a slot, so its size is fixed
and the driver may hold it; records never pass through the driver.

A null id hashes as an empty text, a null text has no bytes; repeated rows share a slot and are
counted each.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import table

#: Three hex digits of a hash.
SLOTS = 4096


def slot_of(id_col):
    """The virtual slot of a record: 12 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


@dataclass
class SlotMap:
    """Slot -> shard, with a version that counts edits and the slots that the last edit moved."""

    shards: int
    owner: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, shards: int, load: dict[int, int]) -> "SlotMap":
        """The largest slot first, each to the shard with the least bytes so far (ties: lower numbers)."""
        owner, heap = [0] * SLOTS, [(0, s) for s in range(shards)]
        for slot in sorted(range(SLOTS), key=lambda s: (-load.get(s, 0), s)):
            have, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (have + load.get(slot, 0), shard))
        return cls(shards, owner)

    def rebalance(self, shards: int, load: dict[int, int]) -> "SlotMap":
        """The next version for ``shards`` shards: slots of shards that are gone and the smallest
        set of slots that brings the fullest shards down to the mean move, no others."""
        owner, total = list(self.owner), sum(load.values())
        have = [0] * shards
        loose = [s for s in range(SLOTS) if owner[s] >= shards]
        for slot in range(SLOTS):
            if owner[slot] < shards:
                have[owner[slot]] += load.get(slot, 0)
        mean = total / shards
        for slot in sorted(range(SLOTS), key=lambda s: (-load.get(s, 0), s)):
            own = owner[slot]
            if own < shards and have[own] - load.get(slot, 0) >= mean and load.get(slot, 0):
                have[own] -= load[slot]
                loose.append(slot)
        heap = [(b, s) for s, b in enumerate(have)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda s: (-load.get(s, 0), s)):
            b, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (b + load.get(slot, 0), shard))
        return SlotMap(shards, owner, self.version + 1, [s for s in range(SLOTS) if owner[s] != self.owner[s]])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, own, self.version) for s, own in enumerate(self.owner)]
        return spark.createDataFrame(rows, "vslot int, shard int, map_version int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at ``path``."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "SlotMap":
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("map_version")).first()[0]
        own = sorted(rows.filter(F.col("map_version") == version).select("vslot", "shard", "shards").collect())
        return cls(own[0][2], [r[1] for r in own], version)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col(id_col)).alias("vslot"))


def slot_loads(rows: DataFrame) -> list:
    """(vslot, bytes, rows), at most SLOTS of them."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def shard(docs: DataFrame, shards: int = 16, slot_map: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its place in the shard, and the slot map that was used."""
    spark, rows = docs.sparkSession, sized(docs, id_col, text_col)
    loads = slot_loads(rows)
    slot_map = slot_map or SlotMap.balanced(shards, {r[0]: r[1] for r in loads})
    counts, start, offsets = {r[0]: r[2] for r in loads}, [0] * slot_map.shards, []
    for slot, own in enumerate(slot_map.owner):  # a place in the shard: rows of the shard's earlier slots, then the row's number in its slot
        offsets.append((slot, own, start[own], slot_map.version))
        start[own] += counts.get(slot, 0)
    plan = spark.createDataFrame(offsets, "vslot int, shard int, first long, map_version int")
    numbered = rows.withColumn("number", F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")))
    out = numbered.join(F.broadcast(plan), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"), "vslot", "map_version")
    return out, slot_map


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
