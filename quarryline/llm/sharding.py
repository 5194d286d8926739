"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots. Only the rows and bytes of the slots, a
table of at most ``SLOTS`` rows at any corpus size, are needed to plan: a versioned map says which shard
holds which slot, and growing or rebalancing edits that map without hashing a record again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 8_192
ROW_BYTES = 16


#: A slot with more than this part of a shard's bytes is hot: a repeated or missing id with one text. Its rows are dealt out anew.
HOT_PART = 16


def virtual_slot(*columns: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from a hash of what names it."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot: at most ``SLOTS`` rows, combined before they are shuffled."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def first_map(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Deal the slots out by bytes, largest first, each to the shard that holds least."""
    loads, placed = [(0, shard) for shard in range(shards)], {}
    for slot, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def grown_map(current: dict[int, int], sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Edit a map for more shards: slots leave the fullest old shards and enter only new ones."""
    weight, edited = dict(sizes), dict(current)
    old = max(current.values(), default=-1) + 1
    target = sum(weight.values()) / shards
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(old)]
    for slot, shard in current.items():
        load[shard] += weight.get(slot, 0)
        held[shard].append(slot)
    for slots in held:
        slots.sort(key=lambda s: (weight.get(s, 0), -s))
    for new in range(old, shards):
        givers = [(-load[s], s) for s in range(old) if held[s]]
        heapq.heapify(givers)
        while givers and load[new] < target:
            _, shard = heapq.heappop(givers)
            slot = held[shard].pop()
            size = weight.get(slot, 0)
            if load[new] + size <= target or load[new] == 0:
                edited[slot] = new
                load[new], load[shard] = load[new] + size, load[shard] - size
            if held[shard]:
                heapq.heappush(givers, (-load[shard], shard))
    return edited


def map_table(spark, versions: list[dict[int, int]]) -> DataFrame:
    """The map as a table, one row per version and slot."""
    rows = [(v, slot, shard) for v, placed in enumerate(versions) for slot, shard in sorted(placed.items())]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def shard_documents(docs: DataFrame, stage, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its size, virtual slot, shard, and place within the shard from 0 without gaps.

    The law is ``bytes``: shards hold nearly equal bytes. A slot is a hash of id, text checksum and size, so null ids spread by their
    texts; rows that are equal in all three and too many for one slot spread by their number in the written records. Null texts count 0 bytes;
    repeated rows each get a place. Within a shard rows stand by slot, then by id and text checksum; the count of
    rows before a slot comes from the slot table, so no sort is wider than one slot.

    The map is written with two versions: the first, and its edit for one more shard, which moves whole slots into the new shard
    only. ``rebalanced_shard`` is a record's shard by that edit.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    records = docs.select(
        F.col(f"`{key}`").alias("_key"),
        (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    records = stage(records.withColumn("_n", F.monotonically_increasing_id()), "shard-records")
    records = records.withColumn("virtual_slot", virtual_slot(F.col("_key").cast("string"), F.col("text_crc32"), F.col("size")))
    found = slot_sizes(records).collect()  # at most SLOTS rows
    bound = sum(r["bytes"] for r in found) / shards / HOT_PART
    hot = [r["virtual_slot"] for r in found if r["bytes"] > bound and r["rows"] > HOT_PART]  # fewer than shards times HOT_PART
    if hot:
        again = F.when(F.col("virtual_slot").isin(hot), virtual_slot(F.col("virtual_slot"), F.col("_n"))).otherwise(F.col("virtual_slot"))
        records = stage(records.withColumn("virtual_slot", again), "shard-records")
        found = slot_sizes(records).collect()
    sizes = [(r["virtual_slot"], r["bytes"]) for r in found]
    placed = first_map(sizes, shards)
    rows = {r["virtual_slot"]: r["rows"] for r in found}
    offsets, before = [], [0] * shards
    for slot, shard in sorted(placed.items()):
        offsets.append((slot, before[shard]))
        before[shard] += rows[slot]
    spark = docs.sparkSession
    versions = stage(map_table(spark, [placed, grown_map(placed, sizes, shards + 1)]), "slot-map")
    edited = versions.where("version = 1").select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    plan = versions.where("version = 0").drop("version").join(edited, "virtual_slot").join(spark.createDataFrame(offsets, "virtual_slot int, _before long"), "virtual_slot")
    within = Window.partitionBy("virtual_slot").orderBy("_key", "text_crc32", "size", "_n")
    return (
        records.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(plan), "virtual_slot")  # at most SLOTS rows
        .select(
            F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_before") + F.col("_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "rebalanced_shard",
        )
    )
