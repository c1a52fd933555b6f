"""Fixed virtual slots: records hash into slots, and a versioned map places slots on shards.

Rows with a null text have no bytes and size 1. Rows with a null doc_id hash by their text alone. Identical rows share a
slot and get successive positions, in any order, as nothing tells them apart; one task numbers them, 24 bytes a row. The law is
`bytes`: equal texts of other documents may go to other shards, so it keeps no groups of copies together. An empty table gives an empty result;
columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.llm.store import materialise, new_path

#: Virtual slots; fixed for the life of a data set, so the slot table never grows with the data.
SLOTS = 4096

#: slot -> (shard, bytes, rows); at most SLOTS entries.
SlotMap = dict[int, tuple[int, int, int]]


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row, written once so that the texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("vslot"),
    )
    return materialise(rows, "slotted")


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows); at most one entry a slot, so its size is bounded by SLOTS."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [(r.vslot, r.b, r.n) for r in sums.collect()]


def first_map(sums: list[tuple[int, int, int]], shards: int) -> SlotMap:
    """Place the heaviest slot first, always on the lightest shard: bytes end near equal."""
    loads = [(0, s) for s in range(shards)]
    out: SlotMap = {}
    for vslot, b, n in sorted(sums, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[vslot] = (shard, b, n)
        heapq.heappush(loads, (load + b, shard))
    return out


def edit_map(old: SlotMap, shards: int) -> SlotMap:
    """The next version for a number of shards; slots move only where they must or where that evens out bytes.

    More shards: slots move from overfull shards to new ones only. Fewer: the slots of shards that go are dealt to the lightest of
    the others, all else stays. As many: slots move from overfull shards to the lightest.
    """
    had = max((s for s, _, _ in old.values()), default=-1) + 1
    share = sum(b for _, b, _ in old.values()) / shards
    loads = [0] * shards
    for shard, b, _ in old.values():
        if shard < shards:
            loads[shard] += b
    out, heaviest_first = dict(old), sorted(old.items(), key=lambda x: (-x[1][1], x[0]))
    for vslot, (shard, b, n) in heaviest_first:
        if shard >= shards:
            to = min(range(shards), key=lambda s: loads[s])
            loads[to] += b
            out[vslot] = (to, b, n)
    targets = range(had, shards) if had < shards else range(shards)
    for vslot, (shard, b, n) in heaviest_first:
        to = min(targets, key=lambda s: loads[s])
        if had <= shards and to != shard and loads[shard] > share and loads[to] + b <= share + b / 2:
            loads[shard] -= b
            loads[to] += b
            out[vslot] = (to, b, n)
    return out


def map_table(spark: SparkSession, slot_map: SlotMap, version: int) -> DataFrame:
    """The map as a table: version, vslot, shard, bytes, rows, and the slot's first position in its shard."""
    at: dict[int, int] = {}
    rows = []
    for vslot, (shard, b, n) in sorted(slot_map.items()):
        rows.append((version, vslot, shard, b, n, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    return spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long, first long")


def save_map(table: DataFrame, path: str) -> None:
    """Append a version to the stored maps; earlier versions stay readable."""
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, SlotMap]:
    """A version of the stored map, by default the newest."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.where(F.col("version") == version).collect()
    return version, {r.vslot: (r.shard, r.bytes, r.rows) for r in rows}


def place(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Shard and gapless position in it for each slotted row; work is dealt by slot, not by shard."""
    order = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(table.select("vslot", "shard", "first")), "vslot")
        .withColumn("slot", F.col("first") + F.col("nth"))
    )


def stored_version(spark: SparkSession, slot_map: SlotMap, version: int, path: str) -> SlotMap:
    """Store a version of the map and read it back; what is read is what places rows."""
    save_map(map_table(spark, slot_map, version), path)
    return load_map(spark, path, version)[1] if slot_map else {}


def shard(docs: DataFrame, shards: int = 16, grown: int | None = None, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All rows of docs on shards of near equal bytes, by version 1 of a map stored at path (a fresh folder if None).

    With grown, the map is then edited to so many shards as version 2, and next_shard is the row's shard by that.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-maps")
    rows = slotted(docs, slots)
    first = stored_version(spark, first_map(slot_sums(rows), shards), 1, path)
    placed = place(rows, map_table(spark, first, 1))
    if grown is None:
        return placed
    after = map_table(spark, stored_version(spark, edit_map(first, grown), 2, path), 2)
    return placed.join(F.broadcast(after.select("vslot", F.col("shard").alias("next_shard"))), "vslot")
