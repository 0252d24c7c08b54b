"""Sharding through a fixed number of virtual slots.

Every record is hashed into one of ``slots`` virtual slots, which never change.
Rows and bytes are aggregated per slot, and a table maps slots to shards: the
heaviest slot goes first, to the lightest shard. The map is stored with a
version. When shards are added or sizes drift, ``rebalance`` edits the map: it
moves as few slots as it needs and leaves every other record where it is.

The map has ``slots`` rows whatever the corpus, so it is planned on the driver
and broadcast. A record's place in its shard is the number of rows in the slots
of that shard before its own plus its row number in its slot, so no window is
larger than one slot.

Defined results for odd input: a null text has no bytes and a null checksum;
null ids are hashed with the text, so they spread; rows that are alike in id, size
and checksum are counted and dealt to slots in turn, from the one of their hash
on, so that any number of them spreads evenly; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

SLOTS = 4096


@dataclass
class SlotMap:
    """A version of the map: shard and place of the first row for each slot in use."""

    version: int
    shards: int
    shard_of: dict[int, int]
    bytes_of: dict[int, int]
    rows_of: dict[int, int] = field(default_factory=dict)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in self.shard_of.items():
            out[shard] += self.bytes_of.get(slot, 0)
        return out

    def offsets(self) -> dict[int, int]:
        """Rows of the same shard that lie in smaller slots."""
        so_far, out = [0] * self.shards, {}
        for slot in sorted(self.shard_of):
            shard = self.shard_of[slot]
            out[slot] = so_far[shard]
            so_far[shard] += self.rows_of.get(slot, 0)
        return out


#: Equal rows that one task deals out.
_ALIKE = 65_536


def with_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot): a narrow row for each record.

    Records that these columns don't tell apart are shuffled as one row with
    their number, which is written once.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    alike = materialise(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("alike")), "shard-records")
    many = alike.filter(F.col("alike") > _ALIKE)
    part = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / _ALIKE))).alias("part"))
    last = F.least(F.col("alike"), (F.col("part") + 1) * _ALIKE) - 1
    spread = part.repartition("doc_id", "text_crc32", "part").select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("part") * _ALIKE, last)).alias("copy"))
    few = alike.filter(F.col("alike") <= _ALIKE).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)).alias("copy"))
    vslot = F.pmod(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)) + F.col("copy"), F.lit(slots)).cast("int")
    return few.union(spread).select("doc_id", "size", "text_crc32", vslot.alias("vslot"))


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most as many rows as there are slots."""
    rows = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r.vslot: (r.bytes, r.rows) for r in rows}


def plan_map(sizes: dict[int, tuple[int, int]], shards: int) -> SlotMap:
    """Version 1: the heaviest slot first, to the lightest shard."""
    loads = [(0, shard) for shard in range(shards)]
    shard_of = {}
    for slot, (size, _) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        load, shard = heapq.heappop(loads)
        shard_of[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return SlotMap(1, shards, shard_of, {s: b for s, (b, _) in sizes.items()}, {s: n for s, (_, n) in sizes.items()})


def rebalance(old: SlotMap, sizes: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.02) -> SlotMap:
    """The next version for new sizes or more shards.

    Slots keep their shard unless that shard is gone or holds more than its fair
    share plus ``tolerance``. Such a shard gives slots to the lightest one that
    gives none, as long as that lowers the larger of the two loads and leaves the
    giver its fair share less ``tolerance``.
    """
    new = SlotMap(old.version + 1, shards, {}, {s: b for s, (b, _) in sizes.items()}, {s: n for s, (_, n) in sizes.items()})
    homeless = []
    for slot in sizes:
        shard = old.shard_of.get(slot, -1)
        if 0 <= shard < shards:
            new.shard_of[slot] = shard
        else:
            homeless.append(slot)
    loads = new.loads()
    for slot in sorted(homeless, key=lambda s: (-sizes[s][0], s)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        new.shard_of[slot] = shard
        loads[shard] += sizes[slot][0]
    fair, gave = sum(loads) / shards, set()
    for giver in range(shards):
        for slot in sorted((s for s, h in new.shard_of.items() if h == giver), key=lambda s: (-sizes[s][0], s)):
            size = sizes[slot][0]
            if loads[giver] <= (1 + tolerance) * fair or len(gave | {giver}) == shards:
                break
            taker = min((s for s in range(shards) if s != giver and s not in gave), key=lambda s: (loads[s], s))
            if size <= loads[giver] - (1 - tolerance) * fair and loads[taker] + size < loads[giver]:
                gave.add(giver)
                new.shard_of[slot] = taker
                loads[giver] -= size
                loads[taker] += size
    return new


MAP_SCHEMA = "version int, shards int, vslot int, shard int, first long, bytes long, rows long"


def map_frame(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    first = slot_map.offsets()
    rows = [
        (slot_map.version, slot_map.shards, s, h, first[s], slot_map.bytes_of.get(s, 0), slot_map.rows_of.get(s, 0))
        for s, h in sorted(slot_map.shard_of.items())
    ]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds a version to the table of maps at ``path``; older versions stay readable."""
    map_frame(spark, slot_map).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """One version of the stored map, the latest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).collect()
    return SlotMap(
        version, rows[0].shards, {r.vslot: r.shard for r in rows}, {r.vslot: r.bytes for r in rows}, {r.vslot: r.rows for r in rows}
    )


def place(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds ``shard`` and ``slot``, the place in the shard, to ``with_slots`` rows.

    The map is broadcast: its size is bounded by the number of slots.
    """
    lookup = map_frame(records.sparkSession, slot_map).select("vslot", "shard", "first", F.col("version").alias("map_version"))
    in_slot = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.join(F.broadcast(lookup), "vslot")
        .withColumn("slot", (F.col("first") + in_slot - 1).cast("long"))
        .drop("first")
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """All records in shards of near equal bytes, through a map stored at ``map_path`` if given."""
    records = with_slots(docs, slots)
    slot_map = plan_map(slot_sizes(records), shards)
    if map_path and slot_map.shard_of:
        write_map(docs.sparkSession, slot_map, map_path)
    return place(records, slot_map)
