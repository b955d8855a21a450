"""Sharding by fixed virtual slots.

A record's key hashes into one of a fixed number of virtual slots. Bytes are added up by slot, and a stored,
versioned map says which shard holds each slot. Shards are balanced by editing the map alone: a new version is stored, and a
record moves only when its slot does. Everything here is DataFrame functions: the records are
shuffled once, without their texts, by slot; what reaches the driver is one row a slot.

A slot that holds a multiple of the mean, as a hot key makes it, gets extra slots of its own after the fixed ones, and its rows are dealt
over them by their place in the task, so no shard and no task is bound to hold a hot key whole. To find a record of such a key, all
its extra slots are asked; ``first`` and ``many`` of the map say which.

Defined cases: null text has no bytes and the checksum of the empty string; null ids hash like any
value, together with the text's checksum, so that rows without an id still spread; repeated rows get different places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import shared_folder, stored

#: Virtual slots: far more than shards, and few enough for one driver-side row each.
SLOTS = 8192
#: Bytes a record takes besides its text.
OVERHEAD = 16
#: Mean loads from which a slot's rows are dealt over extra slots.
WIDE = 4


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the slot-to-shard map: ``shards[slot]`` is the shard of a slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())
    #: Of each fixed slot, how many extra slots its rows are dealt over; none but of hot ones.
    many: tuple[int, ...] = field(default=())

    @property
    def first(self) -> tuple[int, ...]:
        """Of each fixed slot, its first extra slot."""
        return tuple(len(self.many) + x for x in accumulate(self.many, initial=0))[:-1]

    @classmethod
    def balanced(cls, loads: dict[int, int], n_shards: int, slots: int = SLOTS, many: tuple[int, ...] = ()) -> SlotMap:
        """Heaviest slot first, each to the shard that holds the fewest bytes; empty slots are dealt round."""
        heap = [(0, shard) for shard in range(n_shards)]
        shards = [slot % n_shards for slot in range(slots)]
        for load, slot in sorted(((load, slot) for slot, load in loads.items()), key=lambda x: (-x[0], x[1])):
            held, shard = heap[0]
            shards[slot] = shard
            heapq.heapreplace(heap, (held + load, shard))
        return cls(1, n_shards, tuple(shards), (), many)

    def rebalanced(self, loads: dict[int, int], n_shards: int, slack: float = 0.02) -> SlotMap:
        """The next version: slots leave the fullest shards, largest that fits first, until all are within ``slack`` of the mean."""
        held = [0] * n_shards
        of: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
        shards = list(self.shards)
        for slot, shard in enumerate(shards):
            if shard >= n_shards:  # its shard is gone
                shard = shards[slot] = min(range(n_shards), key=held.__getitem__)
            held[shard] += loads.get(slot, 0)
            of[shard].append((loads.get(slot, 0), slot))
        mean = sum(held) / n_shards
        for source in sorted(range(n_shards), key=lambda s: -held[s]):
            for load, slot in sorted(of[source], reverse=True):
                if held[source] <= mean * (1 + slack):
                    break
                target = min(range(n_shards), key=held.__getitem__)
                if load and held[source] - load >= mean * (1 - slack) and held[target] + load <= mean * (1 + slack):
                    shards[slot] = target
                    held[source] -= load
                    held[target] += load
        return SlotMap(self.version + 1, n_shards, tuple(shards), tuple(s for s, (a, b) in enumerate(zip(self.shards, shards, strict=True)) if a != b), self.many)

    def widened(self, loads: dict[int, int], many: tuple[int, ...]) -> SlotMap:
        """The next version for other extra slots: fixed slots stay where they are, extra ones go to the shards with the fewest bytes."""
        fixed = len(many)
        held = [0] * self.n_shards
        for slot in range(fixed):
            held[self.shards[slot]] += loads.get(slot, 0)
        extra = []
        for slot in range(fixed, fixed + sum(many)):
            to = min(range(self.n_shards), key=held.__getitem__)
            held[to] += loads.get(slot, 0)
            extra.append(to)
        return SlotMap(self.version + 1, self.n_shards, (*self.shards[:fixed], *extra), (), many)

    def shard_of(self, slot: Column) -> Column:
        """The map as one constant array: a lookup without a join."""
        return F.split(F.lit(",".join(map(str, self.shards))), ",").cast("array<int>")[slot]

    def table(self, spark: SparkSession) -> DataFrame:
        shards = F.split(F.lit(",".join(map(str, self.shards))), ",").cast("array<int>")
        many = _array(self.many) if self.many else F.array().cast("array<int>")
        rows = spark.range(1).select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), many.alias("all"), F.posexplode(shards).alias("virtual_slot", "shard"))
        return rows.select("version", "n_shards", "virtual_slot", "shard", F.try_element_at("all", F.col("virtual_slot") + 1).alias("many"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version; earlier versions stay readable."""
        self.table(spark).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        kept = spark.read.parquet(path)
        version = kept.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(kept.where(F.col("version") == version).select("virtual_slot", "shard", "n_shards", "many").collect(), key=lambda r: r.virtual_slot)
        return cls(version, rows[0].n_shards, tuple(r.shard for r in rows), (), tuple(r.many for r in rows if r.many is not None))

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _array(values: Sequence[int], kind: str = "int") -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def placed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), crc.alias("text_crc32")).select("*", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes by slot; at most one row a slot comes to the driver."""
    return {r.virtual_slot: (r.rows, r.bytes) for r in records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}


def hot_slots(loads: dict[int, tuple[int, int]], slots: int) -> tuple[int, ...]:
    """Over how many extra slots each slot's rows are dealt: 0, or for one beyond WIDE times the mean as many as bring it to the mean."""
    mean = max(sum(size for _, size in loads.values()) / slots, 1)
    return tuple(-(-size // int(mean + 1)) if rows > 1 and size > WIDE * mean else 0 for rows, size in (loads.get(s, (0, 0)) for s in range(slots)))


def spread(records: DataFrame, many: Sequence[int]) -> DataFrame:
    """The records with the extra slots of hot ones."""
    if not any(many):
        return records
    first = [len(many) + x for x in accumulate(many, initial=0)][:-1]
    n = _array(many)[F.col("virtual_slot")]
    extra = _array(first)[F.col("virtual_slot")] + F.pmod(F.col("at"), n).cast("int")
    return records.withColumn("virtual_slot", F.when(n > 0, extra).otherwise(F.col("virtual_slot")))


def shard(docs: DataFrame, n_shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard and its gapless place there, by the newest map stored at ``path``.

    Without a map there, the first version is stored; one whose shards are no longer even is edited, and the next version stored. The
    place is the number of records in the shard's earlier slots, a constant by slot, plus the
    record's rank in its slot; no window covers more than one slot.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/quarry/slot-map-{uuid.uuid4().hex}"
    records = stored(placed(docs, slots).withColumn("at", F.monotonically_increasing_id()), "placed")
    many = hot_slots(slot_loads(records), slots)
    records = spread(records, many)
    loads = slot_loads(records)
    sizes = {slot: size for slot, (_, size) in loads.items()}
    if SlotMap.stored(spark, path):
        chart = SlotMap.load(spark, path)
        edited = chart if chart.many == many else chart.widened(sizes, many)
        again = edited.rebalanced(sizes, n_shards)
        if again.moved or n_shards != chart.n_shards or edited is not chart:
            replace(again, version=chart.version + 1).save(spark, path)
    else:
        SlotMap.balanced(sizes, n_shards, slots + sum(many), many).save(spark, path)
    chart = SlotMap.load(spark, path)
    before, held = [0] * len(chart.shards), [0] * n_shards
    for slot, to in enumerate(chart.shards):
        before[slot] = held[to]
        held[to] += loads.get(slot, (0, 0))[0]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "at"))
    return records.select("*", rank.cast("long").alias("rank")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        chart.shard_of(F.col("virtual_slot")).alias("shard"),
        (_array(before, "bigint")[F.col("virtual_slot")] + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(chart.version).alias("map_version"),
    )
