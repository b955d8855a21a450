"""Sets of ids: algebra on rows, and compressed bitmaps by bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import numbered
from quarry.session import ship

#: Fixed value: bytes in a bitmap, as Spark builds them.
BYTES = 4096


def build(rows: DataFrame, *keys: str, column: str = "id") -> DataFrame:
    """A bitmap for each key and bucket; positions repeat from bucket to bucket, so a bitmap without its bucket means nothing."""
    return rows.groupBy(*keys, F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def cardinality(bitmaps: DataFrame, *keys: str) -> DataFrame:
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def unite(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """One bitmap for each key and bucket from several."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def combine(a: DataFrame, b: DataFrame, how: str, *keys: str) -> DataFrame:
    """keys, bucket and bits of two tables of bitmaps, by bucket: ``and``, ``or``, ``xor`` or ``and not``. Empty ones are left out.

    A bucket that one side lacks is empty there, so only ``and`` may drop it before the join.
    """
    kind = {"and": "inner", "or": "full", "xor": "full", "and not": "left"}[how]
    ship(a.sparkSession)

    @F.arrow_udf("binary")
    def merged(x: pa.Array, y: pa.Array) -> pa.Array:
        none = bytes(BYTES)
        left, right = (np.frombuffer(b"".join(v or none for v in side.to_pylist()), np.uint8).reshape(-1, BYTES) for side in (x, y))
        out = {"and": left & right, "or": left | right, "xor": left ^ right, "and not": left & ~right}[how]
        return pa.array([row.tobytes() for row in out], pa.binary())

    both = a.select(*keys, "bucket", F.col("bits").alias("a")).join(b.select(*keys, "bucket", F.col("bits").alias("b")), [*keys, "bucket"], kind)
    return both.select(*keys, "bucket", merged("a", "b").alias("bits")).where(F.bitmap_count("bits") > 0)


def members(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """keys and id of every member: the reverse of ``build``."""
    ship(bitmaps.sparkSession)

    @F.arrow_udf("array<int>")
    def places(bits: pa.Array) -> pa.Array:
        held = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).astype(np.int32) for x in bits.to_pylist()]
        return pa.array(held, pa.list_(pa.int32()))

    size = BYTES * 8
    # Positive ids start at the first bit of bucket 1; the others count down from 0.
    value = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * size + F.col("at") + 1).otherwise(F.col("bucket") * size - F.col("at"))
    return bitmaps.select(*keys, "bucket", F.explode(places("bits")).alias("at")).select(*keys, value.cast("long").alias("id"))


def save(bitmaps: DataFrame, path: str) -> None:
    """Store bitmaps by bucket, so that a range of ids reads its row groups only."""
    bitmaps.repartitionByRange("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionByName(b.select("id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in one of the sets only: one aggregation over both."""
    return _sides(a, b).where(F.col("a") != F.col("b")).select("id")


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cardinalities of and, or, and-not and xor, the Jaccard index, and whether a is a subset, a strict one, equal, or meets b."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    a1, b1 = F.col("a") == 1, F.col("b") == 1
    sums = _sides(a, b).agg(n(a1 & b1).alias("and_n"), n(a1 | b1).alias("or_n"), n(a1 & ~b1).alias("andnot_n"), n(~a1 & b1).alias("rest_n"))
    return sums.select(
        "and_n",
        "or_n",
        "andnot_n",
        (F.col("andnot_n") + F.col("rest_n")).alias("xor_n"),
        F.round(F.when(F.col("or_n") > 0, F.col("and_n") / F.col("or_n")), 6).alias("jaccard"),
        (F.col("andnot_n") == 0).alias("subset"),
        ((F.col("andnot_n") == 0) & (F.col("rest_n") > 0)).alias("strict_subset"),
        ((F.col("andnot_n") == 0) & (F.col("rest_n") == 0)).alias("equal"),
        (F.col("and_n") > 0).alias("intersect"),
    )


def flip(ids: DataFrame, low: int, high: int) -> DataFrame:
    """Ids outside [low, high) as they are, and those inside that weren't there."""
    inside = F.col("id").between(low, high - 1)
    return ids.where(~inside).select("id").unionByName(ids.sparkSession.range(low, high).join(ids.where(inside), "id", "left_anti").select("id"))


def ranked(ids: DataFrame) -> DataFrame:
    """id and its place in order, from 0: place + 1 is the rank, and the id at a place is what select gives."""
    return numbered(ids.select("id").distinct(), "id", "place")


def rank(ids: DataFrame, value: int) -> Column:
    """Members up to a value, the value included."""
    return ids.where(F.col("id") <= value).agg(F.count_distinct("id").alias("rank"))


def contains_range(ids: DataFrame, low: int, high: int) -> DataFrame:
    """One row: whether all ids from low to high - 1 are there."""
    return ids.where(F.col("id").between(low, high - 1)).agg((F.count_distinct("id") == max(high - low, 0)).alias("contains"))


def remove_range(ids: DataFrame, low: int, high: int) -> DataFrame:
    return ids.where(~F.col("id").between(low, high - 1))


def add_range(ids: DataFrame, low: int, high: int) -> DataFrame:
    return ids.select("id").unionByName(ids.sparkSession.range(low, high)).distinct()


def index_of(ids: DataFrame, value: int) -> DataFrame:
    """One row: a member's place in order from 0, or -1."""
    upto = ids.where(F.col("id") <= value).select("id").distinct()
    return upto.agg(F.when(F.max("id") == value, F.count("*") - 1).otherwise(F.lit(-1)).alias("place"))


def select_at(ids: DataFrame, place: int) -> DataFrame:
    """The member at a place in order from 0."""
    return page(ids, place, 1)


def page(ids: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the ids in order."""
    return ids.select("id").distinct().orderBy("id").offset(offset).limit(limit)
