"""Access, rank and select over a sequence (pos, symbol)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored

#: Rows of the table of counts by partition and symbol that are broadcast at most.
SMALL = 100_000


def size(seq: DataFrame) -> int:
    return seq.count()


def access(seq: DataFrame, pos: int) -> DataFrame:
    return seq.where(F.col("pos") == pos).select("symbol")


def rank(seq: DataFrame, symbol, pos: int) -> int:
    """Occurrences of a symbol before a position."""
    return seq.where((F.col("symbol") == symbol) & (F.col("pos") < pos)).count()


def rank_all(seq: DataFrame) -> DataFrame:
    """pos, symbol and rank, the number of earlier occurrences of its own symbol, at every position.

    Positions are sorted by range. A rank is the symbol's count in the ranges before plus the rank in its own range, so a
    symbol with a third of all rows is worked on by as many tasks as there are ranges.
    """
    ranges = stored(seq.select("pos", "symbol").repartitionByRange("pos").withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("part", "symbol").agg(F.count("*").alias("n"))
    before = stored(counts.select("part", "symbol", (F.sum("n").over(Window.partitionBy("symbol").orderBy("part")) - F.col("n")).alias("before")), "ranks-before")
    if before.count() <= SMALL:
        before = F.broadcast(before)
    own = F.row_number().over(Window.partitionBy("part", "symbol").orderBy("pos")) - 1
    return ranges.withColumn("own", own).join(before, ["part", "symbol"]).select("pos", "symbol", (F.col("before") + F.col("own")).cast("long").alias("rank"))


def select(seq: DataFrame, k: int) -> DataFrame:
    """symbol and pos of each symbol's k-th occurrence, counted from 1; a symbol with fewer has the sequence's size."""
    if k < 1:
        raise ValueError("occurrences are counted from 1")
    ranked = rank_all(seq)
    found = ranked.groupBy("symbol").agg(F.min(F.when(F.col("rank") == k - 1, F.col("pos"))).alias("pos"))
    return found.withColumn("pos", F.coalesce("pos", F.lit(seq.count()).cast("long")))


def symbols(seq: DataFrame, sigma: int) -> DataFrame:
    """The sequence, checked to be of symbols from 0 to sigma - 1."""
    if sigma < 1:
        raise ValueError("an alphabet has a symbol at least")
    outside = (F.col("symbol") < 0) | (F.col("symbol") >= sigma)
    return seq.withColumn("symbol", F.when(outside, F.raise_error(F.lit("symbol outside of the alphabet"))).otherwise(F.col("symbol")))
