"""Mixing sources to target sizes by entropy balancing.

Each source has a token constraint: its documents' rates times their sizes add up to the target. Of
all rates that meet the constraints within the cap, those of least entropy relative to taking each
document once are exponential tilts, ``min(cap, exp(tilt * size / mean size))``. The tilts
maximise the convex dual; Newton steps find them, each one a distributed sum over the
documents merged by (source, size), since a rate depends on nothing else. Each source keeps a bracket,
and a step that leaves it is replaced by bisection.

Rates become whole copies: a document gets its rate's whole part, and of the rest those with the
least ``u - fraction`` (u uniform, from a hash of the row) get one more, up to the source's
target. The cut-off is found through bins of that score and, in the one bin where it falls, by sums over ranges of
the sorted rows: neither a bin nor the sources nor a group of repeated rows is ever sorted in one task.
Up to ROUNDS single changes, each by the document whose size is nearest to what is still off, then bring each source near its target:
how near depends on the sizes it has, as documents are taken whole.

Defined cases: null text has size 0; the null source is one of the sources and sorts last; documents
of size 0 get a copy and take no words; repeated rows are each decided on their own, ties in an
arbitrary order that doesn't change the total; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, stored, with_text

#: Weights of the sources in order, and the greatest number of times a document may be taken.
WEIGHTS, CAP = (1, 2, 3), 3
#: Newton steps at most, the relative error that ends them, and the decimals of a tilt and a rate that count.
STEPS, CLOSE, DIGITS = 60, 1e-10, 9
#: Bins of the rounding score.
BINS = 4096
#: Single changes to a source's copies after rounding.
ROUNDS = 4
#: A table of sources is broadcast up to this many rows, and joined by shuffle beyond.
SMALL = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source, the number of words and a hash of the text of every row."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        words, hashes = [len(x.split()) for x in texts], [xxhash.xxh3_64_intdigest(x) >> 1 for x in texts]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "source")), pa.array(words, pa.int64()), pa.array(hashes, pa.int64())], names=["rid", "doc_id", "source", "size", "h"])

    rows = with_text(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text"), "rid", "doc_id", "source")
    return map_batches(rows, count, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long, h long")


def earlier(rows: DataFrame, order: list, values: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``before_<value>``, the sum of each value over the earlier rows of equal ``within`` columns.

    Rows are sorted by range: a sum is that of the ranges before plus that in the row's own range, so no task
    reads more than a range of ``rows``. The table of sums has a row for each range and group of ``within`` that is in it.
    """
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    past = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("part", *within).agg(*(F.sum(v).alias(v) for v in values))
    known = [F.coalesce(F.sum(v).over(past(within, "part")), F.lit(0)).alias(f"_{v}") for v in values]
    sums = stored(sums.select(*(F.col(k).alias(f"_{k}") for k in ("part", *within)), *known), "range-sums")
    same = F.col("part") == F.col("_part")
    for k in within:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = ranges.join(_hint(sums, sums.count()), same)
    own = past(("part", *within), "at")
    return joined.select(*rows.columns, *((F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"_{v}")).alias(f"before_{v}") for v in values))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target: shares by weight, filled up to the cap.

    A source is at its cap if its cap over its weight is below the level that it and the sources with
    larger quotients would share; levels rise along that order, so the first source that isn't ends them.
    """
    placed = earlier(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ("one",))
    weight = F.array(*map(F.lit, weights))[(F.col("before_one") % len(weights)).cast("int")]
    known = placed.select("source", "source_size", "n", weight.cast("double").alias("weight"), (cap * F.col("source_size")).cast("double").alias("most"))
    known = stored(known.withColumn("quotient", F.col("most") / F.col("weight")), "source-weights")
    whole = known.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    known = earlier(known, [F.col("quotient"), F.col("source").asc_nulls_last()], ("most", "weight"))
    level = (F.lit(whole.size) - F.col("before_most")) / (F.lit(whole.weight) - F.col("before_weight"))
    known = stored(known.withColumn("level", level), "source-levels")
    end = known.where("quotient >= level").agg(F.min(F.struct("quotient", "level")).alias("end")).first().end
    target = F.col("most")
    if end is not None:  # else every source is at its cap
        target = F.when(F.col("quotient") < end.quotient, target).otherwise(F.least(F.col("weight") * end.level, target))
    return known.select("source", "source_size", "n", target.alias("target"))


def _hint(few: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(few) if rows <= SMALL else few


def tilts(merged: DataFrame, wanted: DataFrame, rows: int, cap: float = CAP) -> DataFrame:
    """source and tilt: Newton on the logarithm of each source's constraint; a tilt is null where all rates are the cap.

    ``merged`` has source, size, k: the number of documents of that size.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = wanted.select("source", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.when(full, None).otherwise(F.lit(0.0)).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("error"))
    z = F.col("size") / F.col("mean")
    power = F.col("tilt") * z
    under = power < math.log(cap)
    rate = F.when(under, F.exp(power)).otherwise(F.lit(float(cap)))
    for _ in range(STEPS):
        state = stored(state, "tilts")
        if state.where(F.col("tilt").isNotNull() & (F.col("error") > CLOSE)).isEmpty():
            break
        open_ = merged.where("size > 0").join(_hint(state.where(F.col("tilt").isNotNull()).select(F.col("source").alias("of"), "tilt", "mean"), rows), F.col("source").eqNullSafe(F.col("of")))
        sums = open_.groupBy("source").agg(F.sum(F.col("k") * F.col("size") * rate).alias("g"), F.sum(F.when(under, F.col("k") * F.col("size") * z * rate).otherwise(0.0)).alias("d"))
        both = state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        both = both.withColumn("low", F.when(F.col("g") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("g") >= F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        step = F.when((F.col("d") > 0) & (F.col("g") > 0), F.col("tilt") - (F.log("g") - F.log("target")) * F.col("g") / F.col("d"))
        inside = step.isNotNull() & (step > F.coalesce("low", F.lit(float("-inf")))) & (step < F.coalesce("high", F.lit(float("inf"))))
        halved = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        fresh = F.when(inside, step).otherwise(halved)
        error = F.abs(F.col("g") / F.col("target") - 1)
        state = both.select("source", "target", "mean", F.when(F.col("g").isNull() | (error <= CLOSE), F.col("tilt")).otherwise(fresh).alias("tilt"), "low", "high", F.coalesce(error, F.lit(0.0)).alias("error"))
    return state.select("source", F.round("tilt", DIGITS).alias("tilt"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of every row, and rid."""
    rows = stored(sizes(docs), "sizes")
    merged = stored(rows.groupBy("source", "size").agg(F.count("*").alias("k")), "merged-sizes")
    totals = merged.groupBy("source").agg(F.sum(F.col("k") * F.col("size")).alias("source_size"), F.sum("k").alias("n"))
    wanted = stored(targets(totals, weights, cap), "targets")
    few = wanted.count()
    solved = stored(wanted.join(tilts(merged, wanted.where("source_size > 0 AND target > 0"), few, cap).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("solved", F.col("tilt").isNotNull()).drop("of"), "solved")
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).when(~F.col("solved"), F.lit(float(cap)))
    rate = rate.otherwise(F.round(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") * F.col("n") / F.col("source_size"), F.lit(5.0)))), DIGITS))
    u = (F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    keyed = rows.join(_hint(solved.withColumnRenamed("source", "of"), few), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    keyed = keyed.select("rid", "doc_id", "source", "size", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), u)
    keyed = keyed.withColumn("score", F.when((F.col("part") > 0) & (F.col("size") > 0), F.col("u") - F.col("part"))).withColumn("bin", F.floor((F.col("score") + 1) * (BINS // 2)).cast("int"))
    keyed = stored(keyed, "rates")
    # What a source still lacks after the whole parts goes to the least scores.
    lacks = keyed.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("lacks"))
    bins = keyed.where("score IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("held"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("held").over(up), F.lit(0)))
    lacks = lacks.join(bins.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where("before <= lacks AND before + held > lacks")
    cut = stored(lacks.select(F.col("source").alias("of"), F.col("bin").alias("cut"), (F.col("lacks") - F.col("before")).alias("room")), "cuts")
    keyed = keyed.join(_hint(cut, few), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # Without a cut-off the source's score bins all fit.
    edge = F.col("score").isNotNull() & (F.col("bin") == F.col("cut"))
    plain = keyed.where(~F.coalesce(edge, F.lit(False))).withColumn("more", (F.col("score").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))).cast("long"))
    tight = earlier(keyed.where(edge), [F.col("source"), F.col("score"), F.col("size"), F.col("doc_id"), F.col("rid")], ("size",), ("source",))
    tight = tight.withColumn("more", (F.col("before_size") + F.col("size") / 2 <= F.col("room")).cast("long")).drop("before_size")
    copied = plain.unionByName(tight).select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))
    copied = settled(stored(copied, "copies"), few, cap)
    return copied.withColumn("taken", F.col("copies") * F.col("size"))


def settled(copied: DataFrame, few: int, cap: int) -> DataFrame:
    """Each source's copies after up to ROUNDS single changes, each by the document whose size is nearest to what the source is off by."""
    changes = None
    for _ in range(ROUNDS):
        now = copied if changes is None else _changed(copied, changes, few)
        off = stored(now.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off")).withColumnRenamed("source", "of"), "off")
        off = off.where(F.abs("off") >= 1)
        near = now.where("size > 0").join(_hint(off, few), F.col("source").eqNullSafe(F.col("of")))
        way = F.signum("off").cast("long")
        free = F.when(F.col("off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        miss = F.abs(F.col("off") - way * F.col("size"))
        pick = near.where(free & (miss < F.abs("off"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "doc_id", "rid", way.alias("change"))).alias("pick"))
        pick = stored(pick.select(F.col("pick.rid").alias("changed"), F.col("pick.change").alias("change")), "picks")
        if pick.isEmpty():
            break
        changes = pick if changes is None else changes.unionByName(pick)
    return copied if changes is None else _changed(copied, changes, few)


def _changed(copied: DataFrame, changes: DataFrame, few: int) -> DataFrame:
    sums = changes.groupBy("changed").agg(F.sum("change").alias("change"))
    joined = copied.join(_hint(sums, few * ROUNDS), F.col("rid") == F.col("changed"), "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("changed", "change")
