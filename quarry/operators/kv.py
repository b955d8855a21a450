"""Key-value state from a change log (key, seq, op, value): op is ``put`` or ``delete``, seq orders a key's changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stored

#: Changes of a key that one fold takes at most; their results are folded in turn.
FOLD = 10_000
#: Bits for each key and hashes of a Bloom filter.
BITS_PER_KEY, HASHES = 10, 5
#: Keys of a Bloom filter that is sent to all tasks; beyond, the exact join stands alone.
MOST_KEYS = 2_000_000


def latest(log: DataFrame) -> DataFrame:
    """key and value of the newest change of each key; deleted keys are gone. Changes are merged before the shuffle."""
    return compact(log).where("op = 'put'").select("key", "value")


def compact(log: DataFrame) -> DataFrame:
    """The log with the newest change of each key only; deletions stay, as older logs may be merged later.

    Of changes with one seq, a put goes before a deletion and the greater value before the less.
    """
    newest = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return newest.select("key", "x.seq", "x.op", "x.value")


def get(log: DataFrame, *keys) -> DataFrame:
    """key and value of some keys, null for those without one; the filter reaches the log's scan."""
    state = latest(log.where(F.col("key").isin(*keys)))
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], f"key {log.schema['key'].dataType.simpleString()}")
    return asked.join(state, "key", "left")


def scan(log: DataFrame, low, high) -> DataFrame:
    """key and value of the keys from low to high; the filter reaches the log's scan."""
    return latest(log.where(F.col("key").between(low, high)))


def merge_union(log: DataFrame) -> DataFrame:
    """key and the sorted set of all values put; a deletion has no meaning for sets."""
    if not log.where("op = 'delete'").isEmpty():
        raise ValueError("a set union can't take deletions")
    distinct = log.select("key", "value").distinct()
    return distinct.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("value"))


def merge_append(log: DataFrame) -> DataFrame:
    """key and the list of all values put, in order; a deletion adds nothing."""
    listed = log.where("op = 'put'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("x"))
    return listed.select("key", F.transform("x", lambda e: e["value"]).alias("value"))


def merge_sum(log: DataFrame) -> DataFrame:
    return log.where("op = 'put'").groupBy("key").agg(F.sum("value").alias("value"))


def merge(log: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """key and value under any associative rule of (older, newer), each a value or null for a deletion."""
    return folded_log(log, rule).where("op = 'put'").select("key", "value")


def folded_log(log: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """The log with one change for each key, by a rule as in ``merge``; a null result is a deletion.

    Changes are sorted by range of key and seq, so a long history lies over many tasks. Stretches of FOLD rows in that order
    are folded, and their results in turn, until a history fits one fold: no task holds a whole one.
    """

    def folded(rows: DataFrame, *by: str) -> DataFrame:
        kept = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("x"))
        rest = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.element_at("x", 1)["value"], lambda a, e: rule(a, e["value"]))
        return kept.select(*by, F.element_at("x", -1)["seq"].alias("seq"), rest.alias("value"))

    rows = log.select("key", "seq", F.when(F.col("op") == "put", F.col("value")).alias("value"))
    while not rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).isEmpty():
        placed = rows.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq").withColumn("at", F.monotonically_increasing_id())
        placed = stored(placed, "changes")  # places stay what they are if a task is run again
        rows = stored(folded(placed.withColumn("part", F.expr(f"at div {FOLD}")), "key", "part").drop("part"), "folded")
    return folded(rows, "key").select("key", "seq", F.when(F.col("value").isNull(), "delete").otherwise("put").alias("op"), "value")


def _places(column: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, column: str, n: int) -> DataFrame:
    """word and bits of a Bloom filter, 64 bits a row: built by or-ing, so tasks' parts merge before the shuffle."""
    bits = max(64, n * BITS_PER_KEY)
    place = keys.select(F.explode(F.array(*_places(column, bits))).alias("p"))
    return place.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))


def bloom_semi_join(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in ``keys``: most others go by the Bloom filter before the exact semi join shuffles them.

    The filter is one array with a place for each word, so a look-up takes as long with many keys as with few (in a map,
    Spark compares word by word). As a scalar it is a value of the plan, which no row of a join carries along.
    """
    held = keys.select(column).distinct()
    n = held.count()
    if 0 < n <= MOST_KEYS:
        bits = max(64, n * BITS_PER_KEY)
        # One row of at most MOST_KEYS * BITS_PER_KEY bits.
        empty = rows.sparkSession.range(-(-bits // 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = bloom(held, column, n).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        whole = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
        rows = rows.where(reduce(and_, (F.getbit(F.get(whole, (p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _places(column, bits))))
    return rows.join(held, column, "left_semi")
