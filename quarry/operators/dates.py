"""Dates as days in 21 bits, and predicates over validity intervals and creation dates."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that are kept and compared, and the day that stands for an open end.
BITS = 21
RANGE = 1 << BITS
OPEN = RANGE - 1
_NUMBER = re.compile(r"[ \t-\r]*([+-]?[0-9]+)")


def day_of(text: str) -> int:
    """Days since 1970-01-01 of ``YYYY-MM-DD``; months and days beyond their range run over into the next, and of each part what follows its number is ignored."""
    if len(text) != 10 or text[4] != "-" or text[7] != "-":
        raise ValueError(f"not a date: {text!r}")
    numbers = [_NUMBER.match(part) for part in (text[:4], text[5:7], text[8:])]
    if None in numbers:
        raise ValueError(f"not a date: {text!r}")
    year, month, day = (int(m[1]) for m in numbers)
    years, month = divmod(month - 1, 12)
    return (date(year + years, month + 1, 1) + timedelta(days=day - 1) - date(1970, 1, 1)).days


def day(column: str | Column) -> Column:
    """The kept bits of a date's day."""
    return F.pmod(F.unix_date(F.to_date(column)), F.lit(RANGE)).cast("long")


def end_day(column: str | Column) -> Column:
    return F.coalesce(day(column), F.lit(OPEN).cast("long"))


def bit(value: Column, i: int) -> Column:
    return F.getbit(value, F.lit(i)).cast("int")


def slices(rows: DataFrame, key: str, value: str) -> DataFrame:
    """slice and key for every bit that is set: the bit-sliced form of a column."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.col(value), i) == 1)
    return rows.select(key, F.explode(bits).alias("slice"))


def at_least(value: Column, low: int) -> Column:
    return value >= low % RANGE


def at_most(value: Column, high: int) -> Column:
    return value <= high % RANGE


def within(value: Column, low: int, high: int) -> Column:
    return at_least(value, low) & at_most(value, high)


def _plain(column: str, low: int | None = None, high: int | None = None) -> Column:
    """A wider condition on the date itself, which reaches the scan: days that the kept bits change pass in any case."""
    bounds = ((low, F.col(column).__ge__), (high, F.col(column).__le__))
    inside = [compare(F.date_from_unix_date(F.lit(x))) for x, compare in bounds if x is not None and 0 <= x < OPEN]
    if not inside:
        return F.lit(True)
    first, last = F.date_from_unix_date(F.lit(0)), F.date_from_unix_date(F.lit(OPEN))
    held = inside[0] if len(inside) == 1 else inside[0] & inside[1]
    return held | (F.col(column) < first) | (F.col(column) >= last)


def valid_in(low: int, high: int, begin: str = "begin_date", end: str = "end_date") -> Column:
    """The closed interval overlaps [low, high]; neither is checked to be in order."""
    return _plain(begin, high=high) & at_most(day(begin), high) & (F.col(end).isNull() | _plain(end, low=low)) & at_least(end_day(end), low)


def created_in(low: int, high: int, begin: str = "begin_date", end: str = "end_date") -> Column:
    return _plain(begin, low, high) & within(day(begin), low, high)


def interval_join(rows: DataFrame, ranges: DataFrame, key: str, width: int = 64) -> DataFrame:
    """key and range_id of all overlaps of closed day intervals: ``rows`` (key, lo, hi), ``ranges`` (range_id, lo, hi).

    The end points fall in buckets of ``width`` days. A pair overlaps exactly if the later of the two begins lies in both,
    and is found in that begin's bucket alone: by an equi-join and without duplicates. Open ends would fill very many
    buckets, so each side's begins are joined with the other's spans, cut to the days that begins cover.
    """
    last = F.broadcast(rows.agg(F.max("lo").alias("a")).crossJoin(ranges.agg(F.max("lo").alias("b"))).select(F.greatest("a", "b").alias("last")))  # one row

    def spans(df: DataFrame) -> DataFrame:
        held = df.where("lo <= hi").crossJoin(last)
        return held.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"greatest(lo, least(hi, last)) div {width}")))).drop("last")

    def begins(df: DataFrame) -> DataFrame:
        return df.where("lo <= hi").withColumn("bucket", F.expr(f"lo div {width}"))

    a, b = begins(rows).alias("a"), spans(ranges).alias("b")
    rows_later = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.lo").between(F.col("b.lo"), F.col("b.hi"))).select(f"a.{key}", "b.range_id")
    c, d = spans(rows).alias("c"), begins(ranges).alias("d")
    ranges_later = c.join(d, (F.col("c.bucket") == F.col("d.bucket")) & F.col("d.lo").between(F.col("c.lo"), F.col("c.hi")) & (F.col("d.lo") > F.col("c.lo"))).select(f"c.{key}", "d.range_id")
    return rows_later.unionByName(ranges_later)


def interval_counts(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """range_id, n and keys: how many rows of ``interval_join`` each range has, and the sum of their keys; ranges without any are left out.

    No pair is made: of the rows that begin by the range's end, all overlap it but those that end before its begin. Both are
    sums up to a day, and there are at most as many days as BITS tells apart, so pairs may be many and sums stay few.
    """
    held, asked = rows.where("lo <= hi"), ranges.where("lo <= hi")
    # Sums of keys are decimals: up to a day they can exceed a long where no range's sum does.
    sums = (F.count("*").alias("n"), F.count(key).alias("named"), F.sum(F.col(key).cast("decimal(20,0)")).alias("keys"))
    begins = _up_to(held.groupBy(F.col("lo").alias("day")).agg(*sums), asked.select(F.col("hi").alias("day")))
    ends = _up_to(held.groupBy((F.col("hi") + 1).alias("day")).agg(*sums), asked.select(F.col("lo").alias("day")))
    found = asked.join(begins, asked["hi"] == begins["day"]).join(ends, asked["lo"] == ends["day"])
    own = found.select("range_id", *((begins[c] - ends[c]).alias(c) for c in ("n", "named", "keys"))).where("n > 0")
    total = own.groupBy("range_id").agg(F.sum("n").alias("n"), F.sum("named").alias("named"), F.sum("keys").alias("keys"))
    return total.select("range_id", "n", F.when(F.col("named") > 0, F.col("keys")).cast("long").alias("keys"))


def _up_to(sums: DataFrame, days: DataFrame, width: int = 1024) -> DataFrame:
    """day, n, named and keys: for each of ``days`` the sums of all days up to it, itself included.

    Days are summed within stretches of ``width`` days, and stretches, of which there are few, over one another.
    """
    names, bucket = ("n", "named", "keys"), F.expr(f"day div {width}").alias("bucket")
    asked = days.distinct().select("day", *(F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in names), F.lit(True).alias("asked"))
    both = sums.withColumn("asked", F.lit(False)).unionByName(asked).select("*", bucket)
    both = both.groupBy("bucket", "day").agg(*(F.sum(c).alias(c) for c in names), F.bool_or("asked").alias("asked"))
    here = Window.partitionBy("bucket").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = both.select("bucket", "day", "asked", *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(c) for c in names)).where("asked")
    # A row for each stretch: at most RANGE / width.
    stretches = both.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names))
    return local.join(stretches, "bucket").select("day", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in names))
