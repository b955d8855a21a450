import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import dates, search


def dated(spark, rows):
    listed = [(i, t, date.fromisoformat(b), date.fromisoformat(e) if e else None) for i, (t, b, e) in enumerate(rows)]
    return spark.createDataFrame(listed, "doc_id long, text string, begin_date date, end_date date")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_days():
    assert dates.day_of("1970-01-01") == 0 and dates.day_of("1999-12-31") == 10956
    assert dates.day_of("2020-03-01") == dates.day_of("2020-02-29") + 1
    assert dates.day_of("2019-02-30") == dates.day_of("2019-03-02")
    assert dates.day_of("2018-14-01") == dates.day_of("2019-02-01")
    assert dates.day_of("1969-12-31") % dates.RANGE == dates.OPEN
    assert dates.day_of("9999-12-31") % dates.RANGE == 835744
    assert dates.day_of("2020-1x-5?") == dates.day_of("2020-01-05") == dates.day_of("2020- 1-+5")
    for wrong in ("2020/03/01", "20200301", "", "2020-03-1", "2020-xx-01"):
        with pytest.raises(ValueError):
            dates.day_of(wrong)


LEASES = [("pier", "2019-02-01", "2019-05-31"), ("dock", "2019-05-01", "2019-08-31"), ("quay pier", "2019-10-01", None), ("dock quay", "2020-01-10", "2020-01-10"), ("pier dock", "2019-05-31", "2019-06-01")]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [("CREATED_IN(2019-05-01, 2019-05-31)", [1, 4]), ("CREATED_IN(2020-01-10,2020-01-10)", [3]), ("created_in (2018-01-01, 2018-12-31)", []), ("CREATED_IN(2019-05-31, 2019-05-01)", []),
     ("DATE_RANGE(2019-05-31, 2019-05-31)", [0, 1, 4]), ("date_range(2019-09-01, 2019-09-30)", []), ("DATE_RANGE(2031-01-01, 2031-01-02)", [2]), ("DATE_RANGE(2019-01-01, 2020-12-31)", [0, 1, 2, 3, 4]),
     ("pier AND DATE_RANGE(2019-06-01, 2019-12-31)", [2, 4]), ("quay OR CREATED_IN(2019-02-01, 2019-02-28)", [0, 2, 3]), ("(pier AND dock) AND DATE_RANGE(2019-06-01, 2019-06-01)", [4]),
     ("NOT DATE_RANGE(2019-05-01, 2019-12-31)", [3]), ("pier NOT", [1, 3]), ("()", []), ("", [])],
)
def test_dated_formulas(spark, formula, expected):
    assert ids(search.dated(dated(spark, LEASES), formula)) == expected


def test_created_month_by_month(spark):
    rows = dated(spark, [("x", f"20{y}-{m:02}-17", None) for y in (20, 21) for m in range(1, 13)])
    for first, last, expected in (("2020-11-01", "2021-02-28", [10, 11, 12, 13]), ("2021-12-17", "2021-12-17", [23]), ("2021-12-18", "2030-01-01", [])):
        assert ids(search.dated(rows, f"CREATED_IN({first}, {last})")) == expected


@pytest.mark.parametrize("formula", ["DATE_RANGE(2019-02-01)", "DATE_RANGE(2019-02-01, 2019", "date_range", "DATE_RANGE(2019.02.01, 2019-02-02)"])
def test_dated_errors(spark, formula):
    with pytest.raises(ValueError):
        search.dated(dated(spark, LEASES), formula)


def test_predicates_keep_21_bits(spark):
    days = [dates.day_of(x) for x in ("1969-12-31", "1970-01-01", "2000-06-15", "2024-01-01", "7711-10-21", "7711-10-22", "7711-10-24", "9999-12-31", "0001-01-01")]
    rows = spark.createDataFrame([(i, b, e) for i, b in enumerate(days) for e in [*days, None]], "i long, b long, e long").selectExpr("b", "e", "date_from_unix_date(int(b)) AS begin_date", "date_from_unix_date(int(e)) AS end_date")
    kept = lambda x: x % dates.RANGE
    for low, high in ((0, 20000), (11000, 12000), (835000, 836000), (-1, 5), (dates.OPEN - 1, dates.OPEN + 3), (5, 2)):
        made = {(r.b, r.e) for r in rows.where(dates.created_in(low, high)).collect()}
        assert made == {(b, e) for b in days for e in [*days, None] if kept(low) <= kept(b) <= kept(high)}
        valid = {(r.b, r.e) for r in rows.where(dates.valid_in(low, high)).collect()}
        assert valid == {(b, e) for b in days for e in [*days, None] if kept(b) <= kept(high) and (dates.OPEN if e is None else kept(e)) >= kept(low)}


def test_dates_reach_the_scan(spark, tmp_path):
    dated(spark, [("a", "2024-01-01", None)]).write.parquet(str(tmp_path / "d"))
    plan = spark.read.parquet(str(tmp_path / "d")).where(dates.created_in(10, 20))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(begin_date" in plan.split("PushedFilters")[1]


def test_interval_join_finds_each_overlap_once(spark):
    rng = random.Random(3)
    rows = [(i, a, a + rng.choice([-1, 0, 3, 100, 5000])) for i in range(60) for a in [rng.randrange(300)]] + [(60, 10, dates.OPEN)]
    ranges = [(i, a, a + rng.choice([0, 10, 200])) for i in range(20) for a in [rng.randrange(400)]] + [(20, 5, dates.OPEN), (21, 9, 2)]
    found = dates.interval_join(spark.createDataFrame(rows, "k long, lo long, hi long"), spark.createDataFrame(ranges, "range_id long, lo long, hi long"), "k").collect()
    expected = sorted((k, r) for k, a, b in rows for r, c, d in ranges if a <= b and c <= d and a <= d and b >= c)
    assert sorted((r.k, r.range_id) for r in found) == expected


def test_interval_counts_are_those_of_the_join(spark):
    rng = random.Random(4)
    rows = [(i if i % 7 else None, a, a + rng.choice([-1, 0, 3, 100, 5000])) for i in range(80) for a in [rng.randrange(-50, 3000)]] + [(2**62, day, day) for day in (3000, 3300, 3600)] + [(5, 10, dates.OPEN)]  # more than a long up to a day, not in a range
    ranges = [(i // 2, a, a + rng.choice([0, 1, 10, 200])) for i in range(40) for a in [rng.randrange(-80, 3500)]] + [(30, 5, 6), (31, 9, 2), (32, -90, -85)]
    found = dates.interval_counts(spark.createDataFrame(rows, "k long, lo long, hi long"), spark.createDataFrame(ranges, "range_id long, lo long, hi long"), "k").collect()
    expected = {}
    for r, c, d in ranges:
        for k, a, b in rows:
            if a <= b and c <= d and a <= d and b >= c:
                expected.setdefault(r, []).append(k)
    sums = {r: (len(ks), sum(k for k in ks if k is not None) if any(k is not None for k in ks) else None) for r, ks in expected.items()}
    assert {r.range_id: (r.n, r["keys"]) for r in found} == sums


def test_interval_counts_make_no_pairs(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("id AS k", "id % 10 AS lo", f"{dates.OPEN} AS hi")
    ranges = spark.range(n).selectExpr("id AS range_id", "5L AS lo", "6L AS hi")
    found = dates.interval_counts(rows, ranges, "k")
    assert found.where(f"n = {n * 7 // 10}").count() == n  # 28 thousand million pairs


def test_slices_rebuild_the_value(spark):
    values = [(i, dates.day_of("2024-01-01") + timedelta(days=i).days) for i in range(10)]
    rows = dates.slices(spark.createDataFrame(values, "k long, v long"), "k", "v").groupBy("k").agg(F.sum(F.expr("shiftleft(1L, slice)")).alias("v")).collect()
    assert {r.k: r.v for r in rows} == dict(values)
