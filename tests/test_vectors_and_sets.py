import random

import numpy as np
import pytest

from quarry.operators import bitmap, knn, sequence


def points(spark, rows, first=0):
    return spark.createDataFrame([(first + i, list(map(float, r))) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize(
    ("data", "query", "expected"),
    [([(2, 2), (-6, 8)], (1, 3), 0), ([(2, 2), (-6, 8)], (-5, 5), 1), ([(9, 4), (0, 1), (6, 6)], (0, 1), 1), ([(2,), (8,), (30,), (5,)], (6.2,), 3), ([(2,), (8,), (30,), (5,)], (100,), 2),
     ([(1, 2, 3), (4, 4, 4), (-3, 0, 3)], (3.5, 3, 4), 1), ([(i * i, -i) for i in range(60)], (900.4, -30.2), 30), ([(0, 7), (7, 0), (0, -7)], (0, 0), 0)],
)
def test_nearest(spark, data, query, expected):
    found = knn.nearest(points(spark, data), points(spark, [query], 1000)).collect()
    assert [(r.query_id, r.nn_id) for r in found] == [(1000, expected)]


def test_nearest_against_all_distances(spark):
    rng = np.random.default_rng(1)
    data, asked = rng.uniform(-100, 100, (1000, 30)), rng.uniform(-100, 100, (20, 30))
    data[500] = data[7]  # a tie goes to the lower id
    found = knn.nearest(points(spark, data), points(spark, asked, 5000), 3).collect()
    for q, x in enumerate(asked):
        d = np.sqrt(((data - x) ** 2).sum(1))
        order = np.lexsort((np.arange(1000), d))[:3]
        assert [r.nn_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 5000 + q] == order.tolist()


def test_rounds_of_queries_and_bounds_change_nothing(spark):
    rng = np.random.default_rng(2)
    data = points(spark, rng.normal(0, 1, (3000, 4)) * rng.exponential(20, (3000, 1))).repartition(3)
    asked = points(spark, rng.normal(0, 10, (40, 4)), 9000)
    whole = sorted(knn.nearest(data, asked, 4).collect())
    assert whole == sorted(knn.nearest(data, asked, 4, limit=300).collect()) and len(whole) == 160
    seen = {r.query_id: r.visited for r in knn.visited(data, asked, 4).collect()}
    assert len(seen) == 40 and all(4 <= n <= 3000 for n in seen.values())


def test_nearest_of_nothing(spark):
    none = points(spark, [(1, 2)]).where("false")
    assert knn.nearest(none, points(spark, [(1, 2)])).count() == 0
    assert knn.nearest(points(spark, [(1, 2)]), points(spark, [(1, 2)])).count() == 0  # only itself


def test_distance(spark):
    pair = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1.0, 2.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.d for r in pair.select(knn.l2("a", "b").alias("d")).collect()] == [5.0, 0.0]


def seq(spark, data):
    return spark.createDataFrame(list(enumerate(data)), "pos long, symbol int")


def test_ranks_and_selects(spark):
    rng = random.Random(77)
    for data in ([4, 0, 4, 4, 2, 0], [6] * 5, [3], [rng.randrange(9) for _ in range(150)], [0, 31] * 20):
        df = seq(spark, data)
        assert sequence.size(df) == len(data)
        assert sequence.access(df, len(data) - 1).first().symbol == data[-1]
        assert {r.pos: r["rank"] for r in sequence.rank_all(df).collect()} == {i: data[:i].count(s) for i, s in enumerate(data)}
        for k in (1, 2, 4):
            at = {s: [i for i, x in enumerate(data) if x == s] for s in set(data)}
            assert {r.symbol: r.pos for r in sequence.select(df, k).collect()} == {s: p[k - 1] if len(p) >= k else len(data) for s, p in at.items()}
    df = seq(spark, [5, 0, 5, 5, 2, 0])
    assert [sequence.rank(df, 5, i) for i in (0, 3, 6)] == [0, 2, 3] and sequence.rank(df, 8, 6) == 0


def test_wrong_alphabets(spark):
    with pytest.raises(ValueError):
        sequence.symbols(seq(spark, [1]), 0)
    with pytest.raises(ValueError):
        sequence.select(seq(spark, [1]), 0)
    with pytest.raises(Exception, match="alphabet"):
        sequence.symbols(seq(spark, [1, 5]), 3).collect()


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def listed(df):
    return sorted(r.id for r in df.collect())


def test_set_algebra(spark):
    a, b = ids(spark, [0, 1, 2, 3, 3, 40000]), ids(spark, [2, 3, 4])
    assert listed(bitmap.intersection(a, b)) == [2, 3]
    assert listed(bitmap.union(a, b)) == [0, 1, 2, 3, 4, 40000]
    assert listed(bitmap.difference(a, b)) == [0, 1, 40000]
    assert listed(bitmap.symmetric_difference(a, b)) == [0, 1, 4, 40000]
    assert listed(bitmap.flip(b, 3, 7)) == [2, 5, 6]
    row = bitmap.counts(a, b).first()
    assert (row.and_n, row.or_n, row.andnot_n, row.xor_n, row.jaccard) == (2, 6, 3, 4, 0.333333)
    assert bitmap.counts(ids(spark, [2]), b).first().strict_subset and bitmap.counts(b, b).first().equal
    assert not bitmap.counts(ids(spark, [9]), b).first().intersect
    assert bitmap.rank(a, 2).first()["rank"] == 3
    assert {r.id: r.place for r in bitmap.ranked(a).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 40000: 4}
    assert listed(bitmap.page(a, 1, 2)) == [1, 2] and listed(bitmap.select_at(a, 4)) == [40000]
    assert bitmap.contains_range(a, 0, 4).first().contains and not bitmap.contains_range(a, 2, 5).first().contains and bitmap.contains_range(a, 7, 7).first().contains
    assert [bitmap.index_of(a, v).first().place for v in (3, 40000, 5, -1)] == [3, 4, -1, -1]
    assert listed(bitmap.add_range(bitmap.remove_range(a, 1, 3), 8, 10)) == [0, 3, 8, 9, 40000]


def test_bitmaps_count_every_id(spark):
    maps = bitmap.build(spark.range(0, 100000))
    assert bitmap.cardinality(maps).first().n == 100000
    both = maps.unionByName(bitmap.build(spark.range(50000, 150000)))
    assert bitmap.cardinality(bitmap.unite(both)).first().n == 150000


@pytest.mark.parametrize(("how", "expected"), [("and", set.intersection), ("or", set.union), ("xor", set.symmetric_difference), ("and not", set.difference)])
def test_bitmaps_combine_by_bucket(spark, tmp_path, how, expected):
    rng = random.Random(4)
    a, b = ({rng.choice([-70000, 0, 32768, 500000]) + rng.randrange(300) for _ in range(400)} for _ in range(2))
    left, right = bitmap.build(ids(spark, a)), bitmap.build(ids(spark, b))
    bitmap.save(left, str(tmp_path / "left"))
    both = bitmap.combine(bitmap.load(spark, str(tmp_path / "left")), right, how)
    assert listed(bitmap.members(both)) == sorted(expected(a, b))
    assert listed(bitmap.members(bitmap.combine(left, left, "xor"))) == []
