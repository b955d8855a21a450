import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import kv
from quarry.sources.store import Store
from quarry.streaming import state


def log(spark, ops):
    return spark.createDataFrame([(k, i, op, v) for i, (op, k, v) in enumerate(ops)], "key string, seq long, op string, value int")


def held(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize(
    ("ops", "expected"),
    [([("put", "oar", 4), ("put", "mast", 5), ("delete", "oar", None), ("put", "keel", 6)], {"mast": 5, "keel": 6}), ([], {}), ([("delete", "hull", None), ("put", "hull", 7)], {"hull": 7}),
     ([("put", "hull", i) for i in range(9)], {"hull": 8}), ([("put", "hull", 1), ("delete", "hull", None), ("delete", "hull", None)], {}), ([("put", "oar", 1), ("delete", "oar", None), ("put", "oar", 2), ("put", "keel", 3)], {"oar": 2, "keel": 3})],
)
def test_latest(spark, ops, expected):
    changes = log(spark, ops)
    assert held(kv.latest(changes)) == expected
    assert held(kv.latest(kv.compact(changes))) == expected


def test_get_has_misses(spark):
    assert held(kv.get(log(spark, [("put", "a", 1), ("put", "b", 2), ("delete", "b", None)]), "a", "b", "z")) == {"a": 1, "b": None, "z": None}


def test_against_a_dictionary(spark):
    rng = random.Random(5)
    for keys, count in ((1, 10), (10, 100), (100, 1000)):
        ops, model = [], {}
        for _ in range(count):
            k = f"k{rng.randrange(keys)}"
            if rng.random() < 0.3:
                ops.append(("delete", k, None))
                model.pop(k, None)
            else:
                ops.append(("put", k, rng.randrange(1000)))
                model[k] = ops[-1][2]
        changes = log(spark, ops)
        assert held(kv.latest(changes)) == model
        # Compacting a part first changes nothing.
        early, late = changes.where(F.col("seq") < count // 2), changes.where(F.col("seq") >= count // 2)
        assert held(kv.latest(kv.compact(early).unionByName(late))) == model


def test_merges(spark):
    puts = log(spark, [("put", "a", 3), ("put", "b", 1), ("put", "a", 1), ("put", "a", 3)])
    assert held(kv.merge_union(puts)) == {"a": [1, 3], "b": [1]}
    assert held(kv.merge_append(puts)) == {"a": [3, 1, 3], "b": [1]}
    assert held(kv.merge_sum(puts)) == {"a": 7, "b": 1}
    assert held(kv.merge(puts, lambda old, new: F.coalesce(old * 10 + new, new, old))) == {"a": 313, "b": 1}
    deleted = puts.unionByName(spark.createDataFrame([("a", 9, "delete", None)], puts.schema))
    assert held(kv.merge_append(deleted)) == {"a": [3, 1, 3], "b": [1]}
    assert held(kv.merge(deleted, lambda old, new: new)) == {"b": 1}
    with pytest.raises(ValueError):
        kv.merge_union(deleted)


def test_equal_seqs_have_one_outcome(spark):
    rows = spark.createDataFrame([("a", 1, "put", 3), ("a", 1, "delete", None), ("a", 1, "put", 7), ("b", 2, "delete", None)], "key string, seq long, op string, value int")
    assert held(kv.latest(rows.repartition(4))) == held(kv.latest(rows.orderBy(F.desc("value")))) == {"a": 7}


def test_long_histories_are_folded_in_turn(spark, monkeypatch):
    monkeypatch.setattr(kv, "FOLD", 5)
    rng = random.Random(8)
    ops = [("hot" if i % 3 else f"k{rng.randrange(4)}", i * 10**9, "put", rng.randrange(10)) for i in range(200)]
    rows = spark.createDataFrame(ops, "key string, seq long, op string, value int").withColumn("value", F.col("value").cast("string")).repartition(3)
    expected: dict = {}
    for k, _, _, v in ops:
        expected[k] = expected.get(k, "") + str(v)
    assert held(kv.merge(rows, lambda old, new: F.concat(old, new))) == expected


@pytest.mark.parametrize("growth", [2, 3])
def test_store_against_a_dictionary(spark, tmp_path, growth):
    rng, store, model, seq = random.Random(growth), Store(spark, str(tmp_path / "s"), growth), {}, 0
    with pytest.raises(ValueError):
        store.all()
    for _ in range(7):
        ops = []
        for _ in range(rng.randint(1, 30)):
            k, seq = f"k{rng.randrange(12)}", seq + 1
            if rng.random() < 0.3:
                ops.append((k, seq, "delete", None))
                model.pop(k, None)
            else:
                ops.append((k, seq, "put", rng.randrange(1000)))
                model[k] = ops[-1][3]
        store.put(spark.createDataFrame(ops, "key string, seq long, op string, value int"))
        assert all(len(level) < growth for level in store.levels)
    assert held(store.all()) == model and len(store.levels) > 1
    assert held(Store(spark, str(tmp_path / "s")).get("k1", "k2", "none")) == {k: model.get(k) for k in ("k1", "k2", "none")}
    assert held(store.scan("k3", "k5")) == {k: v for k, v in model.items() if "k3" <= k <= "k5"}
    store.compact()
    store.vacuum()
    assert held(store.all()) == model and sum(map(len, store.levels)) == 1
    plan = store.log().where("key = 'k1'")._jdf.queryExecution().toString()
    assert "EqualTo(key,k1)" in plan


def test_store_with_a_rule(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2, lambda old, new: F.coalesce(old + new, new, old))
    for i in range(5):
        store.put(spark.createDataFrame([("a", 2 * i, "put", i), ("b", 2 * i + 1, "put", 1)], "key string, seq long, op string, value int"))
    assert held(store.all()) == {"a": 10, "b": 5}
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "t"), 1)


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime

    times = ["2021-03-01 10:05:00", "2021-03-01 10:40:00", "2021-03-01 15:00:00", "2021-03-01 14:10:00", "2021-03-01 10:50:00"]
    for i, t in enumerate(times):  # a file a batch, in this order
        spark.createDataFrame([(datetime.fromisoformat(t), "a")], "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    counted = state.drain(state.windowed_counts(stream, "ts", "kind", "1 hour", "2 hours"), "update")
    newest = {r.start.hour: r.n for r in counted.groupBy("start").agg(F.max_by("n", "batch").alias("n")).collect()}
    assert newest == {10: 2, 15: 1, 14: 1}  # 10:50 came two batches after 15:00 had moved the watermark to 13:00


def test_bloom_has_no_false_negatives(spark):
    rows, keys = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    assert sorted(r.k for r in kv.bloom_semi_join(rows, keys, "k").collect()) == list(range(0, 2000, 7))
    assert kv.bloom_semi_join(rows, keys.where("k < 0"), "k").count() == 0


def test_bloom_asks_an_array_not_a_map(spark):
    rows, keys = spark.range(0, 60_000, 3).withColumnRenamed("id", "k"), spark.range(0, 60_000, 2).withColumnRenamed("id", "k")
    joined = kv.bloom_semi_join(rows, keys, "k")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "map_from_entries" not in plan and "try_element_at" not in plan
    assert sorted(r.k for r in joined.collect()) == list(range(0, 60_000, 6))


def test_stream_gives_the_batch_state(spark, tmp_path):
    changes = log(spark, [("put", "a", 1), ("put", "b", 2), ("delete", "a", None), ("put", "c", 3), ("put", "b", 5)])
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert held(kv.latest(state.drain(state.latest(stream), "update"))) == held(kv.latest(changes)) == {"b": 5, "c": 3}


def test_stream_of_postings(spark, docs_of, tmp_path):
    docs_of(["Cat sat", "dog"]).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
    assert sorted((r.term, r.doc_id, r.pos) for r in state.drain(state.postings(stream)).collect()) == [("cat", 0, 0), ("dog", 1, 0), ("sat", 0, 1)]
