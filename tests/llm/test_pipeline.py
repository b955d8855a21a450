import random

import duckdb
import pytest

import corpus_pipeline as P
from quarry.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("aeiorstnhl", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(150):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(20, 200)))
        if i % 10 == 3:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 10 == 5:
            words = rows[rng.randrange(len(rows))][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 10 == 7:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int("!!" not in text), 0))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert tuple(docs.columns) == P.COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            sizes.append(docs.count())
            assert all(r.text == texts[r.doc_id] for r in docs.collect())
        if k == 0:
            kept = {r.doc_id for r in docs.collect()}
            junk = {i for i, t in texts.items() if "!!" in t}
            assert kept >= set(texts) - junk and len(kept & junk) <= 0.1 * len(junk)
        if k == 1:
            kept = {}
            for r in docs.collect():
                assert r.text.lower() not in kept
                kept[r.text.lower()] = r.doc_id
        if k == 2:
            grams = {r.doc_id: {tuple(r.text.split()[i : i + 5]) for i in range(len(r.text.split()) - 4)} for r in docs.collect()}
            assert not any(a < b and 100 * len(x & y) >= 80 * len(x | y) for a, x in grams.items() for b, y in grams.items())
    assert sizes[0] > sizes[1] > sizes[2]
    assert {r.doc_id for r in docs.collect()} <= set(texts) and docs.where("length > 2048").isEmpty()
    assert P.run(spark, folder).count() == docs.count()


def test_dedup_query_against_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    expected = con.sql(queries.oracle_sql()["op10_exact_dedup"]).df().sort_values("doc_id")
    got = queries.queries()["op10_exact_dedup"](spark, folder).toPandas().sort_values("doc_id")
    assert got[list(expected.columns)].astype(str).values.tolist() == expected.astype(str).values.tolist()


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 11))


def test_repeated_and_null_ids_leave_one_row_of_each_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    twice = [tuple(r) for r in rows] + [tuple(r) for r in rows[:100]] + [(None, *tuple(r)[1:]) for r in rows[:20]] + [(rows[0].doc_id, *tuple(r)[1:]) for r in rows[20:40]]
    left = P.exact(spark, spark.createDataFrame(twice, docs.schema), folder).collect()
    assert sorted(r.text.lower() for r in left) == sorted({r.text.lower() for r in rows})
    one_id = spark.createDataFrame([(7 if r.doc_id % 2 else None, *tuple(r)[1:]) for r in left], docs.schema)
    near = P.near(spark, one_id, folder).collect()
    assert sorted(r.text for r in near) == sorted({r.text for r in near})
    grams = [{tuple(r.text.split()[i : i + 5]) for i in range(len(r.text.split()) - 4)} for r in near]
    assert not any(100 * len(x & y) >= 80 * len(x | y) for i, x in enumerate(grams) for y in grams[:i])
    mixed = P.mix(spark, spark.createDataFrame(near, docs.schema), folder).collect()
    copies = {}
    for r in mixed:
        copies[r.text] = copies.get(r.text, 0) + 1
    assert max(copies.values()) <= 4
