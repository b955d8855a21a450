import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import stemmer
from quarry.operators import rank
from quarry.sources.index import RankIndex


def rows(df):
    return [(r.doc_id, r.score) for r in df.collect()]


SEARCHES = (rank.tfidf_search, rank.vsm_search)
SHIPS = ["rope anchor sail", "sail sail sail", "rope anchor lamp", "lamp oil"]


@pytest.mark.parametrize("search", SEARCHES)
@pytest.mark.parametrize(
    ("texts", "query", "first"),
    [(SHIPS, "sail", 1), (SHIPS, "oil", 3), (["towing towed tow", "mooring moored moor"], "tows", 0), ([f"plain crate {i}" for i in range(60)] + ["a cracked bell"], "bell", 60), (SHIPS, "rope sail anchor", 0)],
)
def test_first(docs_of, search, texts, query, first):
    assert rows(search(docs_of(texts), query))[0][0] == first


@pytest.mark.parametrize("search", SEARCHES)
@pytest.mark.parametrize(("texts", "query"), [(SHIPS, ""), (SHIPS, "and of the"), (SHIPS, "tiller"), ([], "sail"), (["sail"] * 4, "sail"), ([None, ""], "sail")])
def test_nothing(docs_of, search, texts, query):
    assert rows(search(docs_of(texts), query)) == []


@pytest.mark.parametrize("search", SEARCHES)
def test_order(docs_of, search):
    found = rows(search(docs_of([*SHIPS, None, "", "sail rope rope rope rope"]), "sail"))
    assert {d for d, _ in found} == {0, 1, 6} and all(s > 0 for _, s in found)
    assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert {d for d, _ in rows(search(docs_of(["SAIL Rope", "sail LAMP", "oil rope"]), "Sail"))} == {0, 1}
    assert len(rows(search(docs_of(SHIPS), "rope sail", 2))) == 2


def test_values(docs_of):
    docs = docs_of(["oil oil lamp", "rope sail", "oil sail"])
    tf = {(r.doc_id, r.term): r.cnt / r.n for r in rank.counts(docs).collect()}
    idf = {r.term: r.idf for r in rank.idf(docs).collect()}
    assert tf[0, "oil"] == pytest.approx(2 / 3) and idf["lamp"] == pytest.approx(math.log(3)) and idf["oil"] == pytest.approx(math.log(1.5))
    assert {(r.doc_id, r.term): r.w for r in rank.weights(docs).collect()} == pytest.approx({k: v * idf[k[1]] for k, v in tf.items()})
    assert rows(rank.tfidf_search(docs, "oil oil lamp"))[0] == (0, pytest.approx(2 / 3 * math.log(1.5) * 2 + math.log(3) / 3, abs=1e-6))


def test_cosines(docs_of):
    assert rows(rank.vsm_search(docs_of(["rope anchor sail", "lamp oil"]), "sail rope anchor")) == [(0, 1.0)]
    assert all(0 < s <= 1 for _, s in rows(rank.vsm_search(docs_of(["rope anchor sail", "rope rope", "sail sail", "oil"]), "rope sail")))


def test_index_ranks_as_the_texts(docs_of, tmp_path):
    docs = docs_of([*SHIPS, None, "", "sail rope rope"])
    index = RankIndex.build(docs, str(tmp_path))
    for query in ("sail", "rope rope lamp", "the", "", "tiller oil"):
        assert rows(index.tfidf_search(query)) == rows(rank.tfidf_search(docs, query))
        assert rows(index.vsm_search(query)) == rows(rank.vsm_search(docs, query))
    assert rows(index.vsm_search("sail rope", 1)) == rows(rank.vsm_search(docs, "sail rope"))[:1]


def test_texts_are_analysed_once(docs_of):
    docs = docs_of(SHIPS)
    for plan in (rank.counts(docs), rank.idf(docs), rank._asked(docs, {"sail": 1})):
        assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "InArrow" not in rank.weights(docs)._jdf.queryExecution().executedPlan().toString()  # from the stored forward table


def test_workers_count_pieces_not_batches(monkeypatch):
    words = [["sail"] * (i % 90) + [f"rope{i}", "anchors"] for i in range(3000)] + [["oil"] * 5000, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(words)], names=["doc_id", "words"])
    monkeypatch.setattr(stemmer, "PIECE", 1000)
    parts = list(stemmer.counted(iter([batch])))
    assert len(parts) > 100 and all(sum(p.column("n").to_pylist()) <= 1000 or p.num_rows == 1 for p in parts)
    made = [r for p in parts for r in p.to_pylist()]
    assert [(r["doc_id"], r["n"]) for r in made] == [(i, len(w)) for i, w in enumerate(words)]
    assert all({t["term"]: t["cnt"] for t in r["terms"]} == Counter(map(stemmer.stem, w)) for r, w in zip(made, words, strict=True))
    lists = list(stemmer._stem_lists(batch.column("words")))
    assert len(lists) == len(parts) and [x for part in lists for x in part.to_pylist()] == [list(map(stemmer.stem, w)) for w in words]


def test_shuffled_idf_gives_the_same(docs_of, monkeypatch):
    docs = docs_of(SHIPS)
    small = sorted(rank.weights(docs).collect())
    monkeypatch.setattr(rank, "SMALL", 0)
    assert sorted(rank.weights(docs).collect()) == small


def test_vectors(docs_of):
    docs = docs_of(["oil rope", "lamp sail", "oil"])
    vectors = {r.doc_id: [(e.idx, e.w) for e in r.vector] for r in rank.document_vectors(docs).collect()}
    assert vectors[0] == [(1, pytest.approx(math.log(1.5) / 2)), (2, pytest.approx(math.log(3) / 2))]
    assert rank.query_vector(docs, "rope tiller the rope") == {"rope": pytest.approx(2 / 3 * math.log(3))}
    assert rank.query_vector(docs, "the") == {}


def test_vocabulary_and_lengths(docs_of):
    docs = docs_of(["rope oil", "lamp", None, "the"])
    assert sorted((r.idx, r.term) for r in rank.vocabulary(docs).collect()) == [(0, "lamp"), (1, "oil"), (2, "rope")]
    assert {r.doc_id: r.n for r in rank.lengths(docs).collect()} == {0: 2, 1: 1, 2: 0, 3: 0}


def test_sparse_dot(spark):
    frame = spark.createDataFrame([([(2, 1.5), (4, 2.0), (9, 1.0)], [(4, 0.5), (8, 3.0), (9, 6.0)]), ([(0, 1.0)], [(1, 1.0)]), ([], [(1, 1.0)])], "a array<struct<idx:int,w:double>>, b array<struct<idx:int,w:double>>")
    assert [r.x for r in frame.select(rank.sparse_dot("a", "b").alias("x")).collect()] == pytest.approx([7.0, 0.0, 0.0])
    assert frame.where(F.size("a") == 0).count() == 1
