"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from quarry.llm import exact_dedup, html_text, jaccard_join, mixing, packing, quality_classifier, quality_rules, secrets, sharding, token_counts

LONG = "lorem ipsum dolor " * 40000
TEXTS = [(1, "Some words, here and there, to count and pack.", "en", "a"), (1, "Some words, here and there, to count and pack.", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "No id at all.", "de", "a"), (4, LONG, "en", None), (5, "x" * 30000, "en", "b"), (6, " \n\t ", "fr", "c"), (7, "日本語 ßÉ 🙂 ½", None, "c")]
CLASHES = "rid long, h long, name string, n long, c long, size long, score double, set string, length long, piece int, kept boolean, block string, at long, left long, rank long"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    extra = spark.createDataFrame([(i, i, None, "x", i, i, i, i, 0.5, "s", i, i, True, "b", i, i, i)[:1] + (i, i, "x", i, i, i, 0.5, "s", i, i, True, "b", i, i, i) for i in range(1)], "k int, " + CLASHES).drop("k")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", "<p>Hi <b>there</b></p>"), (1, "u", "<p>Hi <b>there</b></p>"), (2, None, None), (3, "v", ""), (None, "w", "plain text"), (4, "x", "<div" * 5000), (5, "y", "<p>" + LONG)], "page_id long, url string, html string")
    return docs, docs.crossJoin(extra), labels, pages.crossJoin(extra)


OPERATORS = {
    "packing": lambda d, _: packing.pack(d),
    "joins": lambda d, _: jaccard_join.classes(d),
    "classifier": lambda d, labels: quality_classifier.classify(d, labels),
    "mixing": lambda d, _: mixing.mix(d).drop("rid"),
    "secrets": lambda d, _: secrets.scan(d),
    "rules": lambda d, _: quality_rules.judge(d).drop("log_perplexity", "low", "high", "middle"),
    "sharding": lambda d, _: sharding.shard(d),
    "counts": lambda d, _: token_counts.token_counts(d),
    "dedup": lambda d, _: exact_dedup.groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(tables, name):
    docs, clashing, labels, _ = tables
    rows = sorted(map(str, OPERATORS[name](docs, labels).drop("sequence_id", "offset").collect()))
    assert len(rows) >= len(TEXTS)
    assert rows == sorted(map(str, OPERATORS[name](clashing, labels).drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(tables, name):
    docs, _, labels, _ = tables
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0
    if name == "classifier":
        assert {r.predicted for r in OPERATORS[name](docs, labels.where("false")).collect()} == {1}


def test_odd_pages(tables):
    pages = tables[3]
    rows = {(r.page_id, r.url): r for r in html_text.texts(pages).collect()}
    assert html_text.texts(pages).count() == 7 and html_text.texts(pages.where("false")).count() == 0
    assert rows[1, "u"].text == "Hi there" and rows[2, None].text == "" and rows[3, "v"].text == "" and rows[None, "w"].text == "plain text"
    assert rows[5, "y"].n_chars == len(LONG.strip())


def test_results_of_odd_documents(tables):
    docs = tables[0]
    dedup = exact_dedup.groups(docs).collect()
    assert sorted(r.group_size for r in dedup) == [1, 1, 1, 1, 1, 2, 2, 2, 2]
    assert {r.keep_id for r in dedup if r.doc_id in (2, 3)} == {3}
    joined = {(r.doc_id, r.n_shingles): r for r in jaccard_join.classes(docs).collect()}
    assert joined[2, 0].component_id == 2 and joined[3, 0].component_id == 3 and joined[6, 0].component_id == 6 and joined[5, 1].component_id == 5 and joined[1, 6].component_size == 2
    empty = [r for r in packing.pack(docs).collect() if r.doc_id in (2, 3, 6)]
    assert [r.length for r in empty] == [1, 1, 1]
    mixed = mixing.mix(docs).collect()
    assert all(r.taken <= 3 * r["size"] for r in mixed) and len(mixed) == len(TEXTS)
