import os
import subprocess
import sys
from pathlib import Path

import pytest

from quarry.functions import text as T
from quarry.operators import search
from quarry.plans.formula import to_rpn, tokenize
from quarry.sources.index import Index


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def places(df):
    return sorted((r.doc_id, r.pos) for r in df.collect())


BOATS = ["a report on ferries", "a report on barges", "ferries towing barges upstream"]
METALS = ["zinc tin lead", "zinc tin", "tin lead", "zinc lead"]


@pytest.mark.parametrize(
    ("texts", "formula", "expected"),
    [(BOATS, "ferry", [0, 2]), (BOATS, "barge", [1, 2]), (BOATS, "ferry AND barge", [2]), (BOATS, "report or tow", [0, 1, 2]), (BOATS, "NOT report", [2]), (BOATS, "NOT (NOT ferry)", [0, 2]), (BOATS, "", []),
     (BOATS, "AND ferry barge", [2]), (BOATS, "(ferry barge AND)", [2]), (BOATS, "ferry AND NOT NOT barge", []), (BOATS, "NOT on", [0, 1, 2]), (METALS, "(zinc OR lead) AND tin", [0, 1, 2]),
     (METALS, "NOT (zinc AND lead)", [1, 2]), (METALS, "zinc AND tin AND lead", [0]), (["Those boats were sinking"], "sink", [0]), (["Those boats were sinking"], "boats", [0]), (["Those boats were sinking"], "those", []),
     (["naïve \u212aelvin", None, ""], "na", [0]), (["\u212aelvin"], "kelvin", [])],
)
def test_boolean(docs_of, texts, formula, expected):
    docs = docs_of(texts)
    assert ids(search.boolean(docs, formula)) == expected
    assert ids(search.by_postings(search.postings(docs), docs, formula)) == expected


@pytest.mark.parametrize("formula", ["tin % lead", "(tin", "tin)", "tin lead AND", "tin lead", "NOT NOT tin", "tin NOT lead", "()", "tin NOT", "7tin"])
def test_boolean_errors(docs_of, formula):
    with pytest.raises(ValueError):
        search.boolean(docs_of(METALS), formula)


def test_lexer_and_order():
    assert [t.text or t.kind for t in tokenize("tin And(zinc or  lead)")] == ["tin", "AND", "(", "zinc", "OR", "lead", ")"]
    assert [t.text or t.kind for t in to_rpn(tokenize("tin OR zinc AND NOT (lead OR iron)"))] == ["tin", "zinc", "lead", "iron", "OR", "NOT", "AND", "OR"]


TIDES = ["low tide at dawn", "high tide at dusk", "low water follows high tide"]


@pytest.mark.parametrize(
    ("texts", "query", "expected"),
    [(TIDES, "low", [(0, 0), (2, 0)]), (TIDES, "high", [(1, 0), (2, 3)]), (TIDES, "high tide", [(1, 0), (2, 3)]), (TIDES, "tide at", [(0, 1), (1, 1)]), (TIDES, "tide at dusk", [(1, 1)]), (TIDES, "low tide at dawn", [(0, 0)]),
     (TIDES, "low at", []), (TIDES, "tide low", []), (TIDES, "", []), (TIDES, "ebb", []), (["drip drip drip drip"], "drip drip", [(0, 0), (0, 1), (0, 2)]), (["drip drip drip drip"], "drip drip drip", [(0, 0), (0, 1)]),
     (["so it goes, so it GOES"], "It goes", [(0, 1), (0, 4)]), (["dusk-to-dawn"], "to dawn", [(0, 1)]), (["dawn of the day"], "dawn day", []), ([None, "", "a"], "a", [(2, 0)])],
)
def test_phrase(docs_of, texts, query, expected):
    docs = docs_of(texts)
    assert places(search.phrase(docs, query)) == expected
    assert places(search.phrase_by_postings(search.positions(docs, T.words(docs.text)), query)) == expected


def test_results_come_in_order(docs_of):
    texts = [f"{'buoy ' * (i % 3)}red light {i}" for i in range(90)]
    for found in (search.phrase(docs_of(texts).repartition(5), "red light"), search.wildcard(docs_of(texts).repartition(5), "*u*")):
        rows = [(r.doc_id, r.pos) for r in found.collect()]
        assert rows == sorted(rows) and len(rows) == 90


@pytest.mark.parametrize(
    ("texts", "pattern", "expected"),
    [(["north wind", "north south", "west wind"], "north", [(0, 0), (1, 0)]), (["storm stork pine", "stormy harbour"], "stor*", [(0, 0), (0, 1), (1, 0)]),
     (["sailing rowing boat", "wing"], "*wing", [(0, 1), (1, 0)]), (["mast moat most", "mart mat"], "m*t", [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]),
     (["keel hull"], "rig*", []), (["lighthouse lighthouses", "light houses"], "li*ho*e", [(0, 0)]), (["NORTH Wind"], "nor*", [(0, 0)]), (["ab ba abba aba"], "a*a", [(0, 2), (0, 3)]),
     (["a b"], "", []), (["a b"], "*", []), (["a b"], "***", []), (["the oars."], "oars", []), (["the oars."], "oars*", [(0, 1)]), (["50% a_b axb 5!"], "*%", [(0, 0)]), (["50% a_b axb 5!"], "a_b", [(0, 1)]),
     (["50% a_b axb 5! it's c\\d"], "5!", [(0, 3)]), (["it's c\\d"], "*'s", [(0, 0)]), (["it's c\\d"], "c\\*", [(0, 1)]), (["50% a_b axb"], "a_*", [(0, 1)])],
)
def test_wildcard(docs_of, texts, pattern, expected):
    docs = docs_of(texts)
    assert places(search.wildcard(docs, pattern)) == expected
    if pattern.strip("*"):
        terms = search.positions(docs, T.spaced(docs.text)).select("term").distinct()
        kept = {r.term for r in search.kgram_candidates(search.kgrams(terms), pattern).collect()}
        assert {texts[d].lower().split()[p] for d, p in expected} <= kept


def test_dictionary_is_sorted_and_gapless(docs_of):
    docs = docs_of(["b a c", "c d a", None])
    rows = search.dictionary(search.positions(docs, T.spaced(docs.text))).collect()
    assert sorted((r.term_id, r.term) for r in rows) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_stored_index(spark, docs_of, tmp_path):
    index = Index.build(docs_of(["oar sank", "mast sank"]), str(tmp_path / "a"))
    index.append(spark.createDataFrame([(2, "oar floated")], "doc_id long, text string"))
    assert places(index.lookup("oar")) == [(0, 0), (2, 0)]
    assert places(index.wildcard("*oa*ed")) == [(2, 1)] and places(index.phrase("oar sank")) == [(0, 0)] and places(index.wildcard("o*")) == [(0, 0), (2, 0)]
    merged = index.compact(str(tmp_path / "b"))
    assert places(merged.lookup("sank")) == [(0, 1), (1, 1)] and merged.places.count() == 6 and merged.docs.count() == 3
    assert sorted(merged.grams.collect()) == sorted(index.grams.collect())


def test_stored_index_answers_as_the_texts(docs_of, tmp_path):
    docs = docs_of([*TIDES, *METALS, None, ""])
    stems, words = Index.build(docs, str(tmp_path / "stems"), "stems"), Index.build(docs, str(tmp_path / "words"), "spaced")
    for formula in ("tide AND NOT low", "NOT tide", "tin OR dusk", "ebb"):
        assert ids(stems.boolean(formula)) == ids(search.boolean(docs, formula))
    for pattern in ("t*", "*i*e", "low", "h*h", "**", ""):
        assert places(words.wildcard(pattern)) == places(search.wildcard(docs, pattern))


def test_a_lookup_skips_row_groups(docs_of, tmp_path):
    index = Index.build(docs_of(TIDES), str(tmp_path / "a"))
    plan = search.wildcard_by_postings(index.places, "ti*")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ti)" in plan and "EqualTo(term,tide)" in index.lookup("tide")._jdf.queryExecution().toString()


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from quarry.session import local_session
from quarry.operators import rank, search
import datetime
spark = local_session(2)
sys.path.remove({repo!r})
docs = spark.createDataFrame([(0, "barges towed upstream", datetime.date(2021, 5, 1), None), (1, "zinc", datetime.date(2021, 6, 1), None)], "doc_id long, text string, begin_date date, end_date date")
print("FOUND", [r.doc_id for r in search.boolean(docs, "barge AND tow").collect()], [r.doc_id for r in search.dated(docs, "barge AND CREATED_IN(2021-05-01, 2021-05-02)").collect()], [r.doc_id for r in rank.vsm_search(docs, "barges").collect()], rank.counts(docs).count())
"""


def test_workers_need_no_path_to_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FOREIGN.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [0] [0] [0] 4" in done.stdout, done.stderr[-2000:]
