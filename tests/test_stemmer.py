import duckdb
import pytest

from quarry.functions.stemmer import OWN, STAY, stem, stem_sql
from quarry.functions.text import query_stems, query_words


@pytest.mark.parametrize(
    ("word", "expected"),
    [*OWN.items(), *((w, w) for w in STAY), ("running", "run"), ("foxes", "fox"), ("lazy", "lazi"), ("jumping", "jump"), ("runs", "run"), ("runner", "runner"), ("runners", "runner"),
     ("yrs", "\trs"), ("inning", "inning"), ("outing", "outing"), ("herring", "herring"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("proceed", "proceed"), ("ties", "tie"),
     ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("caresses", "caress"), ("happy", "happi"), ("by", "by"), ("relational", "relat"), ("hopefulness", "hope"), ("vying", "vie"), ("a", "a"), ("b3", "b3")],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_sql_gives_the_same_stems():
    parts = ("", "s", "es", "ed", "ing", "ly", "edly", "ingly", "ies", "ied", "y", "ational", "ization", "fulness", "ousli", "ative", "ement", "sion", "logi", "bli", "li", "eed", "eedly", "e", "ll", "able", "ical")
    roots = ("run", "hop", "hope", "fizz", "fall", "abl", "conflat", "troubl", "siz", "cry", "say", "gener", "commun", "past", "univers", "out", "c", "aa", "yy", "boy", "xyz", "sk", "prec", "vowel", "tt")
    words = sorted({r + p for r in roots for p in parts})
    listed = ", ".join(f"('{w}')" for w in words)
    rows = duckdb.connect().execute(f"WITH ws(word) AS (VALUES {listed}), {stem_sql('ws')} SELECT word, stem FROM stems").fetchall()
    assert len(rows) == len(words)
    assert {w: s for w, s in rows} == {w: stem(w) for w in words}


def test_query_analysis():
    assert query_words("Low tide; HIGH-water mark 7.") == ["low", "tide", "high", "water", "mark"]
    assert query_stems("Those heavy barges were drifting towards the rocky shores.") == ["heavi", "barg", "drift", "toward", "rocki", "shore"]
    assert query_stems("which of these and those") == []
