"""Text analysis: the four ways in which texts become words, as columns, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stemmer import stem, stem_counts, stem_lists, stemmed

#: Stop words, compared before stemming.
STOPS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased after they are found, so that no other letter turns into one."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def spaced(text: Column) -> Column:
    """Runs of anything but white space, with A-Z lower-cased and punctuation kept."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def kept(text: Column) -> Column:
    """The words that aren't stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*STOPS))


def stems(text: Column) -> Column:
    """Stems of the words that aren't stop words, with repeats."""
    return stemmed(kept(text))


def stems_of(docs: DataFrame, name: str = "stems") -> DataFrame:
    """doc_id and ``stems`` of every document, for whole tables: no worker holds more than a piece of the stems."""
    return stem_lists(docs, kept(F.col("text")), name)


def forward(docs: DataFrame) -> DataFrame:
    """doc_id, n and terms (term, cnt) of every document: its stems are made once, however often they are used."""
    return stem_counts(docs, kept(F.col("text")))


def terms(text: Column) -> Column:
    """The distinct stems."""
    return F.array_distinct(stems(text))


def query_words(text: str) -> list[str]:
    """``words`` of a query."""
    return [w.lower() for w in re.findall("[A-Za-z]+", text)]


def query_stems(text: str) -> list[str]:
    """``stems`` of a query."""
    return [stem(w) for w in query_words(text) if w not in STOPS]


#: The same for SQL engines: positions and words of documents.
WORDS_SQL = """tok AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, lower(l[pos + 1]) AS word
    FROM (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents)))"""
SPACED_SQL = f"""tok AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, l[pos + 1] AS term
    FROM (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^ \\t\\n\\x0B\\f\\r]+') AS l FROM documents)))"""
