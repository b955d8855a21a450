"""Ranked retrieval: TF-IDF sums and cosines of the vector space model.

Everything starts from the forward table (doc_id, n, terms with counts), which analyses each text once and needs no
shuffle. Functions take documents, or a stored ``RankIndex`` (see ``quarry.sources.index``) where they say so.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.search import numbered
from quarry.session import stored

#: Decimals of a score; sums in another order differ beyond them.
DIGITS = 6
#: Terms whose idf is broadcast at most; a larger vocabulary is joined by shuffle.
SMALL = 1_000_000


def tokens(docs: DataFrame) -> DataFrame:
    return T.stems_of(docs, "tokens")


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and the number of its tokens, 0 for a document without any."""
    return T.forward(docs).select("doc_id", "n")


def exploded(forward: DataFrame) -> DataFrame:
    """doc_id, term, cnt and n of a forward table."""
    return forward.select("doc_id", "n", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.cnt", "n")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, term, cnt and n, the document's length."""
    return exploded(T.forward(docs))


def frequencies(forward: DataFrame) -> DataFrame:
    """term and df, the number of documents that have it."""
    return forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def with_idf(found: DataFrame, total: int) -> DataFrame:
    """idf: ln(N / df), N counting all documents."""
    return found.withColumn("idf", F.log(F.lit(float(total)) / F.col("df")))


def idf(docs: DataFrame) -> DataFrame:
    """term, df and idf."""
    return with_idf(frequencies(T.forward(docs)), docs.count())


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def weighted(forward: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, term and w, the weights that aren't zero, from a forward table and (term, idf)."""
    held = exploded(forward).join(_small(values.where("idf > 0").select("term", "idf")), "term")
    return held.select("doc_id", "term", (F.col("cnt") / F.col("n") * F.col("idf")).alias("w"))


def analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forward table and term, df, idf, both stored, so that texts are analysed once."""
    forward = stored(T.forward(docs), "forward")
    return forward, stored(with_idf(frequencies(forward), forward.count()), "idf")


def weights(docs: DataFrame) -> DataFrame:
    """doc_id, term and w: the weights that aren't zero."""
    return weighted(*analysed(docs))


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _asked(docs: DataFrame, wanted: Counter) -> DataFrame:
    """doc_id, n, term and cnt of the query's terms for the documents that have any: one scan, and rows for those terms alone."""
    held = T.forward(docs).select("doc_id", "n", F.filter("terms", lambda t: t["term"].isin(*wanted)).alias("own"))
    return held.where(F.size("own") > 0).select("doc_id", "n", F.explode("own").alias("t")).select("doc_id", "n", "t.term", "t.cnt")


def _idf_of(asked: DataFrame, total: int) -> dict[str, float]:
    """idf of the query's terms: a row for each term of the query comes to the driver."""
    return {r.term: log(total / r.df) for r in asked.groupBy("term").agg(F.count("*").alias("df")).collect()}


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(0.0).alias("score")).where("false")


def summed(asked: DataFrame, value: dict[str, float], top: int | None = None) -> DataFrame:
    """doc_id and score of rows (doc_id, n, term, cnt): the sum of tf times each term's value, the best first."""
    scored = asked.where(F.col("term").isin(*value)).groupBy("doc_id").agg(F.sum(F.col("cnt") / F.col("n") * _literal_map(value)[F.col("term")]).alias("score"))
    return best(scored, top)


def tfidf_search(docs: DataFrame, query: str, top: int | None = None) -> DataFrame:
    """doc_id and score, the best first: tf * idf of the query's tokens, repeated ones counted again; only scores above 0."""
    wanted = Counter(T.query_stems(query))
    if not wanted:
        return _nothing(docs)
    asked = stored(_asked(docs, wanted), "asked")  # the query's terms only, read twice
    value = {t: x * wanted[t] for t, x in _idf_of(asked, docs.count()).items() if x > 0}
    return summed(asked, value, top) if value else _nothing(docs)


def best(scored: DataFrame, top: int | None) -> DataFrame:
    ranked = scored.withColumn("score", F.round("score", DIGITS)).orderBy(F.desc("score"), "doc_id")
    return ranked.limit(top) if top else ranked


def vocabulary(docs: DataFrame) -> DataFrame:
    """term and its index in sorted order."""
    return numbered(T.forward(docs).select(F.explode("terms.term").alias("term")).distinct(), "term", "idx")


def document_vectors(docs: DataFrame) -> DataFrame:
    """doc_id and vector: its weights above 0 as (idx, w), sorted by the vocabulary's index."""
    forward, values = analysed(docs)
    placed = weighted(forward, values).join(_small(numbered(values.select("term"), "term", "idx")), "term")
    return placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("vector"))


def vector_of(query: str, known: dict[str, float]) -> dict[str, float]:
    """tf * idf of a query's terms: tf over all its tokens, terms that no document or every document has are left out."""
    asked_for = T.query_stems(query)
    return {t: c / len(asked_for) * known[t] for t, c in Counter(asked_for).items() if known.get(t, 0) > 0}


def query_vector(docs: DataFrame, query: str) -> dict[str, float]:
    wanted = Counter(T.query_stems(query))
    return vector_of(query, _idf_of(_asked(docs, wanted), docs.count()) if wanted else {})


def lengths_of(weights: DataFrame) -> DataFrame:
    """doc_id and norm from doc_id and w."""
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def norms(docs: DataFrame) -> DataFrame:
    """doc_id and norm of the documents with a weight."""
    return lengths_of(weights(docs))


def cosines(asked: DataFrame, norms: DataFrame, vector: dict[str, float], values: dict[str, float], top: int | None = None) -> DataFrame:
    """doc_id and score of rows (doc_id, n, term, cnt) of a query's terms: the cosine with ``vector``, the best first."""
    length = sum(x * x for x in vector.values()) ** 0.5
    weight = {t: x * values[t] for t, x in vector.items()}
    dots = asked.where(F.col("term").isin(*weight)).groupBy("doc_id").agg(F.sum(F.col("cnt") / F.col("n") * _literal_map(weight)[F.col("term")]).alias("dot"))
    scored = dots.where("dot > 0").join(norms, "doc_id").select("doc_id", (F.col("dot") / (F.col("norm") * length)).alias("score"))
    return best(scored, top)


def vsm_search(docs: DataFrame, query: str, top: int | None = None) -> DataFrame:
    """doc_id and score, the best first: cosine of the tf-idf vectors, only above 0. Norms are made of the documents that have a term of the query."""
    wanted = Counter(T.query_stems(query))
    if not wanted:
        return _nothing(docs)
    forward, values = analysed(docs)
    known = {r.term: r.idf for r in values.where(F.col("term").isin(*wanted)).collect()}  # the query's terms
    vector = vector_of(query, known)
    if not vector:
        return _nothing(docs)
    own = forward.where(F.arrays_overlap("terms.term", F.array(*map(F.lit, vector))))
    return cosines(exploded(own), lengths_of(weighted(own, values)), vector, known, top)


def sparse_dot(a: str, b: str) -> Column:
    """Dot product of two arrays of (idx, w) sorted by idx."""
    other = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + x["w"] * F.coalesce(other[x["idx"]], F.lit(0.0)))
