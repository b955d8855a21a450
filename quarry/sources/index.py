"""Stored indexes, laid out for lookups by term: built once, asked often.

``Index`` holds postings with positions, the documents and the k-grams of the terms; ``RankIndex`` holds the counts of
terms with their idf and the documents' norms. Rows are sorted by term within range partitions, so row groups have narrow
ranges of terms and a lookup skips the others; a Bloom filter on the term settles the rest.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import rank, search

ANALYSES = {"words": T.words, "spaced": T.spaced}


def _positions(docs: DataFrame, analysis: str) -> DataFrame:
    """term, doc_id and pos of an analysis."""
    if analysis == "stems":
        return search.positions(T.stems_of(docs), F.col("stems"))
    return search.positions(docs, ANALYSES[analysis](F.col("text")))


def _sorted(rows: DataFrame, path: str, *key: str, parts: int | None = None) -> None:
    dealt = rows.repartitionByRange(parts, *key) if parts else rows.repartitionByRange(*key)
    dealt.sortWithinPartitions(*key).write.option(f"parquet.bloom.filter.enabled#{key[0]}", "true").mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Index:
    """Of one text analysis: ``places`` (term, doc_id, pos), ``docs`` (doc_id) and ``grams`` (gram, term)."""

    spark: SparkSession
    path: str
    analysis: str = "words"

    @classmethod
    def build(cls, docs: DataFrame, path: str, analysis: str = "words", parts: int | None = None) -> Index:
        index = cls(docs.sparkSession, path, analysis)
        _sorted(_positions(docs, analysis), f"{path}/places", "term", "doc_id", "pos", parts=parts)
        docs.select("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
        index._store_grams()
        return index

    def _store_grams(self) -> None:
        """The k-grams follow from the stored terms, so texts aren't read again."""
        _sorted(search.kgrams(self.places.select("term").distinct()), f"{self.path}/grams", "gram", "term")

    @property
    def places(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/places")

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def append(self, docs: DataFrame) -> None:
        """Add documents; ``compact`` merges the parts later. K-grams of new terms are added."""
        fresh = _positions(docs, self.analysis)
        new = search.kgrams(fresh.select("term").distinct()).join(self.grams, ["gram", "term"], "left_anti")
        new.sortWithinPartitions("gram", "term").write.mode("append").parquet(f"{self.path}/grams")
        fresh.sortWithinPartitions("term", "doc_id", "pos").write.mode("append").parquet(f"{self.path}/places")
        docs.select("doc_id").write.mode("append").parquet(f"{self.path}/docs")

    def compact(self, to: str) -> Index:
        """All parts sorted anew at another path."""
        index = Index(self.spark, to, self.analysis)
        _sorted(self.places, f"{to}/places", "term", "doc_id", "pos")
        self.docs.write.mode("overwrite").parquet(f"{to}/docs")
        index._store_grams()
        return index

    def lookup(self, term: str) -> DataFrame:
        return self.places.where(F.col("term") == term).select("doc_id", "pos")

    def boolean(self, formula: str) -> DataFrame:
        """Ids of the documents that fulfil a formula, from the leaves' postings; of a ``stems`` index."""
        return search.by_postings(self.places, self.docs, formula)

    def phrase(self, query: str) -> DataFrame:
        return search.phrase_by_postings(self.places, query)

    def wildcard(self, pattern: str) -> DataFrame:
        """doc_id and pos of the words a pattern matches: those of the terms that have its k-grams, then verified."""
        if search.like(pattern) is None or not search.required_grams(pattern):
            return search.wildcard_by_postings(self.places, pattern)
        terms = search.kgram_candidates(self.grams, pattern)
        return search.wildcard_by_postings(self.places.join(terms, "term", "left_semi"), pattern)


@dataclass(frozen=True)
class RankIndex:
    """``counts`` (term, doc_id, cnt, n), ``terms`` (term, df, idf), ``norms`` (doc_id, norm)."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> RankIndex:
        forward, values = rank.analysed(docs)
        _sorted(rank.exploded(forward), f"{path}/counts", "term", "doc_id")
        _sorted(values, f"{path}/terms", "term")
        rank.lengths_of(rank.weighted(forward, values)).write.mode("overwrite").parquet(f"{path}/norms")
        return cls(docs.sparkSession, path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _known(self, wanted: Counter) -> dict[str, float]:
        """idf of a query's terms."""
        found = self.table("terms").where(F.col("term").isin(*wanted)) if wanted else None
        return {r.term: r.idf for r in found.collect()} if found is not None else {}

    def _asked(self, terms: dict[str, float]) -> DataFrame:
        return self.table("counts").where(F.col("term").isin(*terms))

    def _nothing(self) -> DataFrame:
        return self.table("norms").select("doc_id", F.lit(0.0).alias("score")).where("false")

    def tfidf_search(self, query: str, top: int | None = None) -> DataFrame:
        wanted = Counter(T.query_stems(query))
        value = {t: x * wanted[t] for t, x in self._known(wanted).items() if x > 0}
        return rank.summed(self._asked(value), value, top) if value else self._nothing()

    def vsm_search(self, query: str, top: int | None = None) -> DataFrame:
        known = self._known(Counter(T.query_stems(query)))
        vector = rank.vector_of(query, known)
        return rank.cosines(self._asked(vector), self.table("norms"), vector, known, top) if vector else self._nothing()
