"""Boolean, phrase and wildcard search over documents (doc_id, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import formula as P

#: Length of the k-grams of terms.
K = 3


def boolean(docs: DataFrame, formula: str) -> DataFrame:
    """Ids of the documents that fulfil a formula, by one scan."""
    condition = P.compile_text(formula)
    return docs.select("doc_id", T.terms(F.col("text")).alias("terms")).where(condition).select("doc_id")


def dated(docs: DataFrame, formula: str) -> DataFrame:
    """The same for dated documents (begin_date, end_date) and formulas with date ranges."""
    condition = P.compile_dated(formula)
    return docs.select("doc_id", "begin_date", "end_date", T.terms(F.col("text")).alias("terms")).where(condition).select("doc_id")


def by_postings(postings: DataFrame, docs: DataFrame, formula: str) -> DataFrame:
    """A formula over (term, doc_id): only the leaves' postings are read, so ``docs`` is needed for negations alone.

    One aggregation by document gives a flag for each leaf; documents without a posting have none set.
    """
    if not formula.strip():
        return docs.select("doc_id").where("false")
    rpn = P.to_rpn(P.tokenize(formula))
    stems = sorted({P.stem(t.text) for t in rpn if t.kind == "WORD"})
    flags = [F.coalesce(F.bool_or(F.col("term") == s), F.lit(False)).alias(f"f{i}") for i, s in enumerate(stems)]
    found = postings.where(F.col("term").isin(stems)).groupBy("doc_id").agg(*flags)
    condition = P.compile_text(formula, terms="terms") if not stems else P.evaluate(rpn, lambda t: F.coalesce(F.col(f"f{stems.index(P.stem(t.text))}"), F.lit(False)))
    if any(t.kind == "NOT" for t in rpn):
        found = docs.select("doc_id").join(found, "doc_id", "left")
    return found.where(condition).select("doc_id")


def postings(docs: DataFrame) -> DataFrame:
    """term and doc_id, once for each document that has the stem."""
    return T.forward(docs).select("doc_id", F.explode("terms.term").alias("term")).select("term", "doc_id")


def positions(docs: DataFrame, analysed: Column) -> DataFrame:
    """term, doc_id and pos of every word of an analysis."""
    return docs.select("doc_id", F.posexplode(analysed).alias("pos", "term")).select("term", "doc_id", F.col("pos").cast("long").alias("pos"))


def phrase(docs: DataFrame, query: str) -> DataFrame:
    """doc_id and pos of all occurrences of a phrase, overlapping ones too, in order.

    The words of a document stay together, so there is no join: a position counts if the slice from it is the phrase.
    """
    wanted = T.query_words(query)
    if not wanted:
        return docs.select("doc_id", F.lit(0).cast("long").alias("pos")).where("false")
    listed = F.array(*map(F.lit, wanted))
    held = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.array_contains("w", wanted[0]) & (F.size("w") >= len(wanted)))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - len(wanted)), lambda i: (F.element_at("w", i + 1) == wanted[0]) & (F.slice("w", i + 1, len(wanted)) == listed))
    return held.select("doc_id", F.explode(starts).alias("pos")).select("doc_id", F.col("pos").cast("long").alias("pos")).orderBy("doc_id", "pos")


def phrase_by_postings(places: DataFrame, query: str) -> DataFrame:
    """The same over (term, doc_id, pos): the words' postings, moved to the phrase's start, that all meet there."""
    wanted = T.query_words(query)
    if not wanted:
        return places.select("doc_id", "pos").where("false")
    offsets = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).cast("long").alias("i")) for i, w in enumerate(wanted)))
    own = places.where(F.col("term").isin(wanted)).withColumn("at", F.explode(F.filter(offsets, lambda x: x["w"] == F.col("term"))))
    moved = own.select("doc_id", (F.col("pos") - F.col("at.i")).alias("pos"))
    return moved.groupBy("doc_id", "pos").count().where(F.col("count") == len(wanted)).select("doc_id", "pos").orderBy("doc_id", "pos")


def like(pattern: str) -> str | None:
    """A wildcard pattern for LIKE with ``!`` as the escape; ``*`` is its only mark. None if it is empty or only stars."""
    pattern = pattern.translate(str.maketrans(T._UPPER, T._LOWER))
    if not pattern.strip("*"):
        return None
    return re.sub(r"\*+", "%", re.sub(r"([!%_])", r"!\1", pattern))


def wildcard(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id and pos of the words that a pattern matches as a whole, in order."""
    if like(pattern) is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("pos")).where("false")
    return wildcard_by_postings(positions(docs, T.spaced(F.col("text"))), pattern)


def wildcard_by_postings(places: DataFrame, pattern: str) -> DataFrame:
    """The same over (term, doc_id, pos): a fixed beginning of the pattern reaches the scan, which skips the row groups of other terms."""
    if like(pattern) is None:
        return places.select("doc_id", "pos").where("false")
    first = pattern.translate(str.maketrans(T._UPPER, T._LOWER)).split("*")[0]
    own = places.where(F.col("term").startswith(first)) if first else places
    return own.where(_matches("term", pattern)).select("doc_id", "pos").orderBy("doc_id", "pos")


def _matches(column: str, pattern: str) -> Column:
    wanted = like(pattern)
    if "%" not in wanted.replace("!%", ""):
        return F.col(column) == pattern.translate(str.maketrans(T._UPPER, T._LOWER))
    return F.expr(f"{column} LIKE {_literal(wanted)} ESCAPE '!'")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dictionary(places: DataFrame) -> DataFrame:
    """term and term_id, numbered in the terms' order.

    Terms are sorted by range, and an id is the number of terms in the partitions before plus the place in its own, so no
    task holds them all.
    """
    terms = places.select("term").distinct()
    return numbered(terms, "term", "term_id")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with their rank by a column from 0, without a partition that holds all: counts by range partition come first."""
    from quarry.session import stored

    sorted_ = stored(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    parts = sorted_.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + local).cast("long")).drop("_at", "_part", "_before")


def kgrams(terms: DataFrame, key: str = "term") -> DataFrame:
    """gram and key: the distinct k-grams of ``$term$``."""
    padded = F.concat(F.lit("$"), F.col("term"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (K - 1), F.lit(1))), lambda i: F.substring(padded, i, K)))
    return terms.select(F.explode(grams).alias("gram"), key).where(F.length("gram") == K)


def required_grams(pattern: str) -> list[str]:
    """K-grams that every match of a pattern has; anchored ends count ``$``."""
    parts = pattern.translate(str.maketrans(T._UPPER, T._LOWER)).split("*")
    parts[0], parts[-1] = "$" + parts[0], parts[-1] + "$"
    return sorted({p[i : i + K] for p in parts for i in range(len(p) - K + 1)})


def kgram_candidates(grams: DataFrame, pattern: str, key: str = "term") -> DataFrame:
    """Keys that have all the required k-grams of a pattern: a superset of its matches."""
    wanted = required_grams(pattern)
    if not wanted:
        return grams.select(key).distinct()
    return grams.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(key)
