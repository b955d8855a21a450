"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and hands
the next stage what it reads there. A doc_id names a document, as in the table; where ids are repeated or null, the
stages that select by id work on numbers of rows instead, so of equal texts one row stays in any case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, jaccard_join, mixing, packing, quality_classifier
from quarry.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: N-grams and similarity, in percent, from which two documents are near duplicates.
WORDS, PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _by_row(stage: Stage) -> Stage:
    """The stage with a number for each row in place of doc_id, in the order of ids, where ids are repeated."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return stage(spark, docs, sf_dir)
        placed = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("at"))  # parts the rows of one id
        placed = placed.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
        rows = stored(placed.withColumn("row", F.monotonically_increasing_id()), "rows")
        done = stage(spark, rows.withColumn("doc_id", F.col("row")).select(*COLUMNS), sf_dir)
        ids = rows.select("row", F.col("doc_id").alias("own_id")).hint("merge")  # it grows with the corpus
        return done.join(ids, F.col("doc_id") == F.col("row")).withColumn("doc_id", F.col("own_id")).select(*COLUMNS)

    return run


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose ids are in ``kept``; a shuffle join, as either side grows with the corpus."""
    return docs.join(kept.select(F.col("doc_id").alias("kept_id")), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the score is taken and the row dropped in one pass."""
    found = quality_classifier.classify(docs, read(spark, sf_dir, "labels"), keep=COLUMNS)
    return found.where("predicted = 1").select(*COLUMNS)


@_by_row
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one with the largest id stays."""
    return _only(docs, exact_dedup.groups(docs).where("kept"))


@_by_row
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the least id stays."""
    found = jaccard_join.classes(docs, WORDS, PERCENT)
    return _only(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


@_by_row
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    copies = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("mixed_id"), "copies")
    copies = copies.hint("merge")  # it grows with the corpus, so it is shuffled at every size
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to target weights", mix), ("best-fit packing", pack)]

#: SQL can't express the classifier's fit or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
