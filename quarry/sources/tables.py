"""The inputs of the operators, made from Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dates import day, end_day
from quarry.session import forget_at_exit, shared_folder
from quarry.sources.index import Index, RankIndex
from quarry.sources.store import Store


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def dated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an interval that follows from the id; every fifth is open."""
    begin = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("doc_id") % 2500).cast("int"))
    end = F.when(F.col("doc_id") % 5 != 0, F.date_add(begin, (F.col("doc_id") % 700).cast("int")))
    return documents(spark, folder).withColumns({"begin_date": begin, "end_date": end})


def order_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """o_orderkey, lo and hi in days: from the order to its last shipping, open while the order is."""
    last = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, folder, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    end = F.when(F.col("o_orderstatus") != "O", F.col("last"))
    return rows.select("o_orderkey", day("o_orderdate").alias("lo"), end_day(end).alias("hi"))


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events as changes: errors delete."""
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("symbol"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


_built: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, kind: str, build: Callable[[str], object]) -> object:
    """What ``build`` makes of a folder's tables in the shared folder, once for each application."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _built:
        path = f"{shared_folder(spark)}/quarry/{kind}-{uuid.uuid4().hex}"
        _built[key] = build(path)
        forget_at_exit(spark, path)
    return _built[key]


def index(spark: SparkSession, folder: str, analysis: str) -> Index:
    """The stored index of documents, built when first asked for."""
    return _once(spark, folder, f"index-{analysis}", lambda path: Index.build(documents(spark, folder), path, analysis))


def rank_index(spark: SparkSession, folder: str) -> RankIndex:
    return _once(spark, folder, "rank", lambda path: RankIndex.build(documents(spark, folder), path))


def store(spark: SparkSession, folder: str, batches: int = 10) -> Store:
    """The change log in a stored key-value table, put in batches of seq."""

    def build(path: str) -> Store:
        log, out = change_log(spark, folder), Store(spark, path, growth=3)
        last = log.agg(F.max("seq")).first()[0] or 0
        for i in range(batches):
            out.put(log.where((F.col("seq") * batches > i * last) & (F.col("seq") * batches <= (i + 1) * last) if i else F.col("seq") * batches <= last))
        return out

    return _once(spark, folder, "store", build)


def labelled(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Ids of the documents with a label of 1."""
    return table(spark, folder, "labels").where(F.col(name) == 1).select(F.col("doc_id").alias("id")).distinct()
