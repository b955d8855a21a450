"""The same state, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import forget_at_exit, shared_folder


def latest(log: DataFrame) -> DataFrame:
    """key, seq, op and value of the newest change of each key of a stream: an aggregation whose state holds one row a key."""
    newest = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return newest.select("key", "x.seq", "x.op", "x.value")


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id and pos of a stream of documents: no state, so the sink may append."""
    return docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "term")).select("term", "doc_id", F.col("pos").cast("long").alias("pos"))


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and column; what comes later than ``late`` is dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has now, run to its end: each batch's rows are written to the shared folder with the batch's number.

    In update mode a later batch's row of a key replaces the earlier one; the reader sees to that.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/quarry/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    forget_at_exit(spark, path)
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
