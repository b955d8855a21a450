"""Exact nearest neighbours by Euclidean distance.

Points stay where they are and are read once for each round of queries, of which at most ``QUERY_BYTES`` go to every task. A
task keeps each query's k best, skips blocks of points whose norms are too far from the query's, and measures the others by
matrix products; what it sends is k rows a query, merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ship, stored

#: Points in a block.
BLOCK = 1024
#: Vectors of the queries of a round.
QUERY_BYTES = 32 << 20


def l2(a: str | Column, b: str | Column) -> Column:
    """Distance of two arrays, in double."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def nearest(points: DataFrame, queries: DataFrame, k: int = 1, key: str = "vec_id", limit: int = QUERY_BYTES) -> DataFrame:
    """query_id, nn_id, distance and rank of each query's k nearest points other than itself; ties go to the lower id."""
    found = candidates(points, queries, k, key, limit).where("nn_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "nn_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "nn_id", F.round("d", 6).alias("distance"), "rank")


def visited(points: DataFrame, queries: DataFrame, k: int = 1, key: str = "vec_id", limit: int = QUERY_BYTES) -> DataFrame:
    """query_id and how many points were measured for it, by any task: what the bound on norms left."""
    return candidates(points, queries, k, key, limit).where("visited IS NOT NULL").groupBy("query_id").agg(F.sum("visited").alias("visited"))


def candidates(points: DataFrame, queries: DataFrame, k: int, key: str, limit: int) -> DataFrame:
    """query_id, nn_id, d: of each task's points the k nearest to each query; and query_id, visited: how many it measured."""
    spark = points.sparkSession
    ship(spark)
    shape = lambda rows: rows.select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    data, asked = shape(points), shape(queries)
    width = asked.agg(F.max(F.size("v"))).first()[0] or 1
    rounds = max(-(-asked.count() * 8 * width // limit), 1)
    asked = stored(asked.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds))), "queries") if rounds > 1 else asked.withColumn("round", F.lit(0))
    out = None
    for i in range(rounds):
        got = asked.where(F.col("round") == i).toArrow()  # about ``limit`` bytes
        ids = got["id"].to_numpy()
        vectors = got["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, width))
        found = _round(data, spark.sparkContext.broadcast((ids, vectors)), k)
        out = found if out is None else out.unionByName(found)
    return out


def _round(data: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        norms = np.sqrt((q * q).sum(1))
        best_d, best_id = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        seen = np.zeros(len(q), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            pids = batch.column("id").to_numpy()
            p = batch.column("v").flatten().to_numpy().reshape(len(pids), -1)
            own = np.sqrt((p * p).sum(1))
            order = np.argsort(own, kind="stable")
            pids, p, own = pids[order], p[order], own[order]
            for first in range(0, len(pids), BLOCK):
                block = slice(first, first + BLOCK)
                ids, x, low, high = pids[block], p[block], own[block][0], own[block][-1]
                # Two points are at least as far apart as their norms; a little more is allowed for rounding.
                gap = np.maximum(np.maximum(low - norms, norms - high), 0)
                open_ = np.flatnonzero(gap <= best_d[:, -1] * (1 + 1e-9) + 1e-9)
                for part in range(0, len(open_), 64):
                    rows = open_[part : part + 64]
                    rough = (norms[rows] ** 2)[:, None] - 2 * q[rows] @ x.T + (own[block] ** 2)[None, :]
                    seen[rows] += len(ids)
                    # The product is rounded, so all within its error of the k-th are measured again.
                    slack = 1e-9 * (1 + norms[rows] ** 2 + high**2)
                    if len(ids) > k + 1:  # one may be the query itself
                        edge = np.partition(rough, k, 1)[:, k]
                        edge = np.minimum(edge, np.square(best_d[rows, -1]))
                    else:
                        edge = np.square(best_d[rows, -1])
                    for i, row in enumerate(rows):
                        near = np.flatnonzero(rough[i] <= edge[i] + slack[i])
                        near = near[ids[near] != qids[row]]
                        if not len(near):
                            continue
                        d = np.concatenate([best_d[row], np.sqrt(((x[near] - q[row]) ** 2).sum(1))])
                        known = np.concatenate([best_id[row], ids[near]])
                        order = np.lexsort((known, d))[:k]
                        best_d[row], best_id[row] = d[order], known[order]
        at, rank = np.nonzero(np.isfinite(best_d))
        none = pa.nulls(len(q), pa.int64())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(best_id[at, rank]), pa.array(best_d[at, rank]), pa.nulls(len(at), pa.int64())], names=["query_id", "nn_id", "d", "visited"])
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(qids), none, pa.nulls(len(q), pa.float64()), pa.array(seen)], names=["query_id", "nn_id", "d", "visited"])

    return data.mapInArrow(run, "query_id long, nn_id long, d double, visited long")
