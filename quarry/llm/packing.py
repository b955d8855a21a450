"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces are range-sorted by length by Spark, which gives each its rank, and placed by rank in parallel. The matching between is not
distributed: the rounds of successor sweeps over range-sorted gap tables are collapsed into one loop on the driver. Pieces
of one length are interchangeable, and so are bins of one gap, so runs (a length and how many pieces have it, a gap and how many bins
have it) stand for whole tables, and there are at most ``capacity`` of either whatever the input's size. In each step the longest
unplaced length goes to its successor among the gaps, the smallest that holds it; conflicts
within the run go by rank; the gaps are updated and the step repeats. Sweeps over the tables themselves would make the same
matches with a shuffle for each round.

The runs are bounded: a matched gap more than halves (g mod l < g / 2), so each of the at most
3 * capacity runs is matched at most log2(capacity) times.

Defined cases: null or empty text is its end token alone; repeated rows are packed each on
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BATCH_BYTES, arrow_batches, map_batches, release, stored, with_text
from quarry.llm.tokens import WordEncoder, default_path

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0


class Placed(NamedTuple):
    """Pieces of ``length`` with ranks from ``first``: ``each`` to a bin, from ``bin`` on, the first of each at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    each: int
    offset: int


def match(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placed], int]:
    """Best-fit decreasing over runs: where each length's ranks go, and the number of bins."""
    runs: list[tuple[int, int, int]] = []  # gap, first bin, number of bins
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(runs, (length,))
            if at == len(runs):
                fresh = -(-left // (capacity // length))
                runs.append((capacity, bins, fresh))
                bins += fresh
            gap, first, many = runs.pop(at)
            each = gap // length
            for filled, per in ((min(many, left // each), each), (1, left % each)):
                if filled and per and left and many >= filled:
                    out.append(Placed(length, rank, filled * per, first, per, capacity - gap))
                    if gap - per * length:
                        insort(runs, (gap - per * length, first, filled))
                    rank, left, first, many = rank + filled * per, left - filled * per, first + filled, many - filled
            if many:
                insort(runs, (gap, first, many))
    return out, bins


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and its end token, cut only where longer than a sequence."""
    path = path or default_path()

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.array([END], "<u4").tobytes()
        encoded = WordEncoder.of(path).encode(batch.column("text").to_pylist())
        release()  # a slice's arrays take as much as the cache
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for k, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[k].append(v)
        return out

    return map_batches(with_text(docs, "doc_id"), cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    with arrow_batches(docs.sparkSession, 2 * BATCH_BYTES):
        cut = stored(pieces(docs, capacity, path), "pieces")
    order = ("length", "doc_id", "piece")
    ranked = stored(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked-pieces")
    parts = {r.part: r.n for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    counts = {r.length: r.n for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = match(counts, capacity)
    before = np.zeros(max(parts, default=0) + 1, np.int64)
    before[1:] = np.cumsum([parts.get(i, 0) for i in range(len(before) - 1)])
    begin, held = {}, 0
    for length in sorted(counts):
        begin[length], held = held, held + counts[length]
    table = np.array(sorted((begin[p.length] + p.first, p.bin, p.each, p.offset) for p in placed), np.int64).reshape(-1, 4)
    columns = cut.columns
    shared = ranked.sparkSession.sparkContext.broadcast((before, table))

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        before, table = shared.value
        place = batch.column("place").to_numpy()
        rank = before[place >> 33] + (place & ((1 << 33) - 1))
        run = table[np.searchsorted(table[:, 0], rank, "right") - 1]
        at = rank - run[:, 0]
        sequence, offset = run[:, 1] + at // run[:, 2], run[:, 3] + at % run[:, 2] * batch.column("length").to_numpy()
        kept = [batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(lambda batches: (put(b) for b in batches if b.num_rows), f"{', '.join(f'{n} {t}' for n, t in cut.dtypes)}, sequence_id long, offset long")
