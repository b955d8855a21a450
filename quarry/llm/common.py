"""What the operators of this folder share: reading tables and streaming documents through Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import discard, ship, stored

__all__ = ["BATCH_BYTES", "WORD", "Kept", "arrow_batches", "discard", "map_batches", "read", "release", "stored", "text_batches", "with_text", "word_hashes", "worker_cache"]

#: A word in the contracts' sense: a run of anything but ASCII white space. ``bytes.split()`` splits by the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handed to one call of a per-batch function, so that memory doesn't depend on how many rows Arrow puts in a batch.
BATCH_BYTES = 2 << 20
#: Words whose hashes a worker keeps in each of two generations, and the greatest length in bytes of one.
WORDS, WORD_BYTES = 120_000, 64

_cache: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What this worker keeps from task to task under a key. One thing at a time, as workers outlive operators: another key's goes."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


class Kept:
    """A dictionary of two generations: what hasn't been asked for since the older one was new is forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those that aren't known; the known ones are in ``new`` afterwards."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        asked = keys - self.new.keys()
        again = asked & self.old.keys()
        old = self.old
        self.new.update({k: old[k] for k in again})
        return asked - again

    def forget_long(self, keys: set, longest: int) -> None:
        for k in keys:
            if len(k) > longest:
                del self.new[k]


def word_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    kept = worker_cache("words", lambda: Kept(WORDS))
    fresh = kept.missing(set().union(*texts))
    kept.new.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
    known = kept.new
    out = [np.fromiter(map(known.__getitem__, own), np.uint64, len(own)) for own in texts]
    kept.forget_long(fresh, WORD_BYTES)
    return out


def release() -> None:
    """Give freed memory back: a worker that waits for its next task holds no more than its cache."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, *keys: str) -> DataFrame:
    """Only the columns an operator needs, null text as empty; columns that clash with its own names go here."""
    return docs.select(*(F.col(k) for k in keys), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, and of one row where a row is longer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size + 1
        yield batch.slice(first, n - first)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """What is planned inside hands Python batches of about ``limit`` bytes: by Spark's own limits, long texts fill 64 MB on both sides of each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: T.StructType | str, column: str = "text") -> DataFrame:
    """``fn`` over slices of bounded text; it returns columns by name in the order of ``schema``."""
    ship(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, column):
            out = fn(part)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            if out is not None and out.num_rows:
                yield out
        release()

    return df.mapInArrow(run, kind)
