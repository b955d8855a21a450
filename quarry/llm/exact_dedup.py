"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and get integer
names, one for each content; then adjacent names are paired and the pairs named in turn, until
each document has one name. Equal names mean equal texts: nothing rests on a hash being unique.

A block's 64-bit hash only carries the lookup: a name belongs to (hash, rank among the blocks
with that hash). Where two contents share a hash, the lookup compares the content itself. So block
contents are shuffled once, after each task has merged its equal ones, and all later rows are
narrow. Copies, however many, are merged before the shuffle and never gathered in a list.

Defined cases: null text counts as empty, and empty texts are equal; rows with equal doc_id are
still rows of their own; the null id is the smallest; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, stored, with_text

#: Bytes in a block.
BLOCK = 4096


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """Normalised texts: ``bytes.lower`` changes A-Z only."""
    return [x.lower() for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _cut(text: bytes, block: int) -> list[bytes]:
    return [text[i : i + block] for i in range(0, len(text), block)] or [b""]


def _hash(block: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(block) & ((1 << bits) - 1)) - (1 << 63 if bits == 64 else 0)


def _blocks(docs: DataFrame, block: int, bits: int) -> DataFrame:
    """h, block: the contents, without those that the same batch has had."""

    def cut(batch: pa.RecordBatch) -> dict:
        found = {b: None for text in _texts(batch) for b in _cut(text, block)}
        return {"h": [_hash(b, bits) for b in found], "block": list(found)}

    return map_batches(with_text(docs), cut, "h long, block binary")


def _names(blocks: DataFrame) -> tuple[DataFrame, bool]:
    """h, name, content: a row for each distinct block, and whether any hash has two contents; content is null where a hash has one.

    Blocks are merged in each task, shuffled by content, sorted and numbered, so names are unique over all partitions.
    """
    number = F.monotonically_increasing_id().alias("name")
    distinct = blocks.groupBy("h", "block").agg(F.count("*").alias("n"))
    names = stored(distinct.sortWithinPartitions("block", "h").select("h", number), "block-names")
    twice = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    names = names.withColumn("content", F.lit(None).cast("binary"))
    if twice.isEmpty():
        return names, False
    twice = stored(twice, "clashes")
    apart = blocks.join(twice, "h", "left_semi").groupBy("h", "block").agg(F.count("*").alias("n")).sortWithinPartitions("block", "h")
    apart = stored(apart.select("h", number, F.col("block").alias("content")).withColumn("name", -F.col("name") - 2), "clash-names")
    return names.join(twice, "h", "left_anti").unionByName(apart), True


def _rows(docs: DataFrame, block: int, bits: int, contents: bool) -> DataFrame:
    """A row for each block of each document; the first also carries the document's columns."""

    def cut(batch: pa.RecordBatch) -> dict:
        rid, doc_id, first, at, n, h, sha, content = [], [], [], [], [], [], [], []
        rids, ids = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
        for r, d, text in zip(rids, ids, _texts(batch), strict=True):
            parts = _cut(text, block)
            k = len(parts)
            rid += [r] * k
            at += range(k)
            n += [k] * k
            h += [_hash(b, bits) for b in parts]
            doc_id += [d] + [None] * (k - 1)
            sha += [hashlib.sha256(text).hexdigest()] + [None] * (k - 1)
            content += parts if contents else [None] * k
        return {"rid": rid, "doc_id": doc_id, "at": np.array(at, np.int64), "n": np.array(n, np.int64), "h": h, "text_sha256": sha, "block": content}

    tagged = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(tagged, cut, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, n long, h long, text_sha256 string, block binary")


def identities(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, n (blocks) and name of every row; (n, name) is equal for equal texts alone."""
    names, clashes = _names(_blocks(docs, block, hash_bits))
    rows = _rows(docs, block, hash_bits, clashes)
    match = rows.h == names.h
    if clashes:
        match &= names.content.isNull() | (names.content == rows.block)
    rows = rows.join(names, match)
    level = stored(rows.select("rid", "doc_id", "at", "n", F.col("n").alias("left"), "text_sha256", "name"), "named-blocks")
    done = []
    while True:
        done.append(level.where("left = 1").select("doc_id", "text_sha256", "n", "name"))
        level = level.where("left > 1")
        if level.isEmpty():
            break
        pairs = level.groupBy("rid", F.expr("at div 2").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"),
            F.max("doc_id").alias("doc_id"),
            F.max("text_sha256").alias("text_sha256"),
            F.max("n").alias("n"),
            F.max("left").alias("left"),
        )
        pairs = stored(pairs.withColumn("b", F.coalesce("b", F.lit(-1))).withColumn("left", F.expr("(left + 1) div 2")), "pairs")
        fresh = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("k")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")
        level = stored(pairs.join(fresh, ["a", "b"]).select("rid", "doc_id", "at", "n", "left", "text_sha256", "name"), "named-pairs")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the largest doc_id of equal texts stays.

    Of rows with equal text and equal doc_id, all have kept true: they can't be told apart by id.
    """
    found = identities(docs, block, hash_bits)
    sizes = stored(found.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")  # a plain table, so that Spark can split a large group in the join
    return found.join(sizes, ["n", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
