"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of hashed word n-grams. Sizes fall in bands; sets whose similarity reaches the threshold are in
the same band or in adjacent ones, and differ in at most ``k`` elements, a bound that the band gives. The
domain is cut into ``k // 2 + 1`` first-level partitions, of which one at least holds no more than one difference, and each
of them into a few second-level ones, of which all but one must then agree: the subsets that leave one out are
enumerated, and two similar sets share one of their signatures. How many second-level partitions a band has is chosen by cost: more give
more signatures, of more elements each, which fewer documents share by a common passage alone. Some subsets hold next to nothing and would be shared by many
unrelated documents; ``spare`` more partitions make up for leaving theirs out, and a document that has more of them
than that keeps them all.

Equal sets are one class from the start. Classes that share a signature form a group, whose members are
compared with its leader, then, as far as they are still apart, with each other. A comparison first takes
parity bitmaps, whose distance is never above the sets' own, so it only discards what can't be similar; what is left is
decided on the sets. A pair within one component is not compared. Each round compares a member with its nearest
candidates first and ends when none is left, so no link that joins two components is missed.

A class is told by 128 bits, of which 64 are its name; sets with one name and different bits are named anew. Within a comparison, decisions
are exact up to equal 64-bit hashes of different n-grams or words. A signature that very many classes share is dealt over many tasks.

Defined cases: a text with fewer words than an n-gram is one element; without words, or null, it is linked with
nothing; a null id sorts first in a component, as the least id that isn't null is taken; repeated rows are equal
sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Kept, discard, map_batches, release, stored, with_text, word_hashes
from quarry.llm.components import components

#: Growth of the size bands; elements below which a subset is light; share of partitions added for the light ones.
GROWTH, LIGHT, SPARE = 1.6, 2, 0.06
#: Second-level partitions to choose from. A signature costs 1, and COMMON times the chance that its elements all lie in a passage of PASSAGE of a document.
PARTS, COMMON, PASSAGE = (2, 3, 4), 100, 0.25
#: Rows of a signature from which it is dealt over tasks, into how many, and how many signatures are looked for (the sketch tracks 40 times as many).
HOT, DEALT, MOST_HOT = 200_000, 64, 1000
#: Classes that a task remembers as sent, in each of two generations.
SENT = 100_000
#: Members of a group that one task compares; nearest candidates of a member in the first round, and their growth.
SPLIT, NEAREST, MORE = 8000, 4, 64
#: Rows of groups with one leader that share a task's bitmaps.
SHARED = 50_000
#: Members up to which a group just lists its pairs: the same few pairs come from many groups, and are tried once.
LISTED = 16
#: Ids of documents to look up that are broadcast at most; beyond, the lookup is a shuffle.
SMALL = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct hashed n-grams of each text, lower-cased in A-Z."""
    out = []
    for ids in word_hashes([t.encode("utf-8", "replace").lower().split() for t in texts]):
        size = min(words, len(ids))
        n = len(ids) - size + 1 if size else 0
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = (h ^ ids[i : i + n]) * _ODD
            h ^= h >> np.uint64(32)
        out.append(np.unique(_mix(h)))
    return out


@lru_cache(maxsize=None)
def bands(percent: int) -> tuple[tuple[int, int], ...]:
    """First and last size of each band; a band is wider than a similar pair's sizes can be apart."""
    out, first = [], 1
    while first < 1 << 40:
        last = max(first, int(first * max(GROWTH, 101 / percent)))
        out.append((first, last))
        first = last + 1
    return tuple(out)


@lru_cache(maxsize=None)
def _starts(percent: int) -> np.ndarray:
    return np.array([a for a, _ in bands(percent)])


def band(size: int, percent: int) -> int:
    return int(np.searchsorted(_starts(percent), size, "right")) - 1


def most_apart(smaller: int, percent: int) -> int:
    """The greatest symmetric difference of two similar sets, the smaller of at most this size."""
    return smaller * (100 - percent) // percent


@lru_cache(maxsize=None)
def partitions(b: int, percent: int) -> tuple[int, int, int]:
    """First-level partitions of a band, second-level ones of each, and how many of the first may be left out."""
    first, last = bands(percent)[b]
    k = most_apart(last, percent)
    if not k:
        return 1, 1, 0
    spare = int(SPARE * (k // 2 + 1)) + 1
    n = k // 2 + 1 + spare
    cost = lambda parts: parts * n * (1 + COMMON * PASSAGE ** ((first + last) / 2 / n * (parts - 1) / parts))
    return n, min(PARTS, key=cost), spare


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """Of a set: for its own band, and for the band below if a similar set may be there."""
    size, at, out = len(own), band(len(own), percent), []
    for b in (at, at - 1):
        if b < 0 or b < at and -(-size * percent // 100) > bands(percent)[b][1]:
            continue
        n, parts, spare = partitions(b, percent)
        values = _mix(own ^ np.uint64(b + 1))
        cell = (values >> np.uint64(24)) % np.uint64(n * parts)
        order = np.argsort(cell, kind="stable")
        which, start, count = np.unique(cell[order], return_index=True, return_counts=True)
        sums, counts = np.zeros(n * parts, np.uint64), np.zeros(n * parts, np.int64)
        sums[which], counts[which] = np.add.reduceat(_mix(values[order]), start), count
        sums, counts = sums.reshape(n, parts), counts.reshape(n, parts)
        if parts > 1:  # all but one of a partition's parts
            sums, counts = sums.sum(1, dtype=np.uint64)[:, None] - sums, counts.sum(1)[:, None] - counts
        names = np.arange(n * parts, dtype=np.uint64).reshape(n, parts)
        light = (counts < LIGHT).any(1)
        if light.sum() <= spare:
            sums, names = sums[~light], names[~light]
        out.append(_mix(sums ^ _mix(names * _ODD + np.uint64(b + 1))).ravel())
    return np.concatenate(out).view(np.int64)


def bitmap(own: np.ndarray, percent: int) -> bytes:
    """Parities of the elements by hash: a difference in a bit needs a difference in an element."""
    bits = 256
    while bits < 8 * most_apart(bands(percent)[band(len(own), percent)][1], percent):
        bits *= 2
    return np.packbits(np.bincount((own >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of equal length, longer ones folded onto themselves; parities stay parities."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), 0)
    return out


def _allowed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The greatest symmetric difference of similar sets of these sizes, or -1."""
    possible = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return np.where(possible, (100 - percent) * (a + b) // (100 + percent), -1)


def _names(own: np.ndarray, bits: int = 64) -> tuple[int, int] | tuple[None, None]:
    """A set's name and what else tells it."""
    if not len(own):
        return None, None
    both = xxhash.xxh3_128_intdigest(own.tobytes())
    return (both >> 64 & ((1 << bits) - 1)) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def records(docs: DataFrame, words: int, percent: int, bits: int = 64) -> DataFrame:
    """doc_id, n, c and c2 (the class: 128 bits of a hash of the set; null for an empty one), and, if the task hasn't sent them for the class lately, its bitmap and signatures."""
    sent = Kept(SENT)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n": [], "c": [], "c2": [], "bits": [], "sigs": []}
        own = shingles(batch.column("text").to_pylist(), words)
        named = [_names(x, bits) for x in own]
        fresh = sent.missing({c for c in named if c[0] is not None})
        for x, c in zip(own, named, strict=True):
            first = c in fresh
            if first:
                fresh.discard(c)
                sent.new[c] = None
            for k, v in zip(out, (len(x), *c, bitmap(x, percent) if first else None, signatures(x, percent) if first else None), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    return map_batches(with_text(docs, "doc_id"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, c long, c2 long, bits binary, sigs array<long>")


def renamed(whole: DataFrame) -> DataFrame:
    """The records with one name for each class: where sets share a name, all classes are numbered."""
    if whole.where("c IS NOT NULL").groupBy("c").agg(F.min("c2").alias("a"), F.max("c2").alias("b")).where("a != b").isEmpty():
        return whole
    names = stored(whole.where("c IS NOT NULL").select("c", "c2").distinct().select(F.col("c").alias("old"), F.col("c2").alias("old2"), F.monotonically_increasing_id().alias("name")), "class-names")
    both = whole.join(names, (whole.c == names.old) & (whole.c2 == names.old2), "left")
    return stored(both.select("doc_id", "n", F.col("name").alias("c"), "c2", "bits", "sigs"), "records")


def hot_signatures(rows: DataFrame, hot: int = HOT) -> list[int]:
    """Signatures that may have ``hot`` rows or more, found in one pass; to deal one that hasn't is harmless."""
    found = rows.agg(F.expr(f"approx_top_k(sig, {MOST_HOT}, {40 * MOST_HOT})").alias("top")).first().top
    return [x.item for x in found or [] if x["count"] >= hot]


def groups(found: DataFrame, hot: int = HOT) -> DataFrame:
    """sig, c, leader of every class that shares a signature with another; the leader is the group's least class.

    One shuffle of narrow rows; a group is read in order and never held. A hot signature's rows are dealt by class over several tasks,
    each of which finds the least of its own, and the least of those leads.
    """
    rows = found.select(F.explode("sigs").alias("sig"), "c")
    dealt = hot_signatures(rows, hot)
    if not dealt:
        return _grouped(rows)
    at = F.col("sig").isin(dealt)
    plain = _grouped(rows.where(~at))
    parts = stored(_grouped(rows.where(at).withColumn("of", F.pmod(F.xxhash64("c"), F.lit(DEALT))), "of", True), "dealt-members")
    least = F.broadcast(parts.groupBy("sig").agg(F.min("leader").alias("least")))  # at most MOST_HOT rows
    return plain.unionByName(parts.join(least, "sig").select("sig", "c", F.col("least").alias("leader")))


def _grouped(rows: DataFrame, by: str = "sig", alone_too: bool = False) -> DataFrame:
    """Groups of a signature, or of a signature and a share of its rows, whose members are sent even if alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_of = last_c = leader = None
        pending = False  # the last row was a leader that hasn't been sent
        for batch in batches:
            sig, of, c = (batch.column(x).to_numpy() for x in ("sig", by, "c"))
            if not len(sig):
                continue
            if last_sig is not None:
                sig, of, c = np.concatenate([[last_sig], sig]), np.concatenate([[last_of], of]), np.concatenate([[last_c], c])
            start = np.ones(len(sig), bool)
            start[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
            repeat = np.zeros(len(sig), bool)
            repeat[1:] = ~start[1:] & (c[1:] == c[:-1])
            runs = np.cumsum(start) - 1
            lead = c[np.flatnonzero(start)]
            if last_sig is not None:
                lead[0] = leader
            follows = ~start & ~repeat
            if last_sig is not None:
                repeat[0] = True  # it has been judged before
            send = follows.copy()
            heads = np.flatnonzero(start)
            some = np.bincount(runs, follows, minlength=len(heads)) > 0
            fresh = some | alone_too
            if last_sig is not None:
                fresh[0] = not alone_too and some[0] and pending
            send[heads[fresh]] = True
            values = np.where(start & send, lead[runs], c)
            last_sig, last_of, last_c, leader = sig[-1], of[-1], c[-1], lead[-1]
            alone = not some[-1]
            pending = alone and (pending if len(heads) == 1 and start[0] and repeat[0] else True)
            if send.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[send]), pa.array(values[send]), pa.array(lead[runs][send])], names=["sig", "c", "leader"])

    key = list(dict.fromkeys(["sig", by]))
    return rows.repartition(*key).sortWithinPartitions(*key, "c").mapInArrow(run, "sig long, c long, leader long")


def near(edges: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges`` (u, v, shared) whose sizes and bitmaps allow a link."""
    side = lambda x: info.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("bits_u").to_pylist(), batch.column("bits_v").to_pylist()
            apart = np.array([int(np.bitwise_count(np.bitwise_xor(*_folded([x, y], min(len(x), len(y))))).sum()) for x, y in zip(a, b, strict=True)])
            keep = apart <= _allowed(batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy(), percent)
            yield batch.select(["u", "v", "shared"]).filter(pa.array(keep))
        release()

    return edges.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long, shared long")


def sets(docs: DataFrame, info: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """c and its set, for the classes in ``nodes``: their texts are read again instead of being stored for all."""
    wanted = info.join(nodes.distinct(), "c", "left_semi").select(F.col("c").alias("wanted"), F.col("c2").alias("rest"), F.col("rep").alias("rep"))
    wanted = stored(wanted, "wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    rows = with_text(docs, "doc_id").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batch: pa.RecordBatch) -> dict:
        own = shingles(batch.column("text").to_pylist(), words)
        rest = [_names(x)[1] for x in own]
        wanted = batch.column("wanted").to_pylist()
        keep = [i for i, (x, y) in enumerate(zip(rest, batch.column("rest").to_pylist(), strict=True)) if x == y]
        return {"c": [wanted[i] for i in keep], "set": [own[i].tobytes() for i in keep]}

    return stored(map_batches(rows, run, "c long, set binary"), "sets")


def verified(edges: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges`` that are links: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    side = lambda x: known.select(F.col("c").alias(x), F.col("set").alias(f"set_{x}"))
    return edges.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def apart(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``edges`` whose ends are in different components."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    both = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).drop("root_u", "root_v")


def distinct_groups(members: DataFrame) -> DataFrame:
    """sig, c, leader, size of the groups of three or more, one of those with the same members: the others would repeat its comparisons.

    Groups of two are settled by their leader. Members are told by two sums of independent hashes, over 128 bits, and the size.
    """
    prints = [F.sum(F.xxhash64(*x).cast("decimal(20,0)")).alias(name) for name, x in (("print", (F.col("c"),)), ("print2", (F.lit(1), F.col("c"))))]
    known = members.groupBy("sig").agg(F.count("*").alias("size"), *prints).where("size > 2")
    one = known.groupBy("size", "print", "print2").agg(F.min("sig").alias("sig"))
    return stored(members.join(stored(one.select("sig", "size"), "distinct-groups"), "sig"), "group-members")


def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, c, leader, comp and size of the groups that are in several components."""
    rows = members.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
    rows = stored(rows, "labelled-members")
    several = rows.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b")
    return stored(rows.join(stored(several.select("sig"), "open"), "sig"), "open-groups")


def listed_pairs(rows: DataFrame) -> DataFrame:
    """u and v of all pairs across components in groups of at most LISTED members: fewer than LISTED a row, and narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([kept, np.stack([batch.column(x).to_numpy() for x in ("sig", "c", "comp")])], 1)
            sig, c, comp = rows
            first = kept.shape[1]
            at, to = [], []
            for gap in range(1, min(LISTED, rows.shape[1])):
                a = np.flatnonzero((sig[:-gap] == sig[gap:]) & (comp[:-gap] != comp[gap:]))
                a = a[a + gap >= first]  # pairs of rows from before have been sent
                at.append(a)
                to.append(a + gap)
            if at and sum(map(len, at)):
                pairs = np.unique(np.stack([c[np.concatenate(at)], c[np.concatenate(to)]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])
            kept = rows[:, -(LISTED - 1) :]

    dealt = rows.where(F.col("size") <= LISTED).select("sig", "c", "comp").repartition("sig").sortWithinPartitions("sig", "c")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def open_pairs(rows: DataFrame, info: DataFrame, percent: int, nearest: int) -> DataFrame:
    """u, v, whether there were more, and the group: each member's ``nearest`` candidates in other components, and of those the ``nearest`` between any two components.

    A group beyond SPLIT members is dealt into blocks, and pairs of blocks are compared by different tasks. Groups with
    one leader mostly have the same members, so they go to the same task, up to SHARED rows, and with them one
    bitmap for each member instead of one for each group.
    """
    rows = rows.where(F.col("size") > LISTED)
    rows = rows.withColumn("of", F.ceil(F.col("size") / SPLIT).cast("long")).withColumn("mine", F.pmod(F.xxhash64("c"), F.col("of")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    rows = rows.select("leader", "sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "comp")
    parts = stored(rows.groupBy("leader").agg(F.ceil(F.count("*") / SHARED).cast("long").alias("parts")), "leaders")
    rows = stored(rows.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("sig", "i", "j"), F.col("parts"))).drop("parts"), "dealt-groups")
    maps = rows.select("leader", "part", "c").distinct().join(info.select("c", "n", "bits"), "c")
    none = F.lit(None).cast("long")
    both = rows.select("leader", "part", F.lit(1).alias("kind"), "sig", "i", "j", "c", "mine", "comp", none.alias("n"), F.lit(None).cast("binary").alias("bits"))
    both = both.unionByName(maps.select("leader", "part", F.lit(0).alias("kind"), none.alias("sig"), none.alias("i"), none.alias("j"), "c", none.alias("mine"), none.alias("comp"), "n", "bits"))

    def pairs(group: list[pa.RecordBatch], known: dict[int, tuple[int, bytes]]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(group)
        c, comp, mine = (table[x].to_numpy() for x in ("c", "comp", "mine"))
        own = [known[x] for x in c.tolist()]
        n, maps = np.array([x for x, _ in own]), [x for _, x in own]
        maps = _folded(maps, min(map(len, maps)))
        split = table["i"][0] != table["j"][0]
        found: list[tuple[int, int, int, int, int, bool]] = []
        for first in range(0, len(c), 64):
            block = slice(first, first + 64)
            far = np.zeros((len(c[block]), len(c)), np.int64)
            for word in range(maps.shape[1]):
                far += np.bitwise_count(maps[block, word][:, None] ^ maps[:, word][None, :])
            fits = (far <= _allowed(n[block][:, None], n[None, :], percent)) & (comp[block][:, None] != comp[None, :])
            if split:
                fits &= mine[block][:, None] != mine[None, :]
            for row in np.flatnonzero(fits.any(1)):
                cols = np.flatnonzero(fits[row])
                cut = len(cols) > nearest
                if cut:
                    cols = cols[np.lexsort((c[cols], far[row, cols]))[:nearest]]
                for col in cols.tolist():
                    a, b = sorted(((int(comp[first + row]), int(c[first + row])), (int(comp[col]), int(c[col]))))
                    found.append((a[0], b[0], int(far[row, col]), a[1], b[1], cut))
        # Of two components, the nearest pairs only; the others wait for a later round.
        out: dict[tuple[int, int], bool] = {}
        for _, own in groupby(sorted(set(found)), lambda x: x[:2]):
            own = list(own)
            for _, _, _, x, y, cut in own[:nearest]:
                pair = min(x, y), max(x, y)
                out[pair] = out.get(pair, False) or cut or len(own) > nearest
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64()), pa.array(list(out.values()))], names=["u", "v", "cut"]).append_column("sig", pa.repeat(table["sig"][0], len(out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = task = None
        known: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).fill_null(0).to_numpy() for x in ("leader", "part", "kind", "sig", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now, piece = tuple(keys[:, a].tolist()), batch.slice(a, b - a)
                if now != key and held:
                    if (out := pairs(held, known)) is not None:
                        yield out
                    held = []
                key = now
                if now[:2] != task:
                    task, known = now[:2], {}
                if now[2]:
                    held.append(piece)
                else:
                    known.update(zip(piece.column("c").to_pylist(), zip(piece.column("n").to_pylist(), piece.column("bits").to_pylist(), strict=True), strict=True))
        if held and (out := pairs(held, known)) is not None:
            yield out
        release()

    dealt = both.repartition("leader", "part").sortWithinPartitions("leader", "part", "kind", "sig", "i", "j", "c")
    return dealt.mapInArrow(run, "u long, v long, cut boolean, sig long")


def link(docs: DataFrame, words: int = 4, percent: int = 85, bits: int = 64, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The records of all documents, and node and root of the classes that have links. ``bits`` are those of a class's name."""
    whole = renamed(stored(records(docs, words, percent, bits), "records"))
    members = stored(groups(whole, hot), "members")
    found = stored(whole.drop("sigs"), "classes-of")
    discard(whole)  # the signatures are the largest table, and have done their part
    info = found.where("bits IS NOT NULL").join(members.select("c").distinct(), "c", "left_semi")
    info = stored(info.groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("c2").alias("c2"), F.first("bits").alias("bits")), "classes")
    stars = members.where("c != leader").groupBy(F.col("leader").alias("u"), F.col("c").alias("v")).agg(F.count("*").alias("shared"))
    stars = stored(near(stars, info, percent), "stars")
    known = sets(docs, info, stars.select(F.col("u").alias("c")).unionByName(stars.select(F.col("v").alias("c"))), words)
    # The leader that shares most first; the others only where that hasn't joined the two.
    best = stars.groupBy("v").agg(F.max_by("u", F.struct("shared", "u")).alias("u"))
    links = stored(verified(best, known, percent), "links")
    labels = stored(components(links), "labels")
    left = stored(apart(stars, labels).join(best, ["u", "v"], "left_anti"), "other-stars")
    if not left.isEmpty():
        links = links.unionByName(stored(verified(left, known, percent), "links"))
        labels = stored(components(links), "labels")
    discard(known)
    every, members = members, distinct_groups(members)
    discard(every)
    tested = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    nearest = NEAREST
    first = True
    while True:
        rows = open_groups(members, labels)
        pairs = stored(open_pairs(rows, info, percent, nearest), "pairs")
        fresh = pairs.select("u", "v").distinct()
        if first:
            fresh = fresh.unionByName(listed_pairs(rows)).distinct()
        fresh = stored(near(fresh.withColumn("shared", F.lit(1).cast("long")).join(tested, ["u", "v"], "left_anti"), info, percent), "fresh-pairs")
        if not fresh.isEmpty():
            own = sets(docs, info, fresh.select(F.col("u").alias("c")).unionByName(fresh.select(F.col("v").alias("c"))), words)
            links = links.unionByName(stored(verified(fresh, own, percent), "links"))
            discard(own)
            labels = stored(components(links), "labels")
            tested = tested.unionByName(fresh.select("u", "v"))
        # Groups that have sent all their candidates are done.
        more = pairs.where("cut").select("sig").distinct()
        if more.isEmpty():
            return found, labels
        members = stored(members.join(more, "sig", "left_semi"), "group-members")
        nearest, first = nearest * MORE, False


def classes(docs: DataFrame, words: int = 4, percent: int = 85, bits: int = 64, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and component_size of every document."""
    found, labels = link(docs, words, percent, bits, hot)
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "c").join(labels.withColumnRenamed("node", "c"), "c", "left")
    rows = stored(rows.withColumn("root", F.coalesce("root", "c")).drop("c"), "rooted")
    heads = stored(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")), "heads")
    return rows.join(heads, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"), F.coalesce("size", F.lit(1)).alias("component_size"))
