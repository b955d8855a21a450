"""Quality rules: plain counts and n-gram perplexity bands by language.

The model of a language is a modified Kneser-Ney model over code points, of order ``ORDER``. Its counts are made by
Spark, and so are the discounts, the context weights and the interpolated probabilities, by joins of n-grams with their
suffixes and contexts. What comes out are two sorted arrays of 64-bit hashes, one of the n-grams of all orders and
languages with log probabilities, one of the contexts with log weights. They grow with the corpus: an array pair
holds at most ``SLICE`` entries, a larger model is dealt into slices by the two symbols before the last, which an
n-gram, its suffixes and their contexts share, and the documents are read once for each slice.

Three things keep the model from learning what it should reject or the very text it judges.

* An n-gram counts for the texts that hold it besides the one that is judged: its count is the number of texts
  with it, less one.
* The texts that are counted are those within the band of an order-1 model of all documents: the ordinary texts of a
  language, by its symbols alone.
* Groups of near copies that hold more than one in ``SHARE`` of a language's documents count once, as the text with
  the least hash among them. Near copies are told by four minima over hashed stretches of ``STRETCH`` symbols.

A mean over n symbols varies by 1 / sqrt(n), so a document's distance from its language's median log perplexity is
taken times sqrt(n). The band lies around the quartiles of these distances, widened by multiples of the quartile
distance, and narrows with a document's length. Medians and quartiles are exact up to a millionth, over all documents
that pass the base rules, near copies counted once; a least distance keeps a band open where quartiles fall together.

Defined cases: null text has no words and fails the base rules; a null language is a language of its own; a language
whose texts share no n-gram has no model, so all of its texts are equally likely and stay; repeated rows are judged each,
equally; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, stored, with_text

#: Symbols in the longest n-gram.
ORDER = 4
#: Entries of the arrays that tasks hold at a time (12 bytes each).
SLICE = 4_000_000
#: A group of near copies counts once if it has two documents or more and more than this share of its language's; symbols in a stretch.
SHARE, STRETCH = 2000, 16
#: Quartile distances below and above, and the least distance, for a document of one symbol.
BELOW, ABOVE, LEAST_SPREAD = 6.0, 6.0, 0.5
#: The same, on both sides, for the order-1 model that tells ordinary texts.
ORDINARY = 2.0
#: The contract's rules.
SYMBOL_CHARS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 5, 10, 20

_ODD = 0x9E3779B97F4A7C15
_PAD = "\0"


def _times(k: int, by: int = _ODD) -> np.uint64:
    """A multiple, modulo 2 ** 64."""
    return np.uint64(k * by % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


# --- symbols and hashes ---


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` starts, and where each text begins and ends; a real U+0000 is read as U+FFFD."""
    pad = _PAD * (order - 1)
    joined = "".join(pad + t.replace(_PAD, "�") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + len(pad) for t in texts], dtype=np.int64)
    return points, ends - np.array([len(t) for t in texts], np.int64), ends


def salt(model: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(model))


class Hashes:
    """Hashes of the stretches that end at each position, of any order; those of a model are told by its salt."""

    def __init__(self, points: np.ndarray) -> None:
        self.sums = [np.zeros(len(points), np.uint64)]
        self.one = _mix(points.astype(np.uint64) + np.uint64(1))

    def of(self, order: int, salts: np.ndarray | np.uint64, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the stretches that end at ``at``."""
        while len(self.sums) <= order:
            longer = self.one.copy()
            if len(self.sums) > 1:
                longer[1:] += self.sums[-1][:-1] * np.uint64(_ODD)
            self.sums.append(longer)
        return _mix(self.sums[order][at] + salts + _times(order, 0xD6E8FEB86659FD93))


def near_key(points: np.ndarray) -> int:
    """Equal for most near copies of a text: four minima over its hashed stretches."""
    if len(points) < STRETCH:
        return xxhash.xxh3_64_intdigest(points.tobytes()) >> 1
    held, width = _mix(points.astype(np.uint64) + np.uint64(1)), 1
    while width < STRETCH:
        held = held[:-width] * _mix(np.array([width], np.uint64)) + held[width:]
        width *= 2
    held = _mix(held)  # turned by some bits, its order is another one
    least = [held.min(), *(((held << np.uint64(k)) | (held >> np.uint64(64 - k))).min() for k in (16, 32, 48))]
    return xxhash.xxh3_64_intdigest(np.array(least).tobytes()) >> 1


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _by_model(batch: pa.RecordBatch) -> list[tuple[str, list[int], list[str]]]:
    """model, rows and texts of each model in a batch."""
    models, texts = batch.column("model").to_pylist(), batch.column("text").to_pylist()
    rows: dict[str, list[int]] = {}
    for i, m in enumerate(models):
        rows.setdefault(m, []).append(i)
    return [(m, own, [texts[i] for i in own]) for m, own in rows.items()]


def model_of(lang: str | Column = "lang") -> Column:
    """A name for each language, null among them."""
    return F.coalesce(F.concat(F.lit("own:"), lang), F.lit("none"))


# --- counts ---


def grams_of(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The n-grams of some texts that end in one of their symbols, and how many of the texts have each."""
    points, starts, ends = symbols(texts, order)
    alphabet = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) else np.zeros(0, np.int64)
    size = max(len(alphabet), 1)
    if size**order >= 1 << 62:
        if len(texts) > 1:  # fewer texts have fewer symbols
            half = [grams_of(part, order) for part in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
            return half[0][0] + half[1][0], np.concatenate([half[0][1], half[1][1]])
        whole = points.tobytes().decode("utf-32-le", "replace")
        own = sorted({whole[i - order + 1 : i + 1] for i in range(order - 1, len(whole))})
        return own, np.ones(len(own), np.int64)
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids = place[points]
    codes = np.zeros(len(ids), np.int64)
    for k in range(order):
        codes[order - 1 :] += ids[order - 1 - k : len(ids) - k] * size**k
    parts = [np.unique(codes[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    digits = np.stack([found // size**k % size for k in range(order - 1, -1, -1)], 1)
    flat = alphabet[digits].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
    return [flat[i : i + order] for i in range(0, len(flat), order)], n


def symbol_counts(docs: DataFrame) -> DataFrame:
    """model, gram (one symbol) and n over all texts: no more rows from a batch than it has symbols."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"model": [], "gram": [], "n": []}
        for model, _, texts in _by_model(batch):
            n = np.bincount(symbols(texts, 1)[0], minlength=1)
            own = np.flatnonzero(n)
            out["model"] += [model] * len(own)
            out["gram"] += list(own.astype(np.uint32).tobytes().decode("utf-32-le", "replace"))
            out["n"] += n[own].tolist()
        return out

    return map_batches(docs, run, "model string, gram string, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def ordinary_grams(docs: DataFrame, first: Model, limits: dict[str, tuple[float, float, float]], heavy: dict[str, dict[int, int]], order: int) -> DataFrame:
    """model, gram, n: how many texts have an n-gram, of those within ``limits`` of the order-1 model, large groups of near copies once.

    ``heavy`` has the text hash that stands for a key. Texts that stand for one are merged by content first, as copies of
    them may be anywhere.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((first, limits, heavy))

    def run(batch: pa.RecordBatch) -> dict:
        first, limits, heavy = shared.value
        out: dict[str, list] = {"model": [], "gram": [], "whole": [], "n": []}
        for model, _, texts in _by_model(batch):
            points, starts, ends = symbols(texts, 1)
            loss = first.losses(model, points, starts, ends, 1)
            own, counted = heavy.get(model, {}), []
            for i, (text, a, b) in enumerate(zip(texts, starts.tolist(), ends.tolist(), strict=True)):
                if not within(loss[i], b - a, limits.get(model)):
                    continue
                stands = own.get(near_key(points[a:b])) if own else None
                if stands is None:
                    counted.append(text)
                elif stands == _text_hash(text):
                    for k, v in zip(out, (model, text, True, 1), strict=True):
                        out[k].append(v)
            grams, n = grams_of(counted, order) if counted else ([], np.zeros(0, np.int64))
            for k, v in zip(out, ([model] * len(grams), grams, [False] * len(grams), n.tolist()), strict=True):
                out[k] += v
        return out

    found = map_batches(docs, run, "model string, gram string, whole boolean, n long").groupBy("model", "gram", "whole").agg(F.sum("n").alias("n"))
    found = stored(found, "ngrams-and-texts")

    def again(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"model": [], "gram": [], "n": []}
        for model, _, texts in _by_model(batch):
            grams, n = grams_of(texts, order)
            for k, v in zip(out, ([model] * len(grams), grams, n.tolist()), strict=True):
                out[k] += v
        return out

    once = map_batches(found.where("whole").select("model", F.col("gram").alias("text")), again, "model string, gram string, n long")
    return found.where("NOT whole").select("model", "gram", "n").unionByName(once).groupBy("model", "gram").agg(F.sum("n").alias("n"))


# --- the model ---


def _discounts(counted: DataFrame) -> DataFrame:
    """model and d1, d2, d3: what modified Kneser-Ney takes off counts of 1, 2 and 3 or more."""
    n = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
    of = counted.groupBy("model").agg(*(x.alias(f"n{k}") for k, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0)

    def take(k: int) -> Column:
        value = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        bounded = F.least(F.greatest(value, F.lit(0.05)), F.lit(k - 0.05))
        return F.when(known & (F.col(f"n{k}") > 0), bounded).otherwise(F.lit(k / 2)).alias(f"d{k}")

    return of.select("model", *(take(k) for k in (1, 2, 3)))


def probabilities(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of a model with counts (model, gram, n) of its longest n-grams: model, gram, p of all orders, and model, gram, weight of all contexts.

    Shorter n-grams count the symbols found before them. The n-gram of order 0 is any symbol's share of what order 1 leaves.
    """
    levels = {order: stored(counts, f"ngrams-{order}")}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = stored(shorter, f"ngrams-{k}")
    lower = levels[1].groupBy("model").agg((1 / (F.count("*") + 1)).alias("p")).select("model", F.lit("").alias("gram"), "p")
    grams, contexts = [lower], []
    for k in range(1, order + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = levels[k].join(_discounts(levels[k]), "model").select("model", "gram", "n", taken.alias("taken"))
        rows = rows.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k - 1))
        of = stored(rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("weight")), f"contexts-{k}")
        below = lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        joined = rows.join(of, ["model", "context"]).join(below, ["model", "suffix"])
        lower = stored(joined.select("model", "gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), f"probabilities-{k}")
        grams.append(lower)
        contexts.append(of.select("model", F.col("context").alias("gram"), "weight"))
    return _all(grams), _all(contexts)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def hashed(table: DataFrame, value: str, slices: int = 1, last: int = 1) -> DataFrame:
    """slice, key and the logarithm of ``value`` of n-grams; a slice is told by two symbols, of which ``last`` - 1 follow, and is -1 for n-grams too short to have them."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, parts = np.zeros(batch.num_rows, np.uint64), np.full(batch.num_rows, -1, np.int64)
        grams = batch.column("gram").to_pylist()
        salts = np.array([salt(m) for m in batch.column("model").to_pylist()], np.uint64)
        sizes = np.array([len(g) for g in grams])
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            points = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "replace"), np.uint32)
            whole = Hashes(points)
            ends = np.arange(1, len(rows) + 1) * int(k) - 1
            keys[rows] = whole.of(int(k), salts[rows], ends) if k else _mix(salts[rows])
            if k >= last + 1:
                parts[rows] = slice_of(whole, ends - (last - 1), slices)
        return {"slice": parts, "key": keys.view(np.int64), "value": np.log(np.array(batch.column("value"))).astype(np.float32)}

    return map_batches(table.select("model", "gram", F.col(value).alias("value")), run, "slice long, key long, value float", column="gram")


def slice_of(hashes: Hashes, ends: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the two symbols that end at ``ends``; those of all models together."""
    return (hashes.of(2, np.uint64(0), ends) % np.uint64(slices)).astype(np.int64)


@dataclass
class Table:
    """Sorted hashes with values, and a last key that no search passes. ``starts`` has the place of the first key of each run of leading bits, so a lookup looks at a few."""

    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64
    starts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(len(keys).bit_length(), 1)
        starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return cls(np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(values[order], np.float32(0)), np.uint64(64 - bits), starts.astype(np.int32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which of ``keys`` are held."""
        at = self.starts[(keys >> self.shift).view(np.int64)]
        now = self.keys[at]
        hit = now == keys
        values = np.where(hit, self.values[at], np.float32(0))
        todo = np.flatnonzero(now < keys)
        at = at[todo]
        while len(todo):
            at, wanted = at + 1, keys[todo]
            now = self.keys[at]
            same = now == wanted
            values[todo[same]], hit[todo[same]] = self.values[at[same]], True
            more = now < wanted
            todo, at = todo[more], at[more]
        return values, hit


@dataclass
class Model:
    """Log probabilities of n-grams and log weights of contexts: one of ``slices`` parts, and what all parts need."""

    order: int
    grams: Table
    contexts: Table
    part: int = 0
    slices: int = 1

    def logs(self, model: str, points: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of each symbol after those before it, as far as this part has them."""
        hashes, own = Hashes(points), salt(model)
        empty = _mix(np.array([own]))[0]
        logs = np.zeros(len(points), np.float32)
        todo: np.ndarray | slice = slice(None) if self.slices == 1 else np.flatnonzero(slice_of(hashes, np.arange(len(points)) - 1, self.slices) == self.part)
        for k in range(order, -1, -1):
            value, hit = self.grams.find(hashes.of(k, own, todo) if k else np.full(len(todo), empty))
            logs[todo] += value
            todo = np.flatnonzero(~hit) if isinstance(todo, slice) else todo[~hit]
            if not k or not len(todo):
                break
            # What the context leaves to shorter n-grams; an unknown context leaves all.
            logs[todo] += self.contexts.find(hashes.of(k - 1, own, todo - 1) if k > 1 else np.full(len(todo), empty))[0]
        return logs

    def losses(self, model: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
        """Negative log probabilities of texts, as far as this part has them; ``points`` has ``order - 1`` starts before each."""
        if order == 1:  # a symbol's doesn't depend on its place
            own = np.flatnonzero(np.bincount(points, minlength=1))
            table = np.zeros(int(own[-1]) + 1 if len(own) else 1)
            table[own] = self.logs(model, own.astype(np.uint32), 1)
            logs = table[points]
        else:
            logs = self.logs(model, points, order).astype(np.float64)
            for k in range(1, order):
                logs[starts - k] = 0
        sums = np.append(0.0, np.cumsum(logs))
        return sums[starts] - sums[ends]


def parts_of(grams: DataFrame, contexts: DataFrame, order: int, limit: int = SLICE) -> list[tuple[int, int, DataFrame, DataFrame]]:
    """part, slices, and the hashed tables of each part: one part where all fits, else as many as keep a part's own entries below ``limit``."""
    entries = grams.count() + contexts.count()
    slices = max(-(-entries // limit), 1) if order > 2 else 1
    g, c = stored(hashed(grams, "p", slices, 2), "hashed-ngrams"), stored(hashed(contexts, "weight", slices, 1), "hashed-contexts")
    here = lambda t, i: t.where(F.col("slice").isin(-1, i)) if slices > 1 else t
    return [(i, slices, here(g, i), here(c, i)) for i in range(slices)]


def load(part: tuple[int, int, DataFrame, DataFrame], order: int) -> Model:
    """A part's arrays on the driver."""

    def table(rows: DataFrame) -> Table:
        got = rows.select("key", "value").toArrow()
        return Table.of(got["key"].to_numpy().view(np.uint64), got["value"].to_numpy())

    number, slices, grams, contexts = part
    return Model(order, table(grams), table(contexts), number, slices)


# --- plain counts ---


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            for at in (first, i):
                hit[at] += 1
                hit[min(at + WINDOW, len(words))] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def plain_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    points = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    return len(words), points, len(text) - len(text.translate(None, SYMBOL_CHARS)), len(lines) - len(set(lines)), repeated_words(words)


# --- bands ---


def quantiles(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """model and a column for each share: the value of that rank among the model's rows, to a millionth.

    Counts by bin of a hundredth find the bin of each rank, then counts by millionths in those bins the value, so no
    task holds more than the bins of a model.
    """
    values = values.select("model", F.col(value).alias("v")).withColumn("bin", F.floor(F.col("v") * 100))
    upto = Window.partitionBy("model").orderBy("bin")
    counted = values.groupBy("model", "bin").agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("model")))
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in shares.items())))
    found = counted.withColumn("x", ranks).withColumn("rank", F.greatest(F.ceil(F.col("x.q") * F.col("total")), F.lit(1)) - (F.col("upto") - F.col("n")))
    found = found.where("rank BETWEEN 1 AND n").select("model", "bin", F.col("x.name").alias("name"), "rank")
    fine = values.join(F.broadcast(found), ["model", "bin"]).groupBy("model", "name", "rank", F.floor(F.col("v") * 1_000_000).alias("at")).agg(F.count("*").alias("n"))
    fine = fine.withColumn("upto", F.sum("n").over(Window.partitionBy("model", "name").orderBy("at"))).where("rank BETWEEN upto - n + 1 AND upto")
    return fine.groupBy("model").agg(*(F.max(F.when(F.col("name") == name, (F.col("at") + 0.5) / 1_000_000)).alias(name) for name in shares))


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """model, middle, below, above of rows (model, near, h, size, loss): the median log perplexity, and how far a document of one symbol may be from it; near copies count once."""
    once = scored.groupBy("model", "near").agg(F.min(F.struct("h", "size", "loss")).alias("x"))
    once = once.select("model", F.col("x.size").alias("size"), (F.col("x.loss") / F.greatest("x.size", F.lit(1))).alias("log_perplexity"))
    middles = stored(quantiles(once, "log_perplexity", {"middle": 0.5}), "middles")
    apart = once.join(F.broadcast(middles), "model").withColumn("apart", (F.col("log_perplexity") - F.col("middle")) * F.sqrt(F.greatest("size", F.lit(1))))  # a row for each language
    spread = F.greatest(F.col("b") - F.col("a"), F.lit(LEAST_SPREAD))
    found = quantiles(apart, "apart", {"a": 0.25, "b": 0.75}).join(middles, "model")
    return found.select("model", "middle", (F.col("a") - below * spread).alias("below"), (F.col("b") + above * spread).alias("above"))


def within(loss: float, size: int, limits: tuple[float, float, float] | None) -> bool:
    if not size or limits is None:
        return False
    middle, below, above = limits
    return below <= (loss / size - middle) * size**0.5 <= above


def measures(docs: DataFrame, order: int, model: Model, plain: bool) -> DataFrame:
    """doc_id, model, lang, near (the near copies' key), h (the text's hash), size, loss and, if ``plain``, the plain counts of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if plain else ()

    def run(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        loss, size, near, h = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for name, rows, texts in _by_model(batch):
            points, starts, ends = symbols(texts, order)
            loss[rows] = shared.value.losses(name, points, starts, ends, order)
            size[rows] = ends - starts
            near[rows] = [near_key(points[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            h[rows] = [_text_hash(t) for t in texts]
        out = {"doc_id": batch.column("doc_id"), "model": batch.column("model"), "lang": batch.column("lang"), "near": near, "h": h, "size": size, "loss": loss}
        if plain:
            counts = [plain_counts(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out |= {k: [x[i] for x in counts] for i, k in enumerate(names)}
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, model string, lang string, near long, h long, size long, loss double" + "".join(f", {k} long" for k in names))


def heavy_groups(scored: DataFrame, share: int) -> dict[str, dict[int, int]]:
    """By model and key, the least text hash of each group of near copies that holds more than one in ``share`` of a model's documents: fewer than ``share`` a model."""
    totals = scored.groupBy("model").agg(F.count("*").alias("total"))
    groups = scored.groupBy("model", "near").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n > 1")
    out: dict[str, dict[int, int]] = {}
    for r in groups.join(F.broadcast(totals), "model").where(F.col("n") * share > F.col("total")).select("model", "near", "h").collect():  # a row for each language is broadcast
        out.setdefault(r.model, {})[r.near] = r.h
    return out


def train(docs: DataFrame, order: int = ORDER, share: int = SHARE, limit: int = SLICE) -> list[tuple[int, int, DataFrame, DataFrame]]:
    """The parts of the model of all languages of ``docs`` (doc_id, model, lang, text)."""
    grams, contexts = probabilities(symbol_counts(docs), 1)
    first = load(parts_of(grams, contexts, 1)[0], 1)
    scored = stored(measures(docs, 1, first, False).where("size > 0"), "symbol-losses")
    limits = {r.model: (r.middle, r.below, r.above) for r in bands(scored, ORDINARY, ORDINARY).collect()}  # a row for each language
    counted = ordinary_grams(docs, first, limits, heavy_groups(scored, share), order)
    others = counted.where("n > 1").withColumn("n", F.col("n") - 1)
    return parts_of(*probabilities(others, order), order, limit)


def judge(docs: DataFrame, order: int = ORDER, below: float = BELOW, above: float = ABOVE, share: int = SHARE, limit: int = SLICE) -> DataFrame:
    """Every document's measures, the band of its language at its length, base_failed and kept."""
    rows = with_text(docs, "doc_id", "lang").withColumn("model", model_of())
    parts = train(rows, order, share, limit)
    scored = stored(measures(rows, order, load(parts[0], order), True), "measures")
    for part in parts[1:]:
        # Equal texts have equal losses, so the parts meet by model and hash of the text.
        more = measures(rows, order, load(part, order), False).groupBy("model", "h", "near", "size").agg(F.max("loss").alias("more"))
        scored = stored(scored.join(stored(more, "losses").hint("merge"), ["model", "h", "near", "size"]).withColumn("loss", F.col("loss") + F.col("more")).drop("more"), "measures")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    limits = stored(bands(scored.where("NOT base_failed"), below, above), "bands")
    root = F.sqrt(F.greatest("size", F.lit(1)))
    joined = scored.join(F.broadcast(limits), "model", "left")  # a row for each language
    joined = joined.withColumn("log_perplexity", F.col("loss") / F.greatest("size", F.lit(1)))
    joined = joined.withColumn("low", F.col("middle") + F.col("below") / root).withColumn("high", F.col("middle") + F.col("above") / root)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("below", "above", "near", "h", "loss")
