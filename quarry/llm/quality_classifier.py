"""Quality classifier: naive Bayes support vectors.

A document's features are indicators of its n-grams, hashed: words and word pairs, n-grams of
character shapes (letter, capital, digit, each punctuation mark), and runs of one word repeated. Each
indicator is scaled by the log ratio of its counts in the two classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent. Fits that each leave out a fold give every row of
the sample a margin, and those give the logistic curve that turns margins into probabilities.

The fit takes at most ``SAMPLE`` labelled rows, those with the least hash of the id: a bound on the driver's memory.
Scoring covers every document and its whole text; the model it sends round has a fixed size.

Defined cases: null or empty text has no features and gets the score of the bias alone; a null quality isn't a
label; a document with several labels has the rounded mean, and of a labelled id's rows the least text is fitted; with labels of one class or none the score is
their smoothed share; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, with_text, word_hashes

#: Labelled rows that a fit takes at most.
SAMPLE = 8000
#: Hashed features; passes over the sample; the penalty; the count added to each feature in the log ratios.
SIZE, PASSES, PENALTY, SMOOTH = 1 << 18, 12, 1.0, 1.0
#: Folds for the curve.
FOLDS = 4
#: The longest run of one word that has a feature; the probability from which a row counts as good.
RUN, GOOD = 8, 0.3

_MARKS = ".,;:!?'\"-()#*$%&|<>/_@"


def _shapes() -> np.ndarray:
    table = np.full(0x250, 1, np.uint32)
    table[:0x80] = 5
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    table[0xC0:0xDF] = 2
    table[[9, 11, 12, 13, 32, 0xA0]], table[10] = 4, 6
    table[0x80:0xA0] = table[0xA1:0xC0] = 5
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 7 + i
    return table


_SHAPES = _shapes()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SIZE


def features(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    out = []
    for text, ids in zip(texts, word_hashes([t.encode("utf-8", "replace").lower().split() for t in texts]), strict=True):
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        shape = _SHAPES[np.minimum(points, 0x24F)]
        four = np.unique(((shape[:-3] << 15) | (shape[1:-2] << 10) | (shape[2:-1] << 5) | shape[3:]) if len(shape) > 3 else np.zeros(0, np.uint32))
        three = np.unique(four >> 5)
        two = np.unique(three >> 5)
        same = ids[1:] == ids[:-1]
        runs = []
        for k in range(2, RUN + 1):
            if not same.any():
                break
            runs.append(k)
            same = same[1:] & same[:-1] if len(same) > 1 else np.zeros(0, bool)
        parts = [_mix(ids, 1), _mix(ids[1:] * np.uint64(31) + ids[:-1], 2), _mix(four, 3), _mix(three, 4), _mix(two, 5), _mix(np.array(runs, np.uint64), 6)]
        out.append(np.unique(np.concatenate(parts)).astype(np.int32))
    return out


@dataclass
class Model:
    """``scaled``: weight times ratio of each feature; ``squares``: the ratios' squares, for a row's length; the logistic curve."""

    scaled: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.scaled[x].sum() / max(np.sqrt(self.squares[x].sum()), 1e-9) + self.bias for x in rows])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows) + self.offset, -30, 30)))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [SMOOTH + np.bincount(np.concatenate([x for x, own in zip(rows, y, strict=True) if own == side] or [np.zeros(0, np.int64)]), minlength=SIZE) for side in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Dual coordinate descent for the hinge loss; both classes weigh the same in all."""
    r = _ratios(rows, y)
    scaled = [(x, v / max(np.sqrt((v * v).sum()), 1e-9)) for x in rows for v in [r[x]]]
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, PENALTY * len(y) / (2 * max((y == 1).sum(), 1)), PENALTY * len(y) / (2 * max((y == 0).sum(), 1)))
    dual, w, bias = np.zeros(len(y)), np.zeros(SIZE), 0.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(y)):
            x, v = scaled[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1
            now = min(max(dual[i] - gradient / (2.0 if len(x) else 1.0), 0.0), most[i])  # a unit row and a constant 1
            if now != dual[i]:
                step = (now - dual[i]) * sign[i]
                w[x] += step * v
                bias += step
                dual[i] = now
    return Model(w * r, r * r, bias, 1.0, 0.0)


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with targets drawn in by a count of one, by Newton steps."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (theta - [1, 0]))
        theta = theta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model:
    """``fold``: a row's margin for the curve comes from a fit without the rows of its fold."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    model, margins = _descend(rows, y), np.full(len(y), np.nan)
    for k in range(FOLDS):
        inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(out) and len(set(y[inside].tolist())) == 2:
            margins[out] = _descend([rows[i] for i in inside], y[inside]).margin([rows[i] for i in out])
    known = ~np.isnan(margins)
    if len(set(y[known].tolist())) == 2:
        model.slope, model.offset = _curve(margins[known], y[known])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows that aren't held out."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    chosen = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = with_text(docs, "doc_id").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # an id may be repeated

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": features(batch.column("text").to_pylist())}

    got = map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x array<int>").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    column = got["x"].chunk(0) if got.num_rows else None
    x = [column[int(i)].values.to_numpy() for i in order] if column is not None else []
    ids = got["doc_id"].to_numpy()[order]
    fold = np.array([zlib.crc32(str(i).encode()) // 5 % FOLDS for i in ids], np.int64)
    return fit(x, got["label"].to_numpy()[order], fold)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in keep} | {"score": shared.value.score(features(batch.column("_text").to_pylist()))}

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    return map_batches(rows, run, f"{kinds}, score double", column="_text")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep``, score and predicted of every document."""
    return scored(docs, train(docs, labels, sample), keep).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
