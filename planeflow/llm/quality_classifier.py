"""Quality classifier by Bradley-Terry ranking.

A document's worth is a linear function of text features. Over all pairs of a preferred and a rejected labelled
document, the weights maximise the likelihood that the preferred one wins: logistic loss on feature
differences. The threshold is the quantile of the labelled scores at the rejected documents' share.

Every labelled row counts, and no pair is written out: how a row fares against all rows of the other label depends on its
worth and on how many of those have which worth, so a step of Newton's method is a pass that counts worths on a
grid (each between its two neighbours) and one that adds up slopes and curvatures. Quantiles are found by counts too.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from .quality_rules import Texts, chunks, n_dup_lines, n_letters, n_lines, n_marks, n_repeat_words, n_symbols, n_upper, n_words, word_chars
from ._words import U, mix

#: Worths are counted at these; beyond them, a row counts at the last.
GRID = np.linspace(-64, 64, 4097)
#: Parts of the grid whose feature sums stand for their rows in the mixed terms of the curvature.
PARTS = 128
#: Rows that a pass expands at once.
BLOCK = 1 << 13
#: Parts that a quantile's bracket is cut into in each of ROUNDS passes.
CUTS = 64
ROUNDS = 5
FEATURES = 15
KNOTS = (0.02, 0.1, 0.5, 0.9, 0.98)
RIDGE = 1e-3
CUT = 0.7


def _distinct_words(t: Texts) -> np.ndarray:
    """Distinct words of each text."""
    w = t.words
    own = w.text_of()
    key = np.unique(mix(w.hashes() + own.astype(U) * U(0xE7037ED1A0B428DB)), return_index=True)[1]
    return np.bincount(own[key], minlength=len(t))


def _runs(t: Texts) -> np.ndarray:
    """Words equal to the word before them."""
    h, own = t.words.hashes(), t.words.text_of()
    same = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) if len(h) else np.zeros(0, bool)
    return np.bincount(own[1:][same], minlength=len(t))


def features(t: Texts) -> np.ndarray:
    """A row for each text; an empty text has zeros, but for constants."""
    n = np.maximum(n_words(t), 1)
    size = np.maximum(np.diff(t.offsets), 1)
    lines = n_lines(t)
    cols = [
        np.log1p(n_words(t)), n_symbols(t) / n, t.bytes_in(b"|") / n, n_marks(t) / n, n_upper(t) / np.maximum(n_letters(t), 1),
        n_dup_lines(t) / lines, n_repeat_words(t) / n, _distinct_words(t) / n, np.sqrt(n) * (1 - _distinct_words(t) / n), word_chars(t) / n, _runs(t) / n,
        t.bytes_in(b"0123456789") / size, t.bytes_in(b".,;:?") / n, np.log1p(n / lines), t.bytes_in(b"<>{}[]\\/_=~^") / n,
    ]
    return np.column_stack(cols).astype(np.float64)


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The features and what each has beyond each of its knots."""
    return np.column_stack([x, *(np.maximum(0, x - k) for k in knots)])


class Ranking:
    """worth(x) = weights . standardised hinges; score() is 0.7 at the threshold."""

    def __init__(self, knots, mean, scale, weights, threshold):
        self.knots, self.mean, self.scale, self.weights, self.threshold = knots, mean, scale, weights, threshold

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((hinges(x, self.knots) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def _quantiles(total, value, shares) -> np.ndarray:
    """Quantiles of value(x)'s columns, a row for each share, as np.quantile has them: to CUTS ** -ROUNDS of the range.

    total(f, add) adds up f(x, label) over all rows' parts."""

    def ends(x, label):
        v = value(x)
        return np.stack([v.max(0), -v.min(0), np.zeros(v.shape[1])])

    top, bottom, _ = total(ends, np.maximum)
    n = int(total(lambda x, label: np.array([len(x)]), np.add)[0])
    place = np.asarray(shares) * (n - 1)
    rank = np.concatenate([np.floor(place), np.ceil(place)])[:, None]  # of the value below and the one above
    low, high = np.tile(-bottom, (len(rank), 1)), np.tile(top, (len(rank), 1))
    for _ in range(ROUNDS):
        edges = low + (high - low) * (np.arange(CUTS + 1) / CUTS)[:, None, None]
        edges[-1] = high

        def below(x, label, edges=edges):
            v = np.sort(value(x), axis=0)
            return np.stack([np.searchsorted(v[:, c], edges[:, :, c], "right") for c in range(v.shape[1])], axis=2)

        first = np.argmax(total(below, np.add) > rank, axis=0)  # the first edge that has the rank at or below it
        high = np.take_along_axis(edges, first[None], 0)[0]
        low = np.take_along_axis(edges, np.maximum(first - 1, 0)[None], 0)[0]
    share = (place - np.floor(place))[:, None]
    return high[: len(place)] * (1 - share) + high[len(place) :] * share


def _against(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each place of the grid, the mean of kernel(place - other) over the counted others."""
    return np.convolve(counts, kernel)[len(GRID) - 1 : 2 * len(GRID) - 1] / counts.sum()


def learn(total, steps: int = 12) -> Ranking:
    """Newton's method on the ridge-penalised logistic loss of all pairs' feature differences.

    total(f, add) adds up f(x, label) over the parts of all labelled rows. Without documents of both labels there are no
    pairs: all weights are 0, and every score is 0.7."""
    knots = _quantiles(total, lambda x: x, KNOTS)

    def moments(x, label):
        h = hinges(x, knots)
        return np.concatenate([h.sum(0), (h * h).sum(0), [len(x), (label == 1).sum(), (label == 0).sum()]])

    *sums, n, n_good, n_bad = total(moments, np.add)
    mean, square = np.array(sums).reshape(2, -1) / n
    scale = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-6)
    size, step_at = len(mean), GRID[1] - GRID[0]
    weights = np.zeros(size)
    distance = np.arange(-len(GRID) + 1, len(GRID)) * step_at
    lose = 1 / (1 + np.exp(np.clip(distance, -60, 60)))
    both = lose * (1 - lose)
    centres = np.linspace(GRID[0], GRID[-1], PARTS)
    for _ in range(steps if n_good and n_bad else 0):

        def worths(x, label, w=weights):
            s = np.clip((np.clip((hinges(x, knots) - mean) / scale, -8, 8)) @ w, GRID[0], GRID[-1])
            at = np.minimum(((s - GRID[0]) / step_at).astype(np.int64), len(GRID) - 2)
            part = (s - GRID[at]) / step_at
            out = np.zeros((2, len(GRID)))
            for k, own in enumerate((label == 1, label == 0)):
                out[k] += np.bincount(at[own], 1 - part[own], len(GRID)) + np.bincount(at[own] + 1, part[own], len(GRID))
            return out

        counts = total(worths, np.add)
        tables = [(_against(counts[1], lose), _against(counts[1], both)), (_against(counts[0], lose[::-1]), _against(counts[0], both))]
        held = np.flatnonzero(counts.sum(0))
        centres = np.linspace(GRID[held[0]], GRID[held[-1]], PARTS)
        span = max(centres[-1] - centres[0], 1e-9)

        def slopes(x, label, w=weights, tables=tables, low=centres[0], span=span):
            z = np.clip((hinges(x, knots) - mean) / scale, -8, 8)
            s = z @ w
            out = [np.zeros(size), np.zeros((size, size)), np.zeros((2, PARTS, size))]
            for k, (own, sign, rows) in enumerate(((label == 1, -1, n_good), (label == 0, 1, n_bad))):
                zk, sk = z[own], np.clip(s[own], GRID[0], GRID[-1])
                out[0] += sign / rows * (np.interp(sk, GRID, tables[k][0]) @ zk)
                out[1] += (zk * (np.interp(sk, GRID, tables[k][1]) / rows)[:, None]).T @ zk
                at = np.clip(np.rint((sk - low) / span * (PARTS - 1)), 0, PARTS - 1).astype(np.int64)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(first):
                    out[2][k][at[order][first]] = np.add.reduceat(zk[order], first) / rows
            return np.concatenate([o.ravel() for o in out])

        got = total(slopes, np.add)
        slope, curve, (g, b) = got[:size], got[size : size + size * size].reshape(size, size), got[size + size * size :].reshape(2, PARTS, size)
        p = 1 / (1 + np.exp(np.clip(centres[:, None] - centres, -60, 60)))
        cross = g.T @ (p * (1 - p)) @ b
        curve = curve - cross - cross.T
        grown, axes = np.linalg.eigh((curve + curve.T) / 2)  # sums over parts may leave values just below 0
        step = axes @ ((axes.T @ (slope + RIDGE * weights)) / (np.maximum(grown, 0) + RIDGE))
        weights = weights - step * min(1.0, 5 / max(np.linalg.norm(step), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    model = Ranking(knots, mean, scale, weights, 0.0)
    model.threshold = float(_quantiles(total, lambda x: model.worth(x)[:, None], [n_bad / max(1, n_good + n_bad)])[0, 0])
    return model


def fit(x: np.ndarray, label: np.ndarray, pairs: int | None = None, steps: int = 12) -> Ranking:
    """learn() on rows in memory. All pairs count: pairs, once the number of those drawn, has no effect."""
    if not len(x):
        x, label = np.zeros((1, FEATURES)), np.ones(1)
    return learn(lambda f, add: f(x, label), steps)


def _features(batches):
    for batch, t in chunks(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(t)), pa.list_(pa.float64()))], ["_label_id", "x"])


def _part(f, add):
    """A row for each task: its number, and f added up over its rows."""

    def part(batches):
        from pyspark import TaskContext

        got = None
        for batch in batches:
            x, label = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES), batch.column(0).to_numpy()
            for a in range(0, len(x), BLOCK):
                one = f(x[a : a + BLOCK], label[a : a + BLOCK])
                got = one if got is None else add(got, one)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.asarray(got, np.float64).tobytes()]), pa.array([list(got.shape)], pa.list_(pa.int64()))], ["place", "total", "shape"])

    return part


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Learn from all labelled documents; a repeated label counts once, the larger one, and of documents that share an
    identifier the least row of features. Texts are not shuffled; the driver gets sums only, and adds them in the tasks' order."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).cast("string").alias("_text")).filter("_label_id is not null")
    x = rows.mapInArrow(_features, f"_label_id {rows.schema['_label_id'].dataType.simpleString()}, x array<double>")
    found = x.join(chosen, "_label_id").groupBy("_label_id").agg(F.min("_label").alias("_label"), F.min("x").alias("x"))
    held = written(found.sortWithinPartitions("_label_id").select("_label", "x"), "labelled")

    def total(f, add):
        got = held.mapInArrow(_part(f, add), "place int, total binary, shape array<long>").collect()
        return functools.reduce(add, (np.frombuffer(r["total"]).reshape(r["shape"]) for r in sorted(got, key=lambda r: r["place"])))

    return fit(np.zeros((0, FEATURES)), np.zeros(0)) if held.isEmpty() else learn(total)


def _score(model: Ranking):
    def score(batches):
        for batch, t in chunks(batches, 1):
            s = model.score(features(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["id", "score", "predicted"])

    return score


def quality_scored(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted. A null text scores as an empty one; repeated and null
    identifiers don't matter; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.filter(~held_out("doc_id")))
    out = quality_scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
