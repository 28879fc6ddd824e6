"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is fitted from confirmed toxic texts and unlabelled texts. The unlabelled ones hold toxic texts
too: with a class prior p, the risk is p * R+(toxic) + max(0, R-(unlabelled) - p * R-(toxic)); a batch whose bounded part
is negative takes a step back (Kiryo et al., 2017). All texts of the corpus are the unlabelled side: Spark counts their words and,
at each step, sums their part of the gradient. Scores are calibrated on labelled rows that a first model hasn't seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_slices, stored, strings

BUCKETS = 1 << 18
#: bound of the labelled rows that fit the model, chosen by a hash of the id; unlabelled texts have none
MAX_LABELLED = 16_000
#: steps over all texts, and how far a weight moves in one
STEPS = 40
RATE = 0.25
DECAY = 1e-4
THRESHOLD = 0.7
#: a word is learned if it tells toxic from unlabelled texts this clearly and this share of the toxic ones has it
MIN_Z = 5.0
MIN_SHARE = 0.01
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> np.ndarray:
    """Sorted buckets of the different words of a text."""
    digest = xxhash.xxh32_intdigest
    found = set(LETTERS.findall(text.lower()))
    return np.unique(np.fromiter((digest(w) & (BUCKETS - 1) for w in found), np.int32, len(found)))


@dataclass
class Model:
    weights: np.ndarray
    slope: float = 1.0
    offset: float = -2.0


def featurise(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([words_of(t) for t in strings(part, "_text")], pa.list_(pa.int32()))], [*keep, "words"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "words array<int>"])
    return map_slices(docs.select(*keep, F.col(text_col).alias("_text")), make, fields, "_text")


def _pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if rows else np.empty(0, np.int32)), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def decision(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    word, row = _pack(rows)
    return np.bincount(row, weights[word], len(rows)) if len(rows) else np.empty(0)


def _different(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Copies count once in learning."""
    return list({r.tobytes(): r for r in rows}.values())


def _told_apart(toxic: list[np.ndarray], in_u: np.ndarray, u: int) -> np.ndarray:
    """Buckets whose share of texts differs between the toxic and the ``u`` unlabelled ones, of which ``in_u`` have them, by MIN_Z standard
    errors and that MIN_SHARE of the toxic texts have."""
    p = len(toxic)
    in_p = np.bincount(_pack(toxic)[0], minlength=BUCKETS)
    mean = (in_p + in_u) / (p + u)
    z = (in_p / p - in_u / u) / np.sqrt(mean * (1 - mean) * (1 / p + 1 / u) + 1e-12)
    return (np.abs(z) >= MIN_Z) & (in_p >= max(3, MIN_SHARE * p))


def _slope(word: np.ndarray, row: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of texts taken for clean, ``n`` times each: the loss by word, then by the constant, which is the last weight; then the loss itself."""
    z = np.bincount(row, weights[word], len(n)) + weights[-1]
    s = n / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([np.bincount(word, s[row], len(weights) - 1), [s.sum(), (n * np.logaddexp(0, z)).sum()]])


def descend(toxic: list[list[np.ndarray]], used: np.ndarray, free: Callable[[np.ndarray], np.ndarray], prior: float) -> np.ndarray:
    """A row of weights, the constant last, for each list of toxic texts (words numbered 0 to columns of ``used``, which says what a model may
    use). ``free`` gives the mean of ``_slope`` over the unlabelled texts for the rows of weights at once. Adaptive steps over all texts."""
    packed = [_pack(rows) for rows in toxic]
    weights = np.zeros((len(toxic), used.shape[1] + 1))
    weights[:, -1] = -1.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        grad = np.zeros_like(weights)
        for j, of_u in enumerate(free(weights)):
            word, row = packed[j]
            share = np.full(len(toxic[j]), 1 / len(toxic[j]))
            of_p = _slope(word, row, share, weights[j])
            if of_u[-1] >= prior * of_p[-1]:
                grad[j] = of_u[:-1] - prior * np.append(np.bincount(word, share[row], used.shape[1]), 1.0)
            else:  # the bounded part alone, upwards
                grad[j] = prior * of_p[:-1] - of_u[:-1]
            grad[j, :-1] = np.where(used[j], grad[j, :-1] + DECAY * weights[j, :-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights


def _spread(weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS)
    out[words] = weights[:-1]  # the constant is left to the calibration
    return out


def _numbered(rows: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """Rows cut to ``words``, which become 0, 1, ..."""
    place = np.full(BUCKETS, -1, np.int64)
    place[words] = np.arange(len(words))
    return [(x := place[r])[x >= 0] for r in rows]


def fit_pu(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Weights by bucket, from texts in memory."""
    toxic, unlabelled = _different(toxic), _different(unlabelled)
    if not toxic or not unlabelled:
        return np.zeros(BUCKETS)
    used = _told_apart(toxic, np.bincount(_pack(unlabelled)[0], minlength=BUCKETS), len(unlabelled))
    words = np.flatnonzero(used)
    word, row = _pack(_numbered(unlabelled, words))
    share = np.full(len(unlabelled), 1 / len(unlabelled))
    return _spread(descend([_numbered(toxic, words)], used[None, words], lambda w: np.stack([_slope(word, row, share, w[0])]), prior)[0], words)


def _sums(parts: DataFrame) -> dict[tuple[int, int], float]:
    got = parts.groupBy("model", "place").agg(F.sum("x").alias("x")).toArrow()
    return dict(zip(zip(got.column("model").to_pylist(), got.column("place").to_pylist()), got.column("x").to_pylist()))


PARTS = "model int, place int, x double"


def _parts(model: int, x: np.ndarray) -> pa.RecordBatch:
    place = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), model, np.int32)), pa.array(place.astype(np.int32)), pa.array(x[place])], ["model", "place", "x"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, and the row of each."""
    column = batch.column("words")
    return column.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def word_counts(different: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, and how many texts there are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1)
        for batch in batches:
            total[:-1] += np.bincount(_arrays(batch)[0], minlength=BUCKETS)
            total[-1] += batch.num_rows
        yield _parts(0, total)

    out = np.zeros(BUCKETS + 1)
    for (_, place), x in _sums(different.mapInArrow(make, PARTS)).items():  # BUCKETS + 1 rows at most
        out[place] = x
    return out[:-1], int(out[-1])


def cut_to(different: DataFrame, words: np.ndarray) -> DataFrame:
    """(words, n): the texts cut to ``words``, numbered, and how many are alike then."""
    shared = different.sparkSession.sparkContext.broadcast(words)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, row = _arrays(batch)
            at = np.minimum(np.searchsorted(shared.value, word), len(shared.value) - 1)
            good = shared.value[at] == word
            offsets = np.append(0, np.cumsum(np.bincount(row[good], minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at[good], pa.int32()))], ["words"])

    return stored(different.mapInArrow(make, "words array<int>").groupBy("words").agg(F.count(F.lit(1)).alias("n")))


def free_slopes(texts: DataFrame, n_texts: int) -> Callable[[np.ndarray], np.ndarray]:
    """``free`` of ``descend`` over the rows of ``cut_to``: tasks send their sums, Spark adds them up by weight."""
    sc = texts.sparkSession.sparkContext

    def free(weights: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(weights)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shared.value), shared.value.shape[1] + 1))
            for batch in batches:
                word, row = _arrays(batch)
                n = batch.column("n").to_numpy().astype(float)
                for j, w in enumerate(shared.value):
                    total[j] += _slope(word, row, n, w)
            for j, x in enumerate(total):
                yield _parts(j, x)

        out = np.zeros((len(weights), weights.shape[1] + 1))
        for at, x in _sums(texts.mapInArrow(make, PARTS)).items():
            out[at] = x / n_texts
        shared.destroy()
        return out

    return free


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score: logistic fit, moved so that the best threshold by F1 scores THRESHOLD."""
    if not len(z) or y.all() or not y.any():
        return 1.0, -2.0
    scale = z.std() or 1.0
    theta = np.zeros(2)
    x = z / scale
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        theta -= np.clip(np.linalg.solve(hess, np.array([((p - y) * x).sum() + 0.1 * theta[0], (p - y).sum() + 0.1 * theta[1]])), -2, 2)
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    ends = np.append(np.diff(z[order]) < 0, True)  # ties fall on one side
    at = int(np.argmax(np.where(ends, f1, -1)))
    edge = (z[order][at] + z[order][min(at + 1, len(z) - 1)]) / 2
    slope = max(theta[0], 0.5) / scale
    return float(slope), float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * edge)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on ``labels`` (id, label; nulls ignored) and on all ``docs`` as unlabelled texts; texts with the same words count once. The class
    prior is the share of toxic labels."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").filter("_text is not null")
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # an id that many rows share counts once
    got = featurise(texts, ["_id", "_y"], "_text").toArrow().sort_by([("_y", "ascending"), ("_id", "ascending")])
    y = got.column("_y").to_numpy()
    rows = [np.asarray(x.values) for x in got.column("words")]
    if not (y == 1).any():
        return Model(np.zeros(BUCKETS))
    prior = float(np.clip((y == 1).mean(), 0.01, 0.9))
    half = np.arange(len(y)) % 2
    # two models that each leave a half out, to calibrate on it, and one of all
    toxic = [_different([rows[i] for i in np.flatnonzero((y == 1) & (half != side))]) for side in (0, 1, 2)]
    different = stored(featurise(docs.filter(F.col(text_col).isNotNull()), [], text_col).filter(F.size("words") > 0).distinct())
    in_u, n_texts = word_counts(different)
    used = np.stack([_told_apart(t, in_u, n_texts) if t and n_texts else np.zeros(BUCKETS, bool) for t in toxic])
    words = np.flatnonzero(used.any(axis=0))
    if not len(words):
        return Model(np.zeros(BUCKETS))
    toxic = [_numbered(t or [np.empty(0, np.int64)], words) for t in toxic]
    weights = descend(toxic, used[:, words], free_slopes(cut_to(different, words), n_texts), prior)
    z, truth = [], []
    for side in (0, 1):  # each half is scored by the other half's model
        own = np.flatnonzero(half == side)
        z.append(decision(_spread(weights[side], words), [rows[i] for i in own]))
        truth.append(y[own] == 1)
    slope, offset = calibrate(np.concatenate(z), np.concatenate(truth))
    return Model(_spread(weights[2], words).astype(np.float32), slope, offset)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and score, 0 to 1: how likely a text is toxic. Null and empty texts have no words and get the base score.
    Without a toxic label to learn from, all texts get the same low score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        z = decision(m.weights, [words_of(t) for t in strings(part, "_text")])
        prob = 1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -30, 30)))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(prob)], [*keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_slices(docs.select(*keep, F.col(text_col).alias("_text")), make, f"{fields}, score double", "_text")
