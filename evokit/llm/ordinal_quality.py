"""Operator 3: quality classifier by ordinal cumulative-link regression.

Grades 0..K-1 share one weight vector over hashed byte n-grams; ordered thresholds t turn the score s
into P(grade <= k) = logistic(t_k - s). The expected grade ranks documents, and the tail probability
P(grade >= g) selects them.

The model is fitted to at most ``MAX_LABELLED`` rated documents, those least by a hash of their id: a
bounded sample, the same at every run. Its features stay on the executors; a step of the limited-memory quasi-Newton
method sends the weights out and gets one gradient a partition back, so what the driver holds is bounded by buckets and partitions.
Weights are scaled by how seldom their feature is, so that few steps do. Scoring is one map over all rows and whole texts, without a shuffle.

Defined results: a null or empty text has no features, so its score is 0; unrated documents are only
scored; ratings that are null are not fitted; with no rating at all every document gets equal grades and is kept;
of ratings of one document each is a row of the fit; texts that share an id are each fitted with its ratings;
long texts count whole; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evokit.session import cut

BUCKETS = 1 << 15
SIZES = (2, 3, 5)
MAX_LABELLED = 4000
#: Steps of the fit, and the gradients and steps that it remembers.
ITERATIONS = 12
MEMORY = 8
PENALTY = 1e-3
#: A weight's scale is (mean square of its feature + SCALE_FLOOR) ^ -SCALE_POWER.
SCALE_FLOOR, SCALE_POWER = 1e-5, 0.25
FIT_PARTITIONS = 8
#: The value of the feature for variety; all n-grams together have length one.
VARIETY = 1.0
#: Variety is told in so many steps, each with a weight of its own after those of the buckets.
VARIETIES = 21
WEIGHTS = BUCKETS + VARIETIES


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: logarithms of its n-gram counts, of length one together, and their variety."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)
    found = []
    for k in SIZES:
        if len(raw) >= k:
            h = np.full(len(raw) - k + 1, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + raw[j : len(raw) - k + 1 + j]
            found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    count = np.bincount(np.concatenate(found), minlength=BUCKETS)
    # How varied the n-grams are: log(distinct) / log(all) in twentieths.
    distinct, total = np.count_nonzero(count), int(count.sum())
    varied = int((VARIETIES - 1) * np.log(distinct) / np.log(total)) if total > 1 else VARIETIES - 1
    at = np.flatnonzero(count)
    value = np.log1p(count[at])
    return np.append(at, BUCKETS + varied), np.append(value / np.sqrt(value @ value), VARIETY)


def _logistic(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0..K-2, a row a score."""
        return _logistic(self.thresholds[None, :] - np.asarray(score)[:, None])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(score)).sum(1)

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        return 1 - self.at_most(score)[:, grade - 1]


def _gradient(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """d loss / d score of each row, d loss / d thresholds, and the loss."""
    t = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upper, lower = _logistic(t[grade + 1] - score), _logistic(t[grade] - score)
    p = np.maximum(upper - lower, 1e-12)
    by_threshold = np.zeros(len(t))
    np.add.at(by_threshold, grade + 1, -upper * (1 - upper) / p)
    np.add.at(by_threshold, grade, lower * (1 - lower) / p)
    return 1 - upper - lower, by_threshold[1:-1], float(-np.log(p).sum())


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then logarithms of the steps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = MEMORY) -> np.ndarray:
    """Quasi-Newton steps from ``x`` on f, which gives value and gradient; a step that does not lessen the value enough is halved."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            used.append(a)
            d -= a * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            d += s * (a - (y @ d) / (y @ s))
        size = 1.0
        while True:
            new, grad = f(x - size * d)
            if new <= value - 1e-4 * size * (g @ d):
                break
            size /= 2
            if size < 1e-3:
                return x
        s, y = -size * d, grad - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, g = x + s, new, grad
    return x


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """The model of the rated documents; None if there are none."""
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where(f"id is not null and grade between 0 and {grades - 1}")
    sample = rated.orderBy(F.xxhash64("id"), "grade").limit(max_labelled)
    # At most max_labelled rows of two numbers are broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "grade")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()), batch.column(1)], names=["at", "value", "grade"])

    # Bytes, as every iteration reads them again and lists would be converted number by number.
    ready = cut(rows.mapInArrow(prepare, "at binary, value binary, grade int")).coalesce(FIT_PARTITIONS)
    squares, counts = _squares(ready, grades)
    total = counts.sum()
    if not total:
        return None
    scale = (squares / total + SCALE_FLOOR) ** -SCALE_POWER
    share = np.cumsum((counts + 1) / (total + grades))[:-1]
    logit = np.log(share / (1 - share))
    free = np.concatenate((logit[:1], np.log(np.maximum(np.diff(logit), 1e-3))))

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        g, value = _summed(ready, x[:WEIGHTS] * scale, _thresholds(x[WEIGHTS:]))
        g /= total
        later = np.cumsum(g[WEIGHTS:][::-1])[::-1]
        g[WEIGHTS:] = np.concatenate((later[:1], later[1:] * np.exp(x[WEIGHTS + 1 :])))
        g[:WEIGHTS] = g[:WEIGHTS] * scale + PENALTY * x[:WEIGHTS]
        return value / total + PENALTY / 2 * float(x[:WEIGHTS] @ x[:WEIGHTS]), g

    x = minimise(objective, np.concatenate((np.zeros(WEIGHTS), free)), ITERATIONS)
    return OrdinalModel(x[:WEIGHTS] * scale, _thresholds(x[WEIGHTS:]))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and row numbers of all features of a batch."""
    at, value = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    lengths = np.fromiter(map(len, at), np.int64, len(at)) // 4
    return np.frombuffer(b"".join(at), "<i4"), np.frombuffer(b"".join(value), "<f4"), np.repeat(np.arange(len(lengths)), lengths)


def _collected(ready: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` over all batches: each of the few partitions sends one row of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["g"])

    return sum((np.frombuffer(r.g, np.float64) for r in ready.mapInArrow(run, "g binary").collect()), np.zeros(size))


def _squares(ready: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares of each feature, and the number of rows of each grade."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        flat, values, _ = _flat(batch)
        return np.concatenate((np.bincount(flat, weights=values * values, minlength=WEIGHTS), np.bincount(batch.column(2).to_numpy(), minlength=grades)))

    both = _collected(ready, part, WEIGHTS + grades)
    return both[:WEIGHTS], both[WEIGHTS:]


def _summed(ready: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient over all rows by weights and thresholds, and the loss."""
    sent = ready.sparkSession.sparkContext.broadcast((weights, thresholds))

    def part(batch: pa.RecordBatch) -> np.ndarray:
        w, t = sent.value
        flat, values, row = _flat(batch)
        score = np.bincount(row, weights=w[flat] * values, minlength=batch.num_rows)
        by_score, by_threshold, loss = _gradient(score, batch.column(2).to_numpy(), t)
        return np.concatenate((np.bincount(flat, weights=by_score[row] * values, minlength=WEIGHTS), by_threshold, [loss]))

    total = _collected(ready, part, len(weights) + len(thresholds) + 1)
    sent.destroy()
    return total[:-1], float(total[-1])


def score(docs: DataFrame, model: OrdinalModel | None, grade: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_probability, kept): kept if P(grade >= ``grade``) is ``least`` or more."""
    if model is None:
        model = OrdinalModel(np.zeros(WEIGHTS), np.zeros(1))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = (features(t.as_py()) for t in batch.column(1))
            s = np.array([own.weights[a] @ v if len(a) else 0.0 for a, v in found])
            tail = own.tail(s, min(grade, len(own.thresholds))) if len(s) else s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.expected(s)), pa.array(tail), pa.array(tail >= least, pa.bool_())], names=["id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, expected_grade double, tail_probability double, kept boolean")
    return out.withColumnRenamed("id", id_col)
