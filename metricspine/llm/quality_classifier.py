"""A quality classifier from trusted positives and unlabelled text: non-negative PU learning.

Kiryo, Niu, du Plessis and Sugiyama, "Positive-Unlabeled Learning with
Non-Negative Risk Estimator" (2017), for a linear model with the logistic loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emitter, id_bucket, rows_of, sources, spark_schema, written
from .text_stats import TextStats, text_stats

RIDGE = 1e-3
STEPS = 12
#: Scores of the positives and of the unlabelled texts are compared in this many bins.
BINS = 400
#: The class prior is read off where at least this share of the positives lies above the cut.
LEAST_ABOVE = 0.3


def features(s: TextStats) -> list[float]:
    """Fifteen shares and sizes of a text, each also as its square root, all finite for any text."""
    n, lines, letters = max(s.n_words, 1), max(s.n_lines, 1), max(s.n_upper + s.n_lower, 1)
    base = [
        np.log1p(s.n_words) / 5,
        np.log1p(s.word_chars / n) / 2,
        s.n_symbols / n,
        s.n_dup_lines / lines,
        s.n_repeat_words / n,
        s.n_upper / letters,
        s.n_exclaim / n,
        s.n_function / n,
        s.n_digits / max(s.word_chars, 1),
        s.n_marks / n,
        s.n_distinct / n,
        s.n_adjacent / n,
        s.top_count / n,
        np.log1p(s.n_lines) / 4,
        np.log1p(n / lines) / 4,
    ]
    return [float(min(x, 4.0)) for x in base] + [float(min(x, 4.0)) ** 0.5 for x in base]


WIDTH = 30


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[1:] + self.weights[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def _totals(rows: DataFrame, summed: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows (x, positive) of the vectors that summed makes of a batch; width numbers come to the driver."""
    schema = pa.schema([("k", pa.int32()), ("v", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                total += summed(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], schema=schema)

    out = np.zeros(width)
    for k, v in rows.select("x", "positive").mapInArrow(partial, spark_schema(schema)).groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def _fit(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float, start: np.ndarray, steps: int) -> np.ndarray:
    """Weights that minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) plus a ridge.

    With the logistic loss l(g) - l(-g) = -g, so while the second part is not
    negative the risk is convex and Newton steps are taken. Where it is negative,
    the step goes against the gradient of that part, as the method says.
    """
    w, best, lowest, size = start.copy(), start.copy(), np.inf, len(start)
    d2 = size * size

    for _ in range(steps + 1):
        model = Model(mean, scale, w, prior)

        def summed(x: np.ndarray, positive: np.ndarray, model: Model = model) -> np.ndarray:
            z = np.column_stack((np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)))
            g = np.clip(z @ model.weights, -500, 500)
            p = 1 / (1 + np.exp(-g))
            plus = np.logaddexp(0, g)
            hess = (z * (p * (1 - p))[:, None]).T @ z
            zp, pp = z[positive], p[positive]
            return np.concatenate((hess.ravel(), z.T @ p, zp.sum(axis=0), zp.T @ pp, [len(x), len(zp), plus.sum(), plus[positive].sum(), g[positive].sum()]))

        t = _totals(rows, summed, d2 + 3 * size + 5)
        n_u, n_p, u_loss, p_loss, p_sum = t[-5:]
        if not n_u or not n_p:
            return w
        hess = t[:d2].reshape(size, size) / n_u
        grad_u, mean_p, grad_p = t[d2 : d2 + size] / n_u, t[d2 + size : d2 + 2 * size] / n_p, t[d2 + 2 * size : d2 + 3 * size] / n_p
        negative = u_loss / n_u - prior * p_loss / n_p
        ridge = RIDGE * np.concatenate(([0.0], np.ones(size - 1)))
        risk = prior * (p_loss - p_sum) / n_p + max(0.0, negative) + 0.5 * (ridge * w * w).sum()
        if risk < lowest - 1e-9:
            lowest, best = risk, w.copy()
        elif negative >= 0:
            break
        hess = hess + np.diag(ridge + 1e-6)
        if negative >= 0:
            step = np.linalg.solve(hess, grad_u - prior * mean_p + ridge * w)
            w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        else:
            step = np.linalg.solve(hess, grad_u - prior * grad_p)
            w = w + 0.5 * step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
    return best


def _class_prior(rows: DataFrame, model: Model) -> float:
    """The largest share of positives that the unlabelled scores allow: the least ratio of the upper tails."""

    def summed(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        bin_ = np.clip(((model.margins(x) + 20) / 40 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(bin_, minlength=BINS), np.bincount(bin_[positive], minlength=BINS))).astype(float)

    t = _totals(rows, summed, 2 * BINS)
    u, p = (x[::-1].cumsum() for x in (t[:BINS], t[BINS:]))
    if not u[-1] or not p[-1]:
        return model.prior
    above = p / p[-1]
    ratio = (u / u[-1])[above >= LEAST_ABOVE] / above[above >= LEAST_ABOVE]
    return float(np.clip(ratio.min(), 0.02, 0.98))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, class_prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, learned from labels (doc_id, quality).

    Trusted positives are the labelled rows with quality 1 outside the held-out
    fold (crc32 of the doc_id as text, modulo folds); all documents outside it
    are the unlabelled texts. Other labels are not used. A score depends on the
    text alone. Fitting passes over all these rows, none is sampled: features
    are computed once and written to the shared folder, each Newton step sums
    partial gradients and curvatures by task (about a thousand numbers come to
    the driver), and the class prior is estimated from histograms of a first
    model's scores, unless it is given.

    Null and empty texts are scored as texts without words; a very long text is
    described whole by one task, which holds its words; a score of exactly 0.5 is
    predicted as 1; repeated documents
    are scored alike; a doc_id labelled both ways is no positive; labels
    without a document, and nulls in them, are ignored; without any positive
    or document the score is 0.5; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitter(schema, ((doc_id, features(text_stats(text))) for doc_id, text in rows_of(batches, "doc_id", "text")))

    body = sources(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality")).na.drop()
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id", F.lit(True).alias("_label"))
    held_out = id_bucket(F.col("doc_id"), folds) == held_out_fold
    rows = body.mapInArrow(describe, spark_schema(schema)).withColumn("held_out", held_out)
    rows = rows.join(trusted.where(~held_out), "doc_id", "left").withColumn("positive", F.coalesce("_label", F.lit(False))).drop("_label")
    rows = written(rows, "classifier-features")
    train = rows.where(~F.col("held_out"))

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return np.concatenate((x.sum(axis=0), (x * x).sum(axis=0), [len(x), positive.sum()]))

    t = _totals(train, moments, 2 * WIDTH + 2)
    n = max(t[-2], 1.0)
    mean = t[:WIDTH] / n
    scale = np.sqrt(np.maximum(t[WIDTH : 2 * WIDTH] / n - mean * mean, 1e-6))
    weights = np.zeros(WIDTH + 1)
    prior = class_prior if class_prior is not None else 0.7
    if t[-1]:
        if class_prior is None:
            weights = _fit(train, mean, scale, prior, weights, STEPS // 2)
            prior = _class_prior(train, Model(mean, scale, weights, prior))
        weights = _fit(train, mean, scale, prior, weights, STEPS)
    model = Model(mean, scale, weights, prior)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                score = model.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=out)

    return rows.select("doc_id", "held_out", "x").mapInArrow(apply, spark_schema(out))
