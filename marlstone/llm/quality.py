"""Quality classifier by positive-unlabelled learning (operator 4).

Trusted positives are documents whose training label is 1; the unlabelled sample is every document.
With class prior p, logistic loss l and linear score g the non-negative unbiased risk is

    p * E_pos[l(g)] + max(0, E_all[l(-g)] - p * E_pos[l(-g)]).

For logistic loss l(g) - l(-g) = -g, so while the second term is positive the risk is the convex
-p * E_pos[g] + E_all[log(1 + e^g)], minimised by Newton steps; when the term falls below zero the
step is taken against its gradient instead, as the non-negative correction asks.  Sums for a step
are taken over *all* documents where they lie (one small row per task, added up in two levels);
nothing is sampled.  The prior is the share of 1 among training labels, or ``prior``.

Features come from whole texts alone: shares of byte kinds, of adjacent kinds, of words that repeat
one of the four words before, and word length.

Defined cases: empty and null texts have all-zero shares and get the score of those; documents
without any trusted positive in the corpus all score the prior (0.5 without labels); a label given
twice for a document counts as 1 only if all its labels are 1; repeated rows are scored alike.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_and_text, mapped, slices, stored, summed, utf8_view

#: Byte kinds: each ASCII mark by itself, then digits, capitals, small letters, blanks, line ends, controls, others.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
LAGS = (1, 2, 3, 4)
#: Bytes added to every length, so that a few marks in a very short text weigh less.
SHORT = 40


def _kinds() -> tuple[np.ndarray, np.ndarray, int]:
    fine, coarse, k = np.zeros(256, np.int64), np.zeros(256, np.int64), len(MARKS)
    for b in range(256):
        c = chr(b)
        group = 4 if b in MARKS else 0 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if b == 32 or 9 <= b <= 13 else 5
        coarse[b] = group
        fine[b] = MARKS.index(b) if b in MARKS else k + {0: 0, 1: 1, 2: 2, 3: 3 if c == " " else 4, 5: 5 if b < 128 else 6}[group]
    return fine, coarse, k + 7


FINE, COARSE, N_FINE = _kinds()
N_FEATURES = N_FINE + 36 + 1 + len(LAGS) + 2


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for each document of a run."""
    n, size = len(off) - 1, np.diff(off)
    total = (size + SHORT)[:, None].astype(np.float64)
    doc = np.repeat(np.arange(n), size)
    fine = np.bincount(doc * N_FINE + FINE[data], minlength=n * N_FINE).reshape(n, N_FINE) / total
    kind = COARSE[data]
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount((doc[1:] * 36 + kind[:-1] * 6 + kind[1:])[inside], minlength=n * 36).reshape(n, 36) / total
    echo = np.bincount(doc[1:][inside & (data[1:] == data[:-1])], minlength=n)[:, None] / total
    starts, ends, first = tv.words(data, off, tv.SPACED_LOWER)
    hashes = tv.word_hashes(data, starts, ends, tv.SPACED_LOWER)
    count = (np.diff(first) + SHORT / 5)[:, None].astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(first))
    lags = []
    for lag in LAGS:
        same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        lags.append(np.bincount(owner[lag:][same], minlength=n)[:, None] / count)
    length = np.bincount(owner, weights=(ends - starts).astype(np.float64), minlength=n)[:, None] / count / 50
    long = np.bincount(owner[(ends - starts) > 20], minlength=n)[:, None] / count
    return np.log1p(50 * np.hstack((fine, pairs, echo, *lags, length, long))).astype(np.float32)


def batch_features(column) -> np.ndarray:
    raw, offsets = utf8_view(column)
    rows = [features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.vstack(rows) if rows else np.zeros((0, N_FEATURES), np.float32)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # the last one is the bias
    mean: np.ndarray
    spread: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -10, 10)
        return np.hstack((z, np.ones((len(z), 1))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -40, 40)))


def _summed(table: DataFrame, partial, size: int) -> np.ndarray:
    """Add up ``partial(features, is positive)`` over all rows."""

    def each(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column("x")), np.asarray(batch.column("positive").to_pylist(), bool))
        return total

    return summed(table.select("x", "positive"), each, size)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def fit_features(table: DataFrame, prior: float, steps: int = 10, ridge: float = 1e-3) -> Model:
    """Newton steps on the non-negative PU risk; ``table`` has x (features) and positive."""
    d = N_FEATURES
    moments = _summed(table, lambda x, p: np.concatenate(([len(x), p.sum()], x.sum(0), (x * x).sum(0))), 2 + 2 * d)
    n, n_pos = moments[:2]
    mean = moments[2 : 2 + d] / max(n, 1)
    spread = np.sqrt(np.maximum(moments[2 + d :] / max(n, 1) - mean**2, 0)) + 1e-2
    weights = np.zeros(d + 1)
    weights[-1] = np.log(prior / (1 - prior))
    model = Model(weights, mean, spread, prior)
    if not n_pos:
        return model
    k = d + 1
    for _ in range(steps):

        def partial(x, p, model=model):
            z = model.design(x)
            g = z @ model.weights
            s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            zp, sp = z[p], s[p]
            hessian = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate(([_softplus(g).sum(), _softplus(g[p]).sum()], (z * s[:, None]).sum(0), (zp * sp[:, None]).sum(0), zp.sum(0), hessian.ravel()))

        sums = _summed(table, partial, 2 + 3 * k + k * k)
        negative_risk = sums[0] / n - prior * sums[1] / n_pos
        g_all, g_pos_minus, g_pos = sums[2 : 2 + k] / n, sums[2 + k : 2 + 2 * k] / n_pos, sums[2 + 2 * k : 2 + 3 * k] / n_pos
        if negative_risk < 0:  # non-negative correction: climb back along the offending term
            step = -0.1 * (g_all - prior * g_pos_minus)
        else:
            gradient = g_all - prior * g_pos + ridge * model.weights
            step = np.linalg.solve(sums[2 + 3 * k :].reshape(k, k) / n + ridge * np.eye(k), gradient)
            longest = np.abs(step).max()
            step *= min(1.0, 2.0 / longest) if longest else 1.0
        model = dataclasses.replace(model, weights=model.weights - step)
        if np.abs(step).max() < 1e-3:
            break
    return model


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, y of the rows that may be learned from: crc32 of the id's text mod 5 is not 0."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return ids.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y"))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def featurised(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(stored doc_id, x, positive) of all documents, and the estimated class prior."""

    def each(batches):
        for batch in batches:
            x = batch_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    learn = training_labels(labels)
    ones, every = learn.agg(F.sum((F.col("y") == 1).cast("long")), F.count("*")).first()
    prior = min(max((ones or 0) / every, 0.01), 0.99) if every else 0.5
    x = id_and_text(docs, id_col, text_col).mapInArrow(each, "doc_id long, x binary")
    marked = x.join(learn, "doc_id", "left").select("doc_id", "x", F.coalesce(F.col("y") == 1, F.lit(False)).alias("positive"))
    return stored(marked, "quality"), prior


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, prior: float | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table, estimated = featurised(docs, labels)
    model = fit_features(table, prior or estimated)

    def each(batches):
        for batch in batches:
            s = model.scores(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    scored = table.select("doc_id", "x").mapInArrow(each, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, columns unchanged."""
    table, estimated = featurised(docs, labels, id_col, text_col)
    model, at = fit_features(table, prior or estimated), docs.columns.index(text_col)

    def each(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch_features(batch.column(at)).astype(np.float64)) >= threshold))

    return mapped(docs, each)
