"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words' hashed counts (normalised to length one), about a dozen statistics of its structure, and its declared
length. The pairwise interactions of all features have rank RANK and are summed in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Trained by AdaGrad on a bounded sample in numpy;
scores are a logistic of the machine's output, calibrated on rows held back from fitting.

Defined results: null and empty texts are scored from their statistics like any other; without a labelled row each score is 0.5.
Labels of a document that has several rows with different values count once each. Documents' repeated rows are scored each, and count as often in fitting; other columns are
ignored, whatever their names; an empty table gives no rows. The words of one text are held at a time, some 60 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, excerpt, sampled_documents

BUCKETS, RANK, STATS = 1 << 15, 6, 14
#: Bounds of the fitting sample: rows of a class, and characters of a row.
PER_CLASS, EXCERPT = 2500, 6000
SCHEMA = "doc_id long, score double"

UPPER, LOWER, DIGIT, SPACE = (np.array([chr(c) in s for c in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c"))
KINDS = np.where(UPPER, 0, np.where(LOWER, 1, np.where(DIGIT, 2, np.where(SPACE, 3, np.where(np.arange(256) >= 128, 4, 5)))))
PIECE = 1 << 20


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of a whole text, read in pieces."""
    kinds = np.zeros(256)
    words = text.lower().split()
    n = len(words)
    for i in range(0, len(text), PIECE):
        kinds += np.bincount(np.frombuffer(text[i : i + PIECE], np.uint8), minlength=256)
    by = np.bincount(KINDS, weights=kinds, minlength=6)
    total = max(1.0, by.sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = np.sort(np.fromiter(map(crc32, words), np.uint32, n)) if n else np.zeros(0, np.uint32)
    new = np.flatnonzero(np.diff(h)) + 1 if n else []
    top = int(np.diff(np.concatenate(([0], new, [n]))).max()) if n else 0
    buckets = np.sort(h % np.uint32(BUCKETS)).astype(np.int64)
    at = np.flatnonzero(np.diff(buckets, prepend=-1)) if n else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, n)).astype(np.float64)
    values = counts / max(1e-9, np.sqrt((counts**2).sum()))
    marks = lambda s: sum(kinds[ord(c)] for c in s)
    stats = np.array([
        by[0] / total, by[2] / total, by[5] / total, by[4] / total, by[3] / total,
        (len(new) + 1) / n if n else 0.0, top / n if n else 0.0, np.log1p(n) / 10, total / (n + 1) / 20,
        len(set(lines)) / len(lines) if lines else 0.0, marks(".") / (n + 1), marks("#$%&*|!<>{}[]=~^") / (n + 1), marks("|") / (n + 1),
        np.log1p(n_chars or 0) / 10,
    ])
    return buckets[at], values, stats


@dataclass
class Machine:
    mean: np.ndarray
    spread: np.ndarray
    w0: float
    w: np.ndarray  # BUCKETS words, then STATS statistics
    v: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, x: tuple) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate((x[0], np.arange(BUCKETS, BUCKETS + STATS))), np.concatenate((x[1], np.clip((x[2] - self.mean) / self.spread, -3, 3) * 0.3))

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.v[ids]
        s = x @ v
        return float(self.w0 + x @ self.w[ids] + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))

    def score(self, text: bytes, n_chars: int | None) -> float:
        return float(sigmoid(self.scale * self.raw(*self.inputs(features(text, n_chars))) + self.shift))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        r = p * (1 - p) + 1e-6
        h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a), float(b)


def train(rows: list[tuple[bytes, int | None, int]], seed: int = 11, epochs: int = 5, rate: float = 0.15) -> Machine:
    """Fit on (text, declared length, label); every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    x, y = [features(t, n) for t, n, _ in rows], np.array([label for *_, label in rows], np.float64)
    stats = np.array([a[2] for a in x]) if x else np.zeros((1, STATS))
    m = Machine(stats.mean(0), stats.std(0) + 1e-3, 0.0, np.zeros(BUCKETS + STATS), rng.standard_normal((BUCKETS + STATS, RANK)) * 0.02)
    if len(set(y)) < 2:
        m.v[:] = 0
        m.shift = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        return m
    x = [m.inputs(a) for a in x]
    order = rng.permutation(len(x))
    held, fit = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    gw, gv, g0 = np.full(BUCKETS + STATS, 1e-2), np.full((BUCKETS + STATS, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, a = x[i]
            v = m.v[ids]
            s = a @ v
            e = float(sigmoid(m.w0 + a @ m.w[ids] + 0.5 * (s @ s - (a * a) @ (v * v).sum(1))) - y[i])
            dw = e * a + 1e-5 * m.w[ids]
            dv = e * (a[:, None] * s - v * (a * a)[:, None]) + 1e-5 * v
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            g0 += e * e
            m.w[ids] -= rate * dw / np.sqrt(gw[ids])
            m.v[ids] -= rate * 0.3 * dv / np.sqrt(gv[ids])
            m.w0 -= rate * e / np.sqrt(g0)
    m.scale, m.shift = calibrate(np.array([m.raw(*x[i]) for i in held]), y[held])
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", length: str = "n_chars", where: Column | None = None) -> Machine:
    """Train on about PER_CLASS labelled documents of each class, EXCERPT characters of each: the only rows that reach the driver."""
    rows = sampled_documents(docs.select(key, F.col(text).alias("t"), F.col(length).alias("n")), labels, label, key, PER_CLASS, where)
    few = rows.select("k", excerpt(F.col("t"), F.col("k"), EXCERPT).alias("t"), "y", "n")
    return train([((r["t"] or "").encode(), r["n"], r["y"]) for r in sorted(few.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["y"]))])


def score(rows: DataFrame, model: Machine, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """(doc_id, score) of each whole text: one narrow pass with a model of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = (x or b"" for x in b.column(1).to_pylist())
            yield batch(doc_id=(b.column(0), pa.int64()), score=([shared.value.score(x, n) for x, n in zip(t, b.column(2).to_pylist(), strict=True)], pa.float64()))

    return rows.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"), F.col(length).cast("long").alias("n")).mapInArrow(run, SCHEMA)
