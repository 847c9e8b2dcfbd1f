"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text's lower-cased letters form words; every run of other characters is one border mark. The subwords are the windows of 3 and 4
marks whose inner ones are letters, hashed into a fixed number of buckets. A text is the mean of its subwords' embeddings. As that mean
and the layer above it are linear, scoring folds both into one table (bucket, language), so whole texts of any length cost one gather a
subword and constant memory.

Defined results: `und` with score 0 for null or empty texts and texts without a letter; ties go to the language first in order; without a
single labelled row every text is `und`. `rejected` marks `und` and texts whose calibrated confidence is below the threshold.

The threshold is set on rows held back from fitting and on junk made of them, their characters in random order, which keeps letters and lengths of
words but no language: it rejects JUNK of that junk, unless this would cost more than COST of the held-back texts that are labelled rightly, or there are too few of
these to tell.

Repeated rows are predicted each, and count as often in fitting; other columns are ignored, whatever their names; an empty table gives no rows; very long texts are read in pieces. The fitting
sample covers the 1,000 most frequent languages, PER_LANGUAGE rows of each, so rarer ones are never predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, excerpt, sample_by_class

BUCKETS, DIM = 1 << 15, 16
#: Bounds of the fitting sample: rows of a language, and characters of a row.
PER_LANGUAGE, EXCERPT = 1500, 400
#: Share of correctly labelled calibration texts that rejection may cost, and share of junk that it should catch.
COST, JUNK = 0.001, 0.99
CHUNK = 1 << 17
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@cache
def letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def subwords(text: str) -> np.ndarray:
    """Buckets of a text's subwords."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.int64)
    good = letters()[c]
    keep = good.copy()
    keep[0] = True
    keep[1:] |= good[:-1]  # of a run of other characters, the first stays as the border mark
    c = np.where(good, c, np.uint32(0))[keep]
    c = np.concatenate(([0], c, [0])).astype(np.uint32) if c[0] else np.concatenate((c, [0])).astype(np.uint32)
    k = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    out = []
    for n in (3, 4):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        inner = np.ones(m, np.bool_)
        h = np.full(m, n, np.uint32)
        for i in range(n):
            part = c[i : i + m]
            h = (h ^ part) * k[i]
            h ^= h >> np.uint32(15)
            if 0 < i < n - 1:
                inner &= part != 0
        out.append((h[inner] % np.uint32(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(text: str) -> Iterator[str]:
    """A long text in pieces of bounded size that overlap by 3 characters, so that no subword within is lost (an overlap's own count twice)."""
    for i in range(0, max(1, len(text)), CHUNK):
        yield text[max(0, i - 3) : i + CHUNK]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: float
    threshold: float
    #: Shares of the held-back texts labelled rightly, and of junk, that the threshold rejects.
    costs: float = 0.0
    catches: float = 0.0

    def score(self, text: str | None) -> tuple[str, float, bool]:
        total, n = np.zeros(len(self.langs)), 0
        for piece in chunks(text or ""):
            ids = subwords(piece)
            total += self.table[ids].sum(0, dtype=np.float64)
            n += len(ids)
        if not n or not self.langs:
            return "und", 0.0, True
        p = softmax((total / n + self.bias) * self.scale)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 4, rate: float = 4.0) -> Model:
    """Fit on (text, language); every fifth row calibrates scale and threshold."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    data = [(ids, langs.index(lang), text) for text, lang in rows if len(ids := subwords(text))]
    order = rng.permutation(len(data))
    held, fit = [data[i] for i in order[::5]], [data[i] for k, i in enumerate(order) if k % 5]
    emb, w, b = (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32), (rng.standard_normal((DIM, len(langs))) * 0.3).astype(np.float32), np.zeros(len(langs), np.float32)
    seen = np.zeros(BUCKETS, np.bool_)
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, y, _ = fit[i]
            lr = rate * (1 - step / steps)
            x = emb[ids].mean(0)
            g = softmax(x @ w + b)
            g[y] -= 1
            dx = (w @ g) * np.float32(lr / len(ids))
            w -= np.float32(lr * 0.1) * np.outer(x, g)
            b -= np.float32(lr * 0.001) * g
            np.subtract.at(emb, ids, dx)
            seen[ids] = True
            step += 1
    emb[~seen] = 0  # what was never seen speaks for no language
    model = Model(langs, (emb @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)
    if held and len(langs) > 1:
        logits = lambda many: np.array([model.table[ids].sum(0, dtype=np.float64) / len(ids) + model.bias for ids in many if len(ids)]).reshape(-1, len(langs))
        z, y = logits(ids for ids, _, _ in held), np.array([y for _, y, _ in held])
        doubt = 0.5 / len(y)  # keeps the scale finite where all held-back rows are right

        def loss(s: float) -> float:
            p = np.log(softmax(z * s) + 1e-300)
            return -((1 - doubt) * p[np.arange(len(y)), y] + doubt * p.mean(1)).mean()

        model.scale = float(min((0.25 * 1.25**k for k in range(20)), key=loss))
        p = softmax(z * model.scale)
        right = p.max(1)[p.argmax(1) == y]
        junk = softmax(logits(subwords("".join(rng.permutation(list(t)))) for _, _, t in held) * model.scale).max(1)
        if len(right) and len(junk):
            # Fewer than 1 / COST rows can't show so small a cost: then the bound moves towards chance.
            sure = min(1.0, np.sqrt(len(right) * COST))
            most = 1 / len(langs) + sure * (np.quantile(right, COST, method="lower") - 1 / len(langs))
            model.threshold = float(min(np.quantile(junk, JUNK, method="higher") + 1e-9, most))
            model.costs, model.catches = float((right < model.threshold).mean()), float((junk < model.threshold).mean())
    return model


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", where: Column | None = None) -> Model:
    """Train on about PER_LANGUAGE rows of each language, EXCERPT characters of each: the only rows that reach the driver."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if where is None else where)).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    few = sample_by_class(known, "lang", "k", PER_LANGUAGE).select("k", excerpt(F.col("text"), F.col("k"), EXCERPT).alias("text"), "lang")
    return train([(r["text"], r["lang"]) for r in sorted(few.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["text"]))])


def predict(rows: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row's whole text: one narrow pass; the model has a fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(zip(*(shared.value.score(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 3
            yield batch(doc_id=(b.column(0), pa.int64()), lang_pred=(out[0], pa.string()), score=(out[1], pa.float64()), rejected=(out[2], pa.bool_()))

    return rows.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, SCHEMA)


def keep(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns: a narrow pass, no join."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.score(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
