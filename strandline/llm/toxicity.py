"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text and one on ordinary text.

A text is cut into overlapping windows. Each window is compressed twice, with either dictionary, and the difference in length is the window's
distance. Both dictionaries end with the same trained ordinary content, so that what both texts share costs the same at the same offsets; the toxic one
has, in front of it, content trained on toxic text. Toxic texts consist of ordinary words for the most part, and dictionaries trained on whole
texts of either class tell them apart badly (held-out AUC 0.72). So training sees those parts of the words of toxic texts whose character
sequences speak for the class: a sequence's ratio of frequencies among toxic and ordinary texts must be over a least one by two standard errors, so that
wrong labels of some ordinary texts don't empty the dictionary. A text's largest distances
and its windows above a calibrated threshold go through a logistic fit on whole labelled texts.

Nothing is calibrated on texts that trained the dictionary it is used with. The labelled texts are dealt into two halves by a hash of their key; dictionaries trained on
either half give the threshold and the distances of the other half's texts. The least ratio is the one of RATIOS whose logistic fit on these has the least loss. The
final dictionaries are trained on both halves with that ratio and take over the threshold and the fit.

Defined results: null and empty texts have one empty window and are scored like any other; very long texts are scored in windows, all of them; repeated rows and labels count as often as they
stand there; without labelled rows of both classes each score is the share of the class there is (0 without any); other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, excerpt, sampled_documents
from .quality import sigmoid

#: Bytes of a window, of the step between windows, and of either dictionary.
WINDOW, STEP, DICTIONARY = 96, 64, 16 << 10
#: Bytes of the character sequences that select parts of words for the toxic dictionary, and the least ratios of their frequencies to choose from.
GRAM, RATIOS = 5, (3, 6, 12)
#: Bounds of the fitting sample: rows of a class, and characters of a row for the dictionaries.
PER_CLASS, EXCERPT = 2500, 1500
SCHEMA = "doc_id long, score double"


def windows(text: bytes) -> Iterator[bytes]:
    """Overlapping windows that cover the whole text; at least one."""
    for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP):
        yield text[i : i + WINDOW]


def packer(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(dict_data=d, compression_params=zstd.ZstdCompressionParameters.from_level(7, source_size=WINDOW, dict_size=2 * DICTIONARY, hash_log=17, chain_log=16, search_log=5, strategy=zstd.STRATEGY_LAZY2, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float = 0.0
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    share: float = 0.0

    def __post_init__(self):
        self._packers = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def __setstate__(self, state):
        self.__dict__.update(state, _packers=None)

    def distances(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if self._packers is None:
            self._packers = packer(self.ordinary).compress, packer(self.toxic + self.ordinary).compress
        a, b = self._packers
        return np.fromiter((len(a(x)) - len(b(x)) for x in pieces), np.float64, len(pieces))

    def features(self, text: bytes) -> np.ndarray:
        top, n, over = [-99.0, -99.0], 0, 0
        held: list[bytes] = []
        for x in windows(text):
            held.append(x)
            if len(held) == 4096:
                top, n, over, held = self._add(top, n, over, held)
        top, n, over, _ = self._add(top, n, over, held)
        return np.array([np.clip(top[0], 0, 8), np.clip(top[1], 0, 8), np.log1p(over)])

    def _add(self, top, n, over, held):
        if held:
            d = self.distances(held)
            top = sorted([*top, *d.tolist()])[::-1][:2]
            n, over = n + len(d), over + int((d >= self.threshold).sum())
        return top, n, over, []

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.share
        x = (self.features(text) - self.mean) / self.spread
        return float(sigmoid(self.weights[0] + x @ self.weights[1:]))


def dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(DICTIONARY, samples, k=24, d=6).as_bytes()
    except zstd.ZstdError:  # too few samples for training: their own content
        return b"".join(samples)[-DICTIONARY:] or b"\0" * 8


def grams(word: bytes) -> set[bytes]:
    word = b" " + word
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def marked(word: bytes, own: set[bytes]) -> Iterator[bytes]:
    """The maximal parts of a word that such sequences cover."""
    word, start, end = b" " + word, 0, -1
    for i in range(len(word) - GRAM + 1):
        if word[i : i + GRAM] in own:
            if i > end and end >= 0:
                yield word[start:end]
            start, end = (start if 0 <= i <= end else i), i + GRAM
    if end >= 0:
        yield word[start:end]


def sequences(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """For each character sequence of toxic texts, the ratio of its frequencies among toxic and ordinary texts, two standard errors of its logarithm below."""
    counts = [Counter(), Counter()]
    for many, found in zip((ordinary, toxic), counts, strict=True):
        for t in many:
            found.update(set().union(*map(grams, t.split())))
    out = {}
    for g, n in counts[1].items():
        if n >= 4:
            o = counts[0][g] + 0.5
            out[g] = n / max(1, len(toxic)) / (o / max(1, len(ordinary))) * float(np.exp(-2 * np.sqrt(1 / n + 1 / o)))
    return out


def train_dictionaries(rows: list[tuple[bytes, int]], ratio: float = RATIOS[0]) -> Model:
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y != 1]
    own = {g for g, r in sequences(toxic, ordinary).items() if r >= ratio}
    samples = [b"\0".join(part for w in t.split() for part in marked(w, own)) for t in toxic]  # no match runs across a border
    return Model(dictionary([w for t in ordinary for w in windows(t)]), dictionary(samples))


def threshold(model: Model, ordinary: list[bytes]) -> float:
    """A distance that hardly any window of these ordinary texts reaches."""
    return max(1.0, float(np.quantile(model.distances([w for t in ordinary for w in windows(t)]), 0.999)) + 1) if ordinary else 1.0


def half(key: int | None) -> int:
    return xxhash.xxh64_intdigest(str(key), 9) & 1


def train_scores(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression on the features of whole texts (iteratively reweighted least squares, lightly regularised)."""
    model.share = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return model
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack((np.ones(len(x)), (x - model.mean) / model.spread))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = sigmoid(z @ w)
        r = p * (1 - p) + 1e-6
        w -= np.clip(np.linalg.solve((z * r[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (p - y) + 0.5 * w), -2, 2)
    model.weights = w
    return model


def loss(model: Model, x: np.ndarray, y: np.ndarray) -> float:
    if model.weights is None:
        return float("inf")
    p = np.clip(sigmoid(model.weights[0] + (x - model.mean) / model.spread @ model.weights[1:]), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", where: Column | None = None) -> Model:
    """Train on about PER_CLASS labelled documents of each class. Only excerpts of them, and three numbers of each whole text and ratio, reach the driver."""
    few = sampled_documents(docs.select(key, F.col(text).alias("t")), labels, label, key, PER_CLASS, where)
    order = lambda rows: sorted(rows, key=lambda r: (r["k"] is None, r["k"] or 0, r["y"]))
    held = [(half(r["k"]), (r["t"] or "").encode(), r["y"]) for r in order(few.select("k", excerpt(F.col("t"), F.col("k"), EXCERPT).alias("t"), "y").collect())]
    # For each ratio two models, trained on either half and calibrated on the other.
    pairs = [[train_dictionaries([(t, y) for h, t, y in held if h == side], ratio) for side in (0, 1)] for ratio in RATIOS]
    for pair in pairs:
        limit = max(threshold(pair[side], [t for h, t, y in held if h != side and y != 1]) for side in (0, 1))
        for model in pair:
            model.threshold = limit
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[z for pair in shared.value for z in pair[1 - half(k)].features(t or b"").tolist()] for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield batch(k=(b.column(0), pa.int64()), y=(b.column(1), pa.int32()), x=(x, pa.list_(pa.float64())))

    got = order(few.select(F.col("k").cast("long"), "y", F.col("t").cast("binary")).mapInArrow(run, "k long, y int, x array<double>").collect())
    x, y = np.array([r["x"] for r in got]).reshape(len(got), len(RATIOS), 3), np.array([r["y"] for r in got], np.float64)
    fits = [train_scores(Model(b"", b"", pair[0].threshold), x[:, i], y) for i, pair in enumerate(pairs)]
    best = min(range(len(RATIOS)), key=lambda i: loss(fits[i], x[:, i], y))
    whole = train_dictionaries([(t, y) for _, t, y in held], RATIOS[best])
    return replace(fits[best], ordinary=whole.ordinary, toxic=whole.toxic)


def score(rows: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of each whole text: one narrow pass; the dictionaries have a fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(doc_id=(b.column(0), pa.int64()), score=([shared.value.score(t or b"") for t in b.column(1).to_pylist()], pa.float64()))

    return rows.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, SCHEMA)
