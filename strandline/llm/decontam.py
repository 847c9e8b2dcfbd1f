"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

A passage is SEGMENTS neighbouring segments of STEP words, and a passage starts at each segment, so any run of up to (SEGMENTS - 1) * STEP + 1 words lies
within one. An item's BM25 weights are divided by its score against itself, so one threshold holds for all items. No passage holds an item of more
words than a passage, so such an item is indexed in overlapping parts that each lie within one if they stand in a text, with weights divided by the part's
score; any part retrieves the item. Items that share their most frequent term stand side by side and form at most BOUNDS blocks. A block's bound for a passage, the sum of its distinct words' largest weights in the block, is
computed for all passages of a document at once; only where it reaches the threshold does block-max WAND walk the postings of that block's items. What
a walk retrieves is verified in the words around the passage: the shares of the item's question and of its answer whose word sequences occur there
must both reach VERIFIED.

An item's answer is its last sentence, or the last third of its words if it has but one sentence.

Defined results: one row for each document and item that are verified, with the best overlaps found; null and empty texts and items without words
give none. Items that repeat an id give a row each, and documents that repeat an id theirs. Items of which there are more than fit MOST_BYTES are indexed in several parts, each queried with all passages. Other columns are ignored, whatever their names; empty tables give no rows. The words of one text are held at a
time, with a number for each of its passages and blocks, so very long texts cost some hundred bytes a word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

STEP, SEGMENTS, BOUNDS, BLOCK, K1, B = 24, 3, 128, 16, 1.2, 0.75
PASSAGE = STEP * SEGMENTS
PART = (SEGMENTS - 1) * STEP + 1
#: Bound of the entries of the table of largest weights (terms x blocks, 4 bytes each): with more terms, blocks are wider.
MOST_ENTRIES = 16 << 20
#: Share of an item's score against itself that retrieves it; shares of word sequences of its question and answer that verify it; words of a sequence.
RETRIEVED, VERIFIED, GRAM = 0.6, 0.5, 5
MOST_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
#: ASCII letters are lower-cased, ASCII punctuation is a border between words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text) if (w := words_of(s.encode()))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) - len(words) // 3)
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """The words, or of more than a passage holds, runs of PART words that start at every STEP words and end with the last word."""
    if len(words) <= PASSAGE:
        return [words]
    return [words[i : i + PART] for i in (*range(0, len(words) - PART, STEP), len(words) - PART)]


@dataclass
class Postings:
    """A term's items in rising order with normalised weights, and the largest weight of each block of BLOCK."""

    items: list[int]
    weights: list[float]
    most: float = 0.0
    lasts: list[int] = field(default_factory=list)
    blocks: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.most = max(self.weights)
        self.lasts = [self.items[min(i + BLOCK, len(self.items)) - 1] for i in range(0, len(self.items), BLOCK)]
        self.blocks = [max(self.weights[i : i + BLOCK]) for i in range(0, len(self.weights), BLOCK)]


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        df = Counter(w for _, t in items for w in set(words_of(t.encode())))
        items = sorted(items, key=lambda x: (max((df[w], w) for w in words_of(x[1].encode())), x))
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        texts = [Counter(q + a) for q, a in self.parts]
        mean = sum(sum(t.values()) for t in texts) / max(1, len(texts)) or 1.0
        lists: dict[bytes, tuple[list, list]] = defaultdict(lambda: ([], []))
        self.of: list[int] = []  # the item of each entry: items of parts have several
        for i, t in enumerate(texts):
            n = sum(t.values())
            w = {x: math.log(1 + (len(texts) - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for x, f in t.items()}
            for part in parts_of([x for p in self.parts[i] for x in p]):
                own = {x: w[x] for x in dict.fromkeys(part)}
                total = sum(own.values())
                for x, v in own.items():
                    lists[x][0].append(len(self.of))
                    lists[x][1].append(v / total)
                self.of.append(i)
        self.terms = {x: Postings(*p) for x, p in lists.items()}
        self.wide = max(1, math.ceil(len(self.of) / max(1, min(BOUNDS, MOST_ENTRIES // (len(self.terms) + 1)))))  # entries of a block
        self.rows = {x: i for i, x in enumerate(self.terms, 1)}
        self.most = np.zeros((len(self.terms) + 1, math.ceil(len(self.of) / self.wide)), np.float32)
        for p, row in zip(self.terms.values(), self.most[1:], strict=True):
            np.maximum.at(row, np.array(p.items) // self.wide, np.array(p.weights, np.float32))

    def bounds(self, words: list[bytes]) -> np.ndarray:
        """For each passage and block, the sum of the passage's distinct words' largest weights (a word counts once in each segment)."""
        n, height = len(words), len(self.most)
        segments = (n - 1) // STEP + 1
        key = np.sort(np.arange(n) // STEP * height + np.fromiter(map(self.rows.get, words, repeat(0)), np.int64, n))
        key = key[(np.diff(key, prepend=-1) > 0) & (key % height > 0)]
        out = np.zeros((segments + SEGMENTS - 1, self.most.shape[1]), np.float32)
        if len(key):
            at = np.flatnonzero(np.diff(key // height, prepend=-1))
            out[(key // height)[at]] = np.add.reduceat(self.most[key % height], at, axis=0)
        return sum(out[k : segments + k] for k in range(SEGMENTS)) * np.float32(1.0001)

    def walk(self, terms: set[bytes], threshold: float, low: int = 0, high: float = math.inf) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of each item from `low` up to, without, `high` that reaches the threshold."""
        lists = [[p.items[at], at, p] for w in terms if (p := self.terms.get(w)) and (at := bisect_left(p.items, low)) < len(p.items)]  # current item, place, postings
        out = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, (_, _, p) in enumerate(lists):
                bound += p.most
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            if item >= high:
                break
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, math.inf
            for x in lists[: pivot + 1]:
                b = bisect_left(x[2].lasts, item)
                if b < len(x[2].lasts):
                    bound += x[2].blocks[b]
                    until = min(until, x[2].lasts[b])
            if bound < threshold:  # no item up to the next block's border can reach it
                item = until + 1 if pivot + 1 == len(lists) else min(until + 1, lists[pivot + 1][0])
                item = max(item, lists[pivot][0] + 1)
            elif lists[0][0] == item:
                score = sum(x[2].weights[x[1]] for x in lists[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                item += 1
            for x in lists[: pivot + 1]:
                if x[0] < item:
                    x[1] = bisect_left(x[2].items, item, x[1])
                    x[0] = x[2].items[x[1]] if x[1] < len(x[2].items) else -1
            lists = [x for x in lists if x[0] >= 0]
        return out

    def find(self, text: bytes, threshold: float = RETRIEVED, verified: float = VERIFIED) -> list[tuple[int, float, float, float]]:
        """(item id, score, overlap of question, of answer) of each item in a text, the best of its passages."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        best: dict[int, tuple] = {}
        for p, block in zip(*(x.tolist() for x in np.nonzero(self.bounds(words) >= threshold)), strict=True):
            s = p * STEP
            for entry, score in self.walk(set(words[s : s + PASSAGE]), threshold, block * self.wide, (block + 1) * self.wide):
                item = self.of[entry]
                q, a = self.parts[item]
                margin = len(q) + len(a)  # an item may go on beyond the passage
                near = words[max(0, s - margin) : s + PASSAGE + margin]
                shares = [self.share(part, near) for part in (q, a)]
                if min(shares) >= verified and (score, *shares) > best.get(item, ()):
                    best[item] = (score, *shares)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]

    @staticmethod
    def share(part: list[bytes], near: list[bytes]) -> float:
        n = min(GRAM, len(part))
        want = grams(part, n) if n else set()
        return len(want & grams(near, n)) / len(want) if want else 1.0


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """The items in as many parts as MOST_BYTES asks for; each part's postings have a bounded size."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / MOST_BYTES))
    return [Index(sorted((r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect() if words_of(r["t"].encode()))) for p in range(parts)]


def contaminated(docs: DataFrame, found: list[Index], threshold: float = RETRIEVED, verified: float = VERIFIED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item it holds. A narrow pass for each part of the items."""
    out = None
    for index in found:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, *hit) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for hit in shared.value.find(t, threshold, verified)]
                c = list(zip(*rows, strict=True)) or [[]] * 5
                yield batch(doc_id=(c[0], pa.int64()), item_id=(c[1], pa.int64()), score=(c[2], pa.float64()), question_overlap=(c[3], pa.float64()), answer_overlap=(c[4], pa.float64()))

        part = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, found: list[Index], threshold: float = RETRIEVED, verified: float = VERIFIED, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for index in found:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not (t and shared.value.find(t.encode(), threshold, verified)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
