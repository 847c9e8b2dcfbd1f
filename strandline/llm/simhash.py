"""SimHash near duplicates by anchor-point covering.

A fingerprint's low 46 bits are two words of 23 bits. The anchors are the pairs of codewords of the perfect binary Golay code of length 23:
each word lies within 3 bits of exactly one codeword, so the pairs cover all fingerprints with radius 3 + 3. A fingerprint's home is its
nearest anchor. Let two fingerprints differ in at most `threshold` bits: then the second lies, in either word, at most 3 bits plus its
differing bits from the first one's home. So each fingerprint is replicated to every anchor whose distances exceed the covering radius
by at most `threshold` in sum (about 61 anchors for two bits), and comparing the homes of an anchor with all its replicas finds every link.

Only distinct fingerprints are replicated, with the smallest id of their class. Within an anchor, links are replaced by stars from the
smallest member of each linked set, so a dense group gives as many links as members, not pairs. Components then join the stars.

Defined results: texts without words have fingerprint zero and link like any other; fewer words than a shingle has make one
shingle; rows repeat as in the input; a null id takes no part in linking and gets the component of its fingerprint's class, if any; a bit set in exactly half of the
shingles is 0; other columns are ignored, whatever their names; an empty table gives no rows; very long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, texts, written
from .components import components

GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
WORD = np.uint64((1 << 23) - 1)
BLOCK = 8192
#: Compared pairs that are held in memory at a time.
PAIRS = 1 << 20


def simhash(words: list[bytes], k: int, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        part = words[i : min(n, i + BLOCK) + k - 1]
        shingles = part if k == 1 else map(b" ".join, zip(*(part[j:] for j in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
        counts += votes(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64))
    return majority(counts, n)


def votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from the highest bit on."""
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes())


def fingerprints(docs: DataFrame, shapes: list[tuple[int, int]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, f0, f1, ...) with a fingerprint for each (words of a shingle, seed), as signed longs."""
    names = [f"f{i}" for i in range(len(shapes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[simhash(w, k, seed) for k, seed in shapes] for w in (t.lower().split() for t in texts(b.column(1)))]
            cols = np.array(rows, np.uint64).reshape(len(rows), len(shapes)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(cols[:, i]) for i in range(len(shapes)))], names=["doc_id", *names])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in ["doc_id", *names]))


def remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def cosets(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, offsets by syndrome, error patterns of weight up to `most` by syndrome and weight)."""
    unit = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 11, np.uint64)
    for i in range(23):
        part, j = (low, i) if i < 12 else (high, i - 12)
        part[(np.arange(len(part)) >> j & 1) == 1] ^= np.uint64(unit[i])
    bits = [np.uint64(sum(1 << i for i in c)) for w in range(most + 1) for c in combinations(range(23), w)]
    e = np.array(bits, np.uint64)
    s = low[e & np.uint64(4095)] ^ high[e >> np.uint64(12)]
    order = np.lexsort((np.bitwise_count(e), s))
    return low, high, np.searchsorted(s[order], np.arange(2049).astype(np.uint64)), e[order]


def near_codewords(words: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, bits over the covering radius) of each codeword within 3 + threshold bits of each 23-bit word."""
    low, high, starts, errors = cosets(3 + threshold)
    s = (low[words & np.uint64(4095)] ^ high[words >> np.uint64(12)]).astype(np.int64)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
    e = errors[at]
    return row, words[row] ^ e, np.maximum(np.bitwise_count(e).astype(np.int64) - 3, 0)


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor that a fingerprint is replicated to."""
    r1, c1, x1 = near_codewords(fp & WORD, threshold)
    r2, c2, x2 = near_codewords(fp >> np.uint64(23) & WORD, threshold)
    n2 = np.bincount(r2, minlength=len(fp))
    start2 = np.cumsum(n2) - n2
    n = n2[r1]
    left = np.repeat(np.arange(len(r1)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start2[r1], n)
    good = x1[left] + x2[right] <= threshold
    left, right = left[good], right[good]
    return r1[left], c1[left] | c2[right] << np.uint64(23)


def is_home(anchor: np.ndarray, fp: np.ndarray) -> np.ndarray:
    x = anchor ^ fp
    return (np.bitwise_count(x & WORD) <= 3) & (np.bitwise_count(x >> np.uint64(23) & WORD) <= 3)


def compare(anchor, ids, fp, f1, f2, mask, threshold: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links among rows that are sorted by anchor. A pair is linked if its masked fingerprints differ in at most `threshold` bits and
    its further fingerprints in at most `most` bits in all."""
    cut = np.flatnonzero(np.diff(anchor)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(anchor)]))
    run = np.repeat(np.arange(len(starts)), ends - starts)
    home = np.flatnonzero(is_home(anchor, fp) & (ends - starts > 1)[run])
    width = (ends - starts)[run[home]]
    label = np.arange(len(anchor))
    edges = []
    i = 0
    total = np.cumsum(width)
    while i < len(home):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        n = width[i:j]
        h = np.repeat(home[i:j], n)
        x = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run[home[i:j]]], n)
        good = (x != h) & (np.bitwise_count((fp[h] ^ fp[x]) & mask) <= threshold)
        h, x = h[good], x[good]
        if most < 128:
            good = np.bitwise_count(f1[h] ^ f1[x]).astype(np.int64) + np.bitwise_count(f2[h] ^ f2[x]) <= most
            h, x = h[good], x[good]
        h, x = label[h], label[x]  # what is linked already adds nothing
        apart = h != x
        edges = [(h[apart], x[apart])]
        while len(edges[0][0]):
            a, b = edges[0]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, hi, lo)
            while not np.array_equal(label, label[label]):
                label = label[label]
            a, b = label[a], label[b]
            apart = a != b
            edges = [(a[apart], b[apart])]
        i = j
    moved = np.flatnonzero(label != np.arange(len(label)))
    yield ids[label[moved]], ids[moved]


def links_of(nodes: DataFrame, threshold: int = 2, mask: int = (1 << 64) - 1, most: int = 128) -> DataFrame:
    """Star links (a, b) between the ids of nodes (id, f0, f1, f2) whose fingerprints are near. The one shuffle deals replicas out by anchor."""
    mask = np.uint64(mask)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.asarray(c) for c in b.columns]
            for i in range(0, b.num_rows, 2048):
                c = [x[i : i + 2048] for x in whole]
                row, anchor = anchors_of(c[1].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *(pa.array(x[row]) for x in c)], names=["anchor", "id", "f0", "f1", "f2"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows):
            u = [x.view(np.uint64) for x in rows]
            for a, b in compare(u[0], rows[1], u[2], u[3], u[4], mask, threshold, most):
                yield batch(a=(a, pa.int64()), b=(b, pa.int64()))

        for b in batches:
            rows = [np.asarray(c) for c in b.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last anchor may go on
            if cut and cut >= 1 << 16:
                yield from out([x[:cut] for x in rows])
                rows = [x[cut:] for x in rows]
            held = rows
        if held is not None and len(held[0]):
            yield from out(held)

    rows = nodes.select("id", "f0", "f1", "f2").where("id is not null").mapInArrow(spread, "anchor long, id long, f0 long, f1 long, f2 long")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "a long, b long").distinct()


def near_groups(docs: DataFrame, shapes: list[tuple[int, int]], threshold: int = 2, mask: int = (1 << 64) - 1, most: int = 128, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: the first shape gives the fingerprint that anchors cover; up to two more must then
    differ in at most `most` bits together. component_id is the smallest id reachable over links."""
    fps = fingerprints(docs, shapes, text, key)
    for i in range(len(shapes), 3):
        fps = fps.withColumn(f"f{i}", F.lit(0).cast("long"))
    fps = written(fps, "fingerprints")
    same = ["f0", "f1", "f2"]
    nodes = written(fps.groupBy(*same).agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(links_of(nodes, threshold, mask, most))
    named = nodes.join(roots, "id", "left").select(*same, F.coalesce("root", "id").alias("component_id"))
    return fps.join(named, same).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
