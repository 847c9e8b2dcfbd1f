"""Near duplicates by the real similarity of five-word shingles: the pipeline's stage over SimHash anchors.

Candidates come from two nets. SimHash fingerprints of the five-word shingles meet at their anchors, as in `simhash`. At a similarity of 0.8 they differ in about a
seventh of their bits, far beyond any threshold that anchors can cover, so texts that agree in a band of ROWS of their BANDS * ROWS MinHash values
are candidates too: a pair of similarity s does so with probability 1 - (1 - s^ROWS)^BANDS, 0.9993 at 0.8. Either net gives stars, and components of the stars
are candidate groups. `confirm` then links all texts of a group whose sets of shingles reach a similarity of NEAR, whether they shared an anchor or a band or not: a group
first meets in parts that all hold its first set, and only what is not in its largest class then meets all parts.

Defined results: words are lower-cased and split at white space; fewer words than a shingle has make one shingle; texts without words are copies of each
other; null ids take no part. Texts of equal words are one class, of which one takes part. Rows that repeat an id stand for themselves, and share the component that is
the smallest any of them reaches. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batch, texts, written
from .components import components, meet_least
from .confirm import confirmed, mixed, shingled

SHINGLE, BANDS, ROWS, NEAR = 5, 24, 6, 0.8
#: Shingles that are hashed at a time.
CHUNK = 1 << 15
#: Bits in which the fingerprints of candidates may differ.
BITS = 2
ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIN, JOIN = ODD[: BANDS * ROWS], ODD[-ROWS:]


def shingles(words: list[bytes]) -> np.ndarray:
    """64 bits of each shingle, in order; one for a text without words."""
    return shingled(words, SHINGLE) if words else mixed(np.zeros(1, np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each text's shingles."""
    h = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat(h * a, starts) for a in MIN], axis=1).reshape(len(sets), BANDS, ROWS)
    return mixed((mixed(least) * JOIN).sum(-1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, d0, d1, f0, keys): a digest of 128 bits of the words, the SimHash fingerprint of the shingles, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, prints, keys, held, total = [], [], [np.zeros((0, BANDS), np.uint64)], [], 0
            for t in texts(b.column(1)):
                words = t.lower().split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                held.append(shingles(words))
                prints.append(simhash.majority(sum(simhash.votes(held[-1][i : i + CHUNK]) for i in range(0, len(held[-1]), CHUNK)), len(held[-1])))
                total += len(held[-1])
                if total >= CHUNK:
                    keys.append(band_keys(held))
                    held, total = [], 0
            if held:
                keys.append(band_keys(held))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            k = np.concatenate(keys)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * BANDS), pa.array(k.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.array(prints, np.uint64).view(np.int64)), rows], names=["doc_id", "d0", "d1", "f0", "keys"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, d0 long, d1 long, f0 long, keys array<long>")


def stars(rows: DataFrame) -> DataFrame:
    """(a, b) links that join the ids of each bucket, of rows (id, keys).

    Rows are sorted over all partitions by key and id, so that a bucket, however large, spans as many partitions as it needs. Each partition links a bucket's
    ids to the smallest it has; the first and the last bucket of each partition, which may go on elsewhere, are joined at the end."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1)
            n = np.diff(np.asarray(keys.offsets))
            yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.repeat(np.asarray(b.column(0)), n))], names=["key", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # key and smallest id of the bucket that may go on, and of the first one
        for b in batches:
            key, i = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            least = i[starts].copy()
            if last is not None and last[0] == key[0]:
                least[0] = last[1]
            first = first or (key[0], least[0])
            a = np.repeat(least, np.diff(np.append(starts, len(key))))
            last = key[-1], least[-1]
            yield batch(a=(a[a != i], pa.int64()), b=(i[a != i], pa.int64()), key=(np.full((a != i).sum(), 0), pa.int64()))
        for x in {first, last} - {None}:
            yield batch(a=([x[1]], pa.int64()), b=([None], pa.int64()), key=([x[0]], pa.int64()))

    found = written(rows.mapInArrow(spread, "key long, id long").repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(meet, "a long, b long, key long"), "stars")
    ends = found.where("b is null").select("key", F.col("a").alias("b"))  # two rows a partition at most
    ends = ends.join(ends.groupBy("key").agg(F.min("b").alias("a")), "key").where("a <> b")
    return found.where("b is not null").select("a", "b").union(ends.select("a", "b")).distinct()


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of each row: the smallest id reachable over links of similarity NEAR or more."""
    rows = written(sketches(docs, text, key), "sketches")
    nodes = written(rows.groupBy("d0", "d1").agg(F.min("doc_id").alias("id")), "nodes")
    own = written(rows.withColumnRenamed("doc_id", "id").join(nodes, ["d0", "d1", "id"]).select("id", "f0", "keys"), "own")
    same = own.groupBy("f0").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    anchored = simhash.links_of(same.select(F.col("m").alias("id"), "f0", none.alias("f1"), none.alias("f2")), BITS)
    alike = meet_least(own.select("f0", "id"), same.where("n > 1"), "f0", own.count()).select(F.col("m").alias("a"), F.col("id").alias("b"))
    groups = components(anchored.union(alike).union(stars(own.select("id", "keys"))))
    members = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(groups, "id")
    roots = components(confirmed(members, SHINGLE, NEAR))
    named = nodes.join(roots, "id", "left").select("d0", "d1", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "d0", "d1").join(named, ["d0", "d1"]).select("doc_id", "component_id")
