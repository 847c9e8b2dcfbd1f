"""MinHash near duplicates by an LSH forest: several sorted orders of MinHash signatures, whose neighbours of long common prefix are candidates.

A tree of the forest is an order of all signatures: TREES trees of DEEPEST values each, every value the least of a hash function over a set's shingles. Rows (tree, values, id)
are sorted over all partitions, so neighbours share long prefixes. A region is a run of neighbours that agree in the first SHALLOWEST values; a region of over CROWD members is cut at the next
value, and so on down to DEEPEST values: dense regions are deeper than sparse ones. The members of a region become candidates by a star to their smallest id. Two sets of similarity s share
a prefix of d values with probability s^d in each tree, so at 0.8 no tree holds such a pair together with a probability of 1.2e-7 where regions are sparse, and of 8e-5 in the densest.

Candidate groups are components of these stars, and all links are confirmed on full sets (`confirm`): the sets of a group meet in parts of bounded size with the group's first set,
and what one part can't settle, sets that aren't yet linked to the group's largest class, meets every part. No set is left out.

Defined results: A-Z are lower-cased, words are runs of anything but white space; fewer words than a shingle has make one shingle; texts without words, empty or null, have empty sets and
are linked with nothing, not even each other; repeated rows stand for themselves; equal sets are one class, of which one takes part; null ids take no part in links and get
their class's component, if any; other columns are ignored; an empty table gives no rows. A very long text costs 8 bytes a word and a bounded matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, grouped, removed, texts, written
from .components import components, meet_least
from .confirm import confirmed, mixed, shingled

SHINGLE, NEAR = 4, 0.8
TREES, SHALLOWEST, DEEPEST, CROWD = 40, 5, 7, 64
#: Bits of a value: those of the shallow prefix and the tree's number fill one long, deeper values another.
BITS, DEEP = 11, 16
#: Shingles that go through all hash functions at a time.
CHUNK = 1 << 14
FUNCTIONS = np.random.default_rng(7).integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none empty) the least value of each hash function, TREES * DEEPEST of them. Long sets go in pieces."""
    out = np.full((len(FUNCTIONS), len(sets)), np.iinfo(np.uint64).max, np.uint64)
    pieces = ((i, s[j : j + CHUNK]) for i, s in enumerate(sets) for j in range(0, len(s), CHUNK))
    for some in grouped(pieces, CHUNK, lambda x: len(x[1])):  # of a set at most one piece at a time
        h = np.concatenate([s for _, s in some])
        begins = np.cumsum([0, *(len(s) for _, s in some[:-1])])
        rows = np.array([i for i, _ in some])
        for least, a in zip(out, FUNCTIONS, strict=True):
            least[rows] = np.minimum(least[rows], np.minimum.reduceat(h * a, begins))
    return out.T


def prefixes(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sort keys of each tree: its number with SHALLOWEST values, and the deeper values."""
    v = mixed(least).reshape(len(least), TREES, DEEPEST)
    shallow = np.broadcast_to(np.arange(TREES, dtype=np.uint64), v.shape[:2])
    for i in range(SHALLOWEST):
        shallow = shallow << np.uint64(BITS) | v[:, :, i] >> np.uint64(64 - BITS)
    deep = np.zeros(v.shape[:2], np.uint64)
    for i in range(SHALLOWEST, DEEPEST):
        deep = deep << np.uint64(DEEP) | v[:, :, i] >> np.uint64(64 - DEEP)
    return shallow.view(np.int64), deep.view(np.int64)


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, digest, shallow, deep): the size and a digest of 128 bits of each set, and its keys in all trees; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TREES), pa.array(x.ravel()))
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                sets = [np.unique(shingled(t.lower().split(), SHINGLE)) for t in texts(some.column(1))]
                full = [i for i, s in enumerate(sets) if len(s)]
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                shallow, deep = prefixes(signatures([sets[i] for i in full])) if full else (np.zeros((0, TREES), np.int64),) * 2
                take = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), lists(shallow).take(take), lists(deep).take(take)],
                    names=["doc_id", "n_shingles", "digest", "shallow", "deep"],
                )

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, shallow array<long>, deep array<long>")


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def regions(shallow: np.ndarray, deep: np.ndarray, crowd: int = CROWD) -> np.ndarray:
    """Where the regions of sorted rows begin: runs of the shallow key, those of more than `crowd` rows cut at deeper values as long as they are crowded."""
    begins = runs(shallow)
    for level in range(1, DEEPEST - SHALLOWEST + 1):
        sizes = np.diff(np.append(begins, len(shallow)))
        if not (sizes > crowd).any():
            break
        finer = runs(shallow, deep >> DEEP * (DEEPEST - SHALLOWEST - level))
        inside = np.repeat(sizes > crowd, sizes)
        begins = np.union1d(begins, finer[inside[finer]])
    return begins


def candidates(nodes: DataFrame) -> DataFrame:
    """Star links (a, b) between the ids of nodes (id, shallow, deep) that share a region of a tree.

    A region may go on in the next partition. Each partition joins its own part of it, and the parts at its ends are joined by their shallow key."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shallow, deep = b.column(1), b.column(2)
            yield pa.RecordBatch.from_arrays([shallow.flatten(), deep.flatten(), pa.array(np.repeat(np.asarray(b.column(0)), np.diff(np.asarray(shallow.offsets))))], names=["shallow", "deep", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = None, []

        def stars(shallow, deep, ids, last):
            begins = regions(shallow, deep)
            least = np.minimum.reduceat(ids, begins)
            if not ends:
                ends.append((shallow[0], least[0]))
            if last:
                ends.append((shallow[-1], least[-1]))
            a = np.repeat(least, np.diff(np.append(begins, len(ids))))
            return batch(a=(a[a != ids], pa.int64()), b=(ids[a != ids], pa.int64()), shallow=(np.zeros((a != ids).sum(), np.int64), pa.int64()))

        for b in batches:
            rows = [np.asarray(c) for c in b.columns]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last shallow run may go on
            if whole >= 1 << 15:
                yield stars(*(x[:whole] for x in held), False)
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield stars(*held, True)
            for shallow, least in set(ends):
                yield batch(a=([least], pa.int64()), b=([None], pa.int64()), shallow=([shallow], pa.int64()))

    rows = nodes.select("id", "shallow", "deep").mapInArrow(spread, "shallow long, deep long, id long")
    found = written(rows.repartitionByRange("shallow", "deep", "id").sortWithinPartitions("shallow", "deep", "id").mapInArrow(meet, "a long, b long, shallow long"), "regions")
    ends = found.where("b is null").select("shallow", F.col("a").alias("b"))  # two rows a partition at most
    ends = ends.join(ends.groupBy("shallow").agg(F.min("b").alias("a")), "shallow").where("a <> b")
    return found.where("b is not null").select("a", "b").union(ends.select("a", "b")).distinct()


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", near: float = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, and the smallest id reachable over links of similarity `near` or more."""
    rows = written(sketches(docs, text, key), "sketches")
    nodes = written(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    own = written(rows.where("digest is not null").withColumnRenamed("doc_id", "id").join(nodes.select("digest", "id"), ["digest", "id"]).dropDuplicates(["digest", "id"]).select("id", "shallow", "deep"), "own")
    groups = written(components(candidates(own)), "groups")
    # Texts are dealt out by id at every size of the table.
    members = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(groups.hint("shuffle_hash"), "id")
    roots = components(confirmed(members, SHINGLE, near))
    named = written(nodes.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("m"), "n"), "named")
    keyed = meet_least(rows.where("digest is not null").select("digest", "doc_id", "n_shingles"), named, "digest", rows.count())
    out = keyed.select("doc_id", "n_shingles", F.col("m").alias("component_id"))
    for table in (own, groups):
        removed(table)
    return out.union(rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
