"""Confirms candidate groups of texts on their full sets of word shingles.

A group's sets lie in parts of about PART bytes, each with the group's first set in it. Sets of a part are linked by an inverted index (`linked`), which ends as soon as
all are one class; so a dense group, however many parts it has, is settled there, as every part is tied to the first set. In a group of several parts that still has several
classes, the sets outside its largest class, cut into blocks of about PART bytes, then meet every part. No pair but those within the largest class is left out, no task holds more than a
part and a block, and the work is that of parts times blocks, which is one block for groups that are near copies of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, texts, written
from .components import components

#: Bytes of the sets of a part, and of a table that may be broadcast.
PART, BROADCAST = 4 << 20, 16 << 20
PLACE = np.random.default_rng(42).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingled(words: list[bytes], k: int) -> np.ndarray:
    """64 bits of each shingle of k words, in order; of all words if they are fewer; none without words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    if not words or n > 0:
        return mixed(sum((h[j : n + j] * PLACE[j] for j in range(k)), np.zeros(max(0, n), np.uint64)))
    return mixed((h * PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))


def linked(sets: list[np.ndarray], label: np.ndarray, near: float) -> np.ndarray:
    """The labels of the sets after those of all linked sets are joined to the smaller one; sets hold distinct shingles and are not empty."""
    label = label.copy()
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    posted, ends = owner[order], np.cumsum(np.bincount(code))
    begins = np.concatenate(([0], ends[:-1]))
    first = np.cumsum(size) - size
    for h in range(len(sets)):
        if (label == label[h]).all():
            break
        if (label[h:] == label[h]).all():
            continue
        c = code[first[h] : first[h] + size[h]]
        n = ends[c] - begins[c]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins[c], n)
        both = np.bincount(posted[at], minlength=len(sets))
        good = both >= near * (size + size[h] - both) - 1e-9
        if (joined := np.unique(label[good])).size > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def met(rows: DataFrame, near: float) -> DataFrame:
    """(a, b) links that the sets of each task (root, p, q) show, of rows (root, p, q, label, id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out():
            _, label, sets = zip(*held, strict=True)
            label = np.array(label, np.int64)
            now = linked(sets, label, near)
            moved = now != label
            return batch(a=(now[moved], pa.int64()), b=(label[moved], pa.int64()))

        for b in batches:
            for root, p, q, label, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, p, q) != last and held:
                    yield out()
                    held = []
                last = root, p, q
                held.append((i, label, np.frombuffer(s, np.uint64)))
        if held:
            yield out()

    rows = rows.select("root", "p", "q", "label", "id", "s")
    return rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "id").mapInArrow(run, "a long, b long").distinct()


def meet(rows: DataFrame, few: DataFrame, key: str, n: int, how: str = "left") -> DataFrame:
    """A join with n rows, broadcast only if these are small enough."""
    return rows.join(F.broadcast(few) if n * 64 <= BROADCAST else few, key, how)


def confirmed(members: DataFrame, k: int, near: float) -> DataFrame:
    """(a, b) links between the members (root, id, t) of candidate groups whose shingle sets have a similarity of `near` or more; links that follow from others may be
    left out, so components of these are those of all. `root` is the smallest id of its group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # so that a row repeated very often is one row of each task
        for b in batches:
            sets = [np.unique(shingled(t.lower().split(), k)).tobytes() for t in texts(b.column(2))]
            keys = [(i, xxhash.xxh3_128_digest(s)) for i, s in zip(b.column(1).to_pylist(), sets, strict=True)]
            new = pa.array([not (x in seen or seen.add(x)) for x in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["root", "id", "s"]).filter(new)

    sets = written(members.select("root", "id", "t").mapInArrow(cut, "root long, id long, s binary").where("octet_length(s) > 0"), "shingles")
    size = sets.groupBy("root").agg(F.sum(F.octet_length("s")).alias("bytes"))
    large = written(size.where(F.col("bytes") > PART).select("root", F.ceil(F.col("bytes") / PART).cast("int").alias("parts")), "large")
    n = large.count()
    sets = meet(sets, large, "root", n).withColumn("parts", F.coalesce("parts", F.lit(1)))
    p = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    own = sets.withColumn("p", p)
    every = F.explode(F.when(F.col("id") == F.col("root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(p)))  # a group's first set is in all its parts
    links = written(met(sets.withColumn("p", every).withColumns({"q": F.lit(0), "label": F.col("id")}), near), "near")
    if not n:
        return links
    # Classes of the groups of several parts, and the sets outside of each group's largest class.
    several = labelled(own.where("parts > 1"), components(links))
    classes = several.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes"))
    main = written(classes.groupBy("root").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("bytes").alias("all"), F.count("*").alias("classes"), F.max_by("bytes", F.struct("n", -F.col("label"))).alias("most")).where("classes > 1").select("root", "main", F.ceil((F.col("all") - F.col("most")) / PART).cast("int").alias("blocks")), "main")
    left = meet(several, main, "root", main.count(), "inner")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    parts = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = left.where("label <> main").withColumns({"q": block, "own": F.col("p")}).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("p <> own")
    columns = ["root", "p", "q", "label", "id", "s"]
    return links.union(met(parts.select(*columns).union(blocks.select(*columns)), near))


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the label of their class, (id, root) of components; ids without links are their own."""
    return rows.join(roots.select("id", F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
