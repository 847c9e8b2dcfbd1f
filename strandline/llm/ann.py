"""Approximate nearest neighbours by an inverted multi-index, for largest inner products.

A vector x gets one more component sqrt(M^2 - |x|^2), M being the largest norm, and a query a zero there: least distance is then largest
inner product. Either half of a vector is quantised by its own K centroids, so a cell is one of K^2 centroid pairs. For a query, the
distances to both lists of centroids are sorted and a heap yields pairs by rising sum of distances, until the cells so far hold enough vectors;
those are reranked exactly, in double precision, on the original vectors.

How many vectors are enough is measured: on the sample that fits the centroids, true neighbours are found by brute force, and the share of vectors
whose cells come up to the neighbour's cell gives the share to visit for a recall of TARGET. Clustered vectors need a few percent of a table, vectors
without any structure up to half of it. Neighbours in a sample lie farther off than in the table, so the share errs to the larger side.

Neighbouring cells form blocks of bounded size, and a cell that holds more, even a third of all vectors, is split over several. A query goes once
to each block in which it visits cells, and only vectors of blocks that a query visits are sent, once for each ASKS of a block's queries. A first round visits its nearest cells and so finds a bound; the second round leaves out the cells whose
centroids and radii show that nothing in them can reach that bound, and a block gives back only what reaches it.

Defined results: vectors that are null, of another length than most, zero, or with null or non-finite components take no part; equal
scores go to the smaller id; an empty table gives no rows. Rows are told apart by place, not by id: a repeated row is a candidate as often as it stands
there and, as a query, asks as often; a query leaves out one row of its own id and vector, itself; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bounds: vectors that fit the centroids, centroids of a half, vectors of a block, queries that meet a block in one task, and those compared with centroids at a time.
SAMPLE, MOST_CENTROIDS, BLOCK, ASKS, CHUNK = 20_000, 512, 4096, 16_384, 1024
#: Recall that the share of visited vectors is measured for, and queries that measure it.
TARGET, ASKED = 0.95, 256
FOUND = "asked long, query_id long, row long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def halves(x: np.ndarray, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Either half; the second has the added component (None: a query's zero)."""
    m = x.shape[1] // 2
    more = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
    return x[:, :m], np.column_stack((x[:, m:], more))


def traverse(d1: np.ndarray, d2: np.ndarray, counts: list[int], first: int, enough: int) -> tuple[float, float, list[int]]:
    """The multi-sequence walk over both sorted lists: cells by rising d1 + d2 until they hold `first` and then `enough` vectors.
    Returns the sums reached at either point and the cells up to the first."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    a, b, k = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    heap, cells, held, low, high = [(a[0] + b[0], 0, 0)], [], 0, -math.inf, -math.inf
    while heap and held < enough:
        high, i, j = heapq.heappop(heap)
        cell = o1[i] * k + o2[j]
        if n := counts[cell]:
            if held < first:
                cells.append(cell)
                low = high
            held += n
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # a row opens when its first pair may be next
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return low, high, cells


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order whatever stands beside it."""
    return (x * q).sum(1)


def usable(vec: str, dim: Column | int) -> Column:
    c = F.col(vec)
    return c.isNotNull() & (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)


def share_for(few: np.ndarray, c1: np.ndarray, c2: np.ndarray, most: float, top: int, target: float = TARGET, seed: int = 3) -> float:
    """The share of vectors that a walk must visit to find `target` of the `top` true neighbours, over a sample."""
    if len(few) <= top + 1:
        return 1.0
    asks = np.random.default_rng(seed).choice(len(few), min(ASKED, len(few)), replace=False)
    x1, x2 = halves(few, most)
    i1, i2 = nearest(x1, c1), nearest(x2, c2)
    q1, q2 = halves(few[asks], None)
    d1, d2 = distances(q1, c1), distances(q2, c2)
    need = []
    for j, at in enumerate(asks):
        scores = few @ few[at]
        scores[at] = -np.inf
        sums = d1[j][i1] + d2[j][i2]
        need.append((np.searchsorted(np.sort(sums), sums[np.argpartition(-scores, top)[:top]], "right")) / len(few))
    return float(np.quantile(np.concatenate(need), target))


class Index:
    """The vectors with their cells, as a written table, the centroids, and the radii of cells."""

    def __init__(self, vectors: DataFrame, key: str, vec: str, top: int = 20):
        rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
        dim = rows.where("v is not null").agg(F.mode(F.size("v"), deterministic=True)).first()[0] or 0
        rows = rows.where(usable("v", dim))
        total, most = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
        self.dim, self.total, self.most, self.share = dim, total, most, 1.0
        self.c1 = self.c2 = np.zeros((0, 0))
        self.counts: list[int] = []
        if not total:
            return
        place = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        few = np.array([r["v"] for r in rows.where(place < min(1.0, SAMPLE / total)).limit(2 * SAMPLE).select("vec_id", "v").collect()] or [rows.first()["v"]], np.float64)
        few = np.unique(few, axis=0)  # copies don't draw centroids
        k = max(1, min(MOST_CENTROIDS, round(math.sqrt(total / 8)), len(few)))
        h1, h2 = halves(few, most)
        self.c1, self.c2 = kmeans(h1, k), kmeans(h2, k)
        self.share = share_for(few, self.c1, self.c2, most, top)
        c1, c2 = self.c1, self.c2

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x1, x2 = halves(matrix(b.column(2), dim), most)
                i1, i2 = nearest(x1, c1), nearest(x2, c2)
                r1, r2 = np.linalg.norm(x1 - c1[i1], axis=1), np.linalg.norm(x2 - c2[i2], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i1 * len(c2) + i2, pa.int32()), pa.array(r1), pa.array(r2)], names=["row", "vec_id", "v", "cell", "r1", "r2"])

        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
        self.rows = written(numbered.mapInArrow(assign, "row long, vec_id long, v array<double>, cell int, r1 double, r2 double"), "cells")
        counts = [0] * (len(c1) * len(c2))
        self.r1, self.r2 = np.zeros(len(counts)), np.zeros(len(counts))
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():  # at most MOST_CENTROIDS^2 rows
            counts[r["cell"]], self.r1[r["cell"]], self.r2[r["cell"]] = r["n"], r["r1"], r["r2"]
        self.counts = counts
        # Blocks: cells in order share a block up to BLOCK vectors; a larger cell has blocks of its own.
        self.start, self.parts, block, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
        for c, n in enumerate(counts):
            if n > BLOCK:
                self.start[c], self.parts[c], room = block + 1, math.ceil(n / BLOCK), 0
                block += int(self.parts[c])
            elif n:
                if n > room:
                    block, room = block + 1, BLOCK
                self.start[c], room = block, room - n

    def blocks_of(self, cells) -> list[int]:
        return sorted({b for c in cells for b in range(int(self.start[c]), int(self.start[c] + self.parts[c]))})

    def probes(self, queries: DataFrame, enough: int, first: int) -> DataFrame:
        """(asked, query_id, q, low, high, blocks): the sums of distance up to which either round goes, and the blocks that the first visits."""
        me = self.plain()

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x1, x2 = halves(matrix(b.column(2), me.dim), None)
                walks = [traverse(a, d, me.counts, first, enough) for a, d in zip(distances(x1, me.c1), distances(x2, me.c2), strict=True)]
                cols = [pa.array([w[0] for w in walks], pa.float64()), pa.array([w[1] for w in walks], pa.float64()), pa.array([me.blocks_of(w[2]) for w in walks], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["asked", "query_id", "q", "low", "high", "blocks"])

        return queries.mapInArrow(walk, "asked long, query_id long, q array<double>, low double, high double, blocks array<int>")

    def further(self, bounded: DataFrame) -> DataFrame:
        """The second round's blocks, of rows (asked, query_id, q, bound, low, high): those with cells whose sum of distances is over `low` and up to `high` and
        that can hold an inner product of `bound`."""
        me = self.plain()

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = np.array(me.counts) > 0
            r1, r2 = me.r1.reshape(len(me.c1), -1), me.r2.reshape(len(me.c1), -1)
            for b in batches:
                q1, q2 = halves(matrix(b.column(2), me.dim), None)
                d1, d2 = distances(q1, me.c1), distances(q2, me.c2)
                p1, p2 = q1 @ me.c1.T, q2 @ me.c2.T
                n1, n2 = np.linalg.norm(q1, axis=1), np.linalg.norm(q2, axis=1)
                bound, low, high = (np.asarray(b.column(i)) for i in (3, 4, 5))
                out = []
                for j in range(len(q1)):
                    sums, eps = d1[j][:, None] + d2[j], 1e-9 * (1 + abs(high[j]))
                    reach = p1[j][:, None] + p2[j] + n1[j] * r1 + n2[j] * r2
                    there = (sums > low[j] - eps) & (sums <= high[j] + eps) & (reach >= bound[j] - 1e-9 * (1 + np.abs(reach)))
                    out.append(me.blocks_of(np.flatnonzero(there.ravel() & full)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=["asked", "query_id", "q", "bound", "low", "high", "blocks"])

        return bounded.mapInArrow(more, "asked long, query_id long, q array<double>, bound double, low double, high double, blocks array<int>")

    def plain(self) -> "Index":
        """Without the table, for the executors."""
        out = object.__new__(Index)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k != "rows"})
        return out

    def visited(self, visits: DataFrame) -> np.ndarray:
        """In how many parts the queries of each block meet it: none for blocks that no query visits. One byte a block reaches the driver."""
        found = visits.groupBy("block").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("n")).toArrow()
        parts = np.zeros(int((self.start + self.parts).max()), np.int32)
        parts[found["block"].to_numpy()] = found["n"].to_numpy()
        return parts

    def dealt(self, parts: np.ndarray) -> DataFrame:
        """(row, vec_id, v, cell, block, part): the vectors of visited blocks, once for each part of a block's queries."""
        me = self.plain()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.asarray(b.column(3))
                # Equal rows share a block, so that a query meets all rows of its own id and vector in one.
                block = me.start[cell] + np.asarray(b.column(1)) % me.parts[cell]
                for part in range(int(parts[block].max(initial=0))):
                    some = b.filter(pa.array(parts[block] > part))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(block[parts[block] > part], pa.int32()), pa.array(np.full(some.num_rows, part), pa.int32())], names=["row", "vec_id", "v", "cell", "block", "part"])

        return self.rows.select("row", "vec_id", "v", "cell").mapInArrow(deal, "row long, vec_id long, v array<double>, cell int, block int, part int")

    def scan(self, visits: DataFrame, top: int) -> DataFrame:
        """The best of each block for each visit (asked, query_id, q, bound, low, high, block): at most `top` of the cells whose sum of distances is
        over `low` and up to `high`, none below the visit's bound. `visits` is read twice."""
        me, parts = self.plain(), self.visited(visits)
        left = self.dealt(parts)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                asked, block = np.asarray(b.column(0)).astype(np.uint64), np.asarray(b.column(6))
                mixed = asked * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((mixed % parts[block].astype(np.uint64)).astype(np.int32))], names=[*b.schema.names, "part"])

        right = visits.select("asked", "query_id", "q", "bound", "low", "high", "block").mapInArrow(part, "asked long, query_id long, q array<double>, bound double, low double, high double, block int, part int")

        def best(vecs: pa.Table, asks: pa.Table) -> pa.Table:
            out = [[], [], [], [], []]
            if vecs.num_rows and asks.num_rows:
                row, ids, x, cell = vecs["row"].to_numpy(), vecs["vec_id"].to_numpy(), matrix(vecs["v"].combine_chunks(), me.dim), vecs["cell"].to_numpy()
                q, qid, asked = matrix(asks["q"].combine_chunks(), me.dim), asks["query_id"].to_numpy(), asks["asked"].to_numpy()
                bound, low, high = (asks[n].to_numpy() for n in ("bound", "low", "high"))
                i1, i2 = cell // len(me.c2), cell % len(me.c2)
                for j in range(len(qid)):
                    if j % CHUNK == 0:
                        x1, x2 = halves(q[j : j + CHUNK], None)
                        d1, d2 = distances(x1, me.c1), distances(x2, me.c2)
                    sums = d1[j % CHUNK][i1] + d2[j % CHUNK][i2]
                    eps = 1e-9 * (1 + abs(high[j]))
                    there = np.flatnonzero((sums > low[j] - eps) & (sums <= high[j] + eps))
                    own = there[ids[there] == qid[j]]
                    own = own[(x[own] == q[j]).all(1)]
                    if len(own):
                        there = there[there != own[row[own].argmin()]]
                    rough = x[there] @ q[j]
                    slack = 1e-9 * (1 + float(np.abs(rough).max(initial=0)))
                    least = bound[j] - slack
                    if len(rough) > top:
                        least = max(least, np.partition(rough, len(rough) - top)[len(rough) - top] - slack)
                    at = there[rough >= least]
                    score = inner(x[at], q[j])
                    keep = np.lexsort((row[at], ids[at], -score))[:top]
                    keep = keep[score[keep] >= bound[j]]
                    for o, v in zip(out, (np.full(len(keep), asked[j]), np.full(len(keep), qid[j]), row[at[keep]], ids[at[keep]], score[keep]), strict=True):
                        o.append(v)
            cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            return pa.table({n: cat(o, pa.float64() if n == "score" else pa.int64()) for n, o in zip(("asked", "query_id", "row", "vec_id", "score"), out, strict=True)})

        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(best, FOUND)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, top: int = 20, key: str = "vec_id", vec: str = "embedding", share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` vectors of largest inner product with each query among the cells it visits, itself left out. `share` of all
    vectors is visited; None measures it."""
    index = Index(vectors, key, vec, top)
    asks = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("q")).where(F.col("query_id").isNotNull()).where(usable("q", index.dim))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    if not index.total:
        return asks.where("false").select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    asks = asks.select(F.monotonically_increasing_id().alias("asked"), "query_id", "q")
    enough = max(10 * top, math.ceil((index.share if share is None else share) * index.total))
    probes = written(index.probes(asks, enough, 10 * top), "probes")
    low = F.lit(float("-inf"))
    found = written(index.scan(probes.select("asked", "query_id", "q", low.alias("bound"), low.alias("low"), F.col("low").alias("high"), F.explode("blocks").alias("block")), top), "found")
    bound = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).groupBy("asked").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    bounded = probes.join(bound, "asked", "left").select("asked", "query_id", "q", F.when(F.col("n") >= top, F.col("s")).otherwise(low).alias("bound"), "low", "high")
    more = written(index.further(bounded).withColumn("block", F.explode("blocks")).drop("blocks"), "further")
    both = found.union(index.scan(more, top)).dropDuplicates(["asked", "row"])
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
