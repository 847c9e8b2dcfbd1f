"""Extremely randomised trees against a plain grower that makes one node after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import trees


def plain(x, y, asked, node, leaf):
    """The leaf mean that each row asked about reaches below a node."""
    n, best = len(y), None
    if n >= 2 * leaf and y.min() < y.max():
        for j in range(x.shape[1]):
            low, high = x[:, j].min(), x[:, j].max()
            cut = low + trees.uniform(trees.long_hash(node, j)) * (high - low)
            left = x[:, j] <= cut
            if low < high and leaf <= left.sum() <= n - leaf:
                gain = round(y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), 9)
                if best is None or gain > best[0]:
                    best = gain, j, cut
    if best is None:
        return np.full(len(asked), y.mean())
    _, j, cut = best
    out = np.zeros(len(asked))
    for side, go, ask in ((-1, x[:, j] <= cut, asked[:, j] <= cut), (-2, x[:, j] > cut, asked[:, j] > cut)):
        out[ask] = plain(x[go], y[go], asked[ask], trees.long_hash(node, side), leaf)
    return out


def data(seed, n=70, p=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.normal(size=(n, p - 2)), rng.integers(0, 3, n), np.full(n, 2.0)))
    return x, np.where(rng.random(n) < 0.2, 1.0, x[:, 0] + 0.3 * x[:, 2] + rng.normal(size=n) * 0.1)


def test_hash_is_sparks(spark):
    want = [tuple(r) for r in spark.range(-3, 5).select("id", F.xxhash64("id"), F.xxhash64(F.lit(17).cast("long"), "id")).collect()]
    assert [(i, int(trees.long_hash(i)), int(trees.long_hash(17, i))) for i, *_ in want] == want


@pytest.mark.parametrize("leaf", [1, 3])
def test_trees_grown_in_a_task_equal_plain_ones(leaf):
    x, y = data(1)
    train = np.arange(len(y)) % 4 > 0
    nodes = trees.long_hash(17, np.arange(5))
    got = trees.grown(x, y, train, nodes, leaf)[~train]
    want = np.mean([plain(x[train], y[train], x[~train], n, leaf) for n in nodes], 0)
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("local,held", [(20_000, 400_000), (20_000, 100), (12, 400_000), (0, 400_000)])
def test_all_ways_give_the_same_trees(spark, monkeypatch, local, held):
    monkeypatch.setattr(trees, "LOCAL", local)
    monkeypatch.setattr(trees, "HELD", held)
    rows, want = [], {}
    for fold in (0, 1):
        x, y = data(fold, 40)
        train = np.arange(len(y)) % 5 > 0
        rows += [(fold, i, bool(t), a.tolist(), float(b) if t else None) for i, (t, a, b) in enumerate(zip(train, x, y, strict=True))]
        mean = np.mean([plain(x[train], y[train], x[~train], n, 3) for n in trees.long_hash(17, np.arange(4))], 0)
        want.update({(fold, int(i)): m for i, m in zip(np.flatnonzero(~train), mean, strict=True)})
    frame = spark.createDataFrame(rows, "fold long, key long, train boolean, x array<double>, y double").repartition(5)
    got = {(r["fold"], r["key"]): r["predicted"] for r in trees.extra_trees(frame, 4, 4).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_folds_of_several_hundred_thousand_rows_are_grown_in_tasks(spark, monkeypatch):
    def never(*_):
        raise AssertionError("levels write all rows once for each tree")

    monkeypatch.setattr(trees, "stored", never)
    x = F.array(F.col("id") % 7 * 1.0, F.col("id") % 11 * 1.0)
    rows = spark.range(300_000).select(F.lit(1).alias("fold"), "id", (F.col("id") > 2).alias("train"), x.alias("x"), (F.col("id") % 7 * 2.0).alias("y")).withColumnRenamed("id", "key")
    assert {r["key"] for r in trees.extra_trees(rows, 2, 2, 60_000).collect()} == {0, 1, 2}


def test_folds_without_training_rows_and_empty_tables(spark):
    shape = "fold long, key long, train boolean, x array<double>, y double"
    frame = spark.createDataFrame([(1, 1, False, [1.0], None), (2, 1, True, [1.0], 4.0), (2, 2, False, [3.0], None)], shape)
    got = {r["fold"]: r["predicted"] for r in trees.extra_trees(frame, 1, 3).collect()}
    assert got[2] == 4.0 and (got[1] is None or got[1] != got[1])
    assert trees.extra_trees(frame.limit(0), 1, 3).count() == 0


@pytest.mark.parametrize("held,seed", [(400_000, 0), (150, 1), (400_000, 2)])
def test_trees_of_all_left_out_owners_equal_plain_ones(monkeypatch, held, seed):
    monkeypatch.setattr(trees, "HELD", held)
    rng = np.random.default_rng(seed)
    n, m = 14, 4
    u = np.column_stack((rng.normal(size=n), rng.integers(0, 3, n), np.full(n, 2.0)))
    asked = np.arange(n) % 5 > 0
    there = asked[:, None] | (rng.random((n, m)) < 0.6)  # owners that aren't asked about miss some kinds
    c = np.stack((rng.permuted(np.tile(np.arange(m), (n, 1)), axis=1) if seed else np.tile(np.arange(m), (n, 1)), rng.random(m) + 0.01 * rng.random((n, m))), -1)
    owner, kind = np.nonzero(there)
    y = np.where(rng.random(len(owner)) < 0.2, 1.0, u[owner, 0] + 0.2 * kind + 0.1 * rng.normal(size=len(owner)))
    roots = trees.long_hash(17, np.arange(6))
    got = trees.left_out(u, c, asked, owner, kind, y, roots, 3)
    for o in np.flatnonzero(asked):
        x, own = np.column_stack((u[owner], c[o, kind])), owner == o
        want = np.sum([plain(x[~own], y[~own], x[own], r, 3) for r in roots], 0)
        assert got[own] == pytest.approx(want, abs=1e-9)


def test_no_rows_are_written_for_each_tree_of_a_large_fold(spark, monkeypatch):
    monkeypatch.setattr(trees, "stored", lambda *_: pytest.fail("rows written"))
    x = F.array(F.rand(1), F.rand(2))
    frame = spark.range(25_000).select(F.lit(1).alias("fold"), F.col("id").alias("key"), (F.col("id") > 9).alias("train"), x.alias("x"), F.when(F.col("id") > 9, F.col("id") % 7).cast("double").alias("y"))
    assert trees.extra_trees(frame, 2, 2, leaf=5_000).count() == 10
