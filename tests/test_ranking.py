"""Classifiers without each sequence, peaks, and the table function against plain forms."""

import numpy as np
import pytest

from strandline.operators import folds, learning
from strandline.plans import registry, table_functions


def plain_logistic(x, y, asked, strength=0.35):
    """Newton's method on scaled features with balanced classes."""
    if len(set(y)) < 2:
        return np.full(len(asked), y.mean())
    mu, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    a, q = (np.column_stack((np.ones(len(z)), (z - mu) / scale)) for z in (x, asked))
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, penalty = np.zeros(a.shape[1]), np.concatenate(([0.0], np.ones(x.shape[1]))) / strength
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.clip(np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (c * (p - y)) + penalty * w), -1, 1)
    return 1 / (1 + np.exp(-q @ w))


@pytest.mark.parametrize("together", [1024, 3])
def test_classifiers_equal_plain_refits(spark, monkeypatch, together):
    monkeypatch.setattr(learning, "TOGETHER", together)
    rng = np.random.default_rng(together)
    f = np.repeat(np.arange(9), rng.integers(4, 25, 9))
    x = np.column_stack((rng.normal(size=(len(f), 3)) * [1, 20, 0.01] + [0, 300, 5], np.full(len(f), 7.0)))
    y = (rng.random(len(f)) < 1 / (1 + np.exp(1.5 - x[:, 0] - (x[:, 1] - 300) / 20))).astype(int)
    rows = [(int(k), i, *map(float, v), int(t), "u") for i, (k, v, t) in enumerate(zip(f, x, y, strict=True))]
    frame = spark.createDataFrame(rows, "seq_id long, boundary int, a double, b double, c double, d double, hit int, v string").repartition(4)
    got = {r["boundary"]: r["probability"] for r in learning.logistic_left_out(frame, ["a", "b", "c", "d"], "hit").collect()}
    for k in range(9):
        want = plain_logistic(x[f != k], y[f != k], x[f == k])
        assert [got[i] for i in np.flatnonzero(f == k)] == pytest.approx(want, abs=1e-6)


def test_classifiers_of_one_class_and_empty_tables(spark):
    shape = "seq_id long, a double, hit int"
    frame = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 1), (2, 0.1, 0), (2, None, 0), (None, 0.1, 1), (3, 0.2, None)], shape)
    got = {(r["seq_id"], r["a"]): r["probability"] for r in learning.logistic_left_out(frame, ["a"], "hit").collect()}
    assert got == {(1, 0.5): 0.0, (1, 0.7): 0.0, (2, 0.1): 1.0, (2, None): 1.0}
    assert learning.logistic_left_out(frame.limit(0), ["a"], "hit").count() == 0


def plain_peaks(s, distance):
    found, i = [], 1
    while i < len(s) - 1:
        if s[i - 1] < s[i]:
            j = i
            while j < len(s) - 1 and s[j + 1] == s[i]:
                j += 1
            if j < len(s) - 1 and s[j + 1] < s[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (s[p], p), reverse=True):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return [p for p in found if keep[p]]


@pytest.mark.parametrize("distance", [1, 3, 8])
def test_peaks(spark, distance):
    rng = np.random.default_rng(distance)
    rows = {s: rng.integers(0, 4, rng.integers(1, 60)).tolist() for s in range(12)}
    frame = spark.createDataFrame([(s, i + 1, float(v)) for s, x in rows.items() for i, v in enumerate(x)], "seq_id long, boundary int, score double").repartition(3)
    got = {s: [] for s in rows}
    for r in folds.peaks(frame, distance).collect():
        got[r["seq_id"]].append(r["boundary"] - 1)
    assert {s: sorted(b) for s, b in got.items()} == {s: plain_peaks(x, distance) for s, x in rows.items()}
    best = {s: sorted(sorted(plain_peaks(x, distance), key=lambda p: (x[p], p))[-2:]) for s, x in rows.items()}
    top = {s: [] for s in rows}
    for r in folds.peaks(frame, distance, 2).collect():
        top[r["seq_id"]].append(r["boundary"] - 1)
    assert {s: sorted(b) for s, b in top.items()} == best


def test_methods_from_sql(spark):
    rng = np.random.default_rng(4)
    v = {s: rng.normal(size=(20 + s, 6)) for s in range(5)}
    table_functions.register(spark, "cut")
    spark.createDataFrame([(s, i, x.tolist(), 3 + s) for s, m in v.items() for i, x in enumerate(m)], "seq_id long, pos int, vec array<double>, k int").repartition(4).createOrReplaceTempView("some_units")
    got = sorted(map(tuple, spark.sql("SELECT * FROM cut(TABLE(some_units) PARTITION BY (seq_id) ORDER BY (pos), 'divisive, dp', 4)").collect()))
    want = sorted((s, m, int(b)) for s, x in v.items() for m in ("divisive", "dp") for b in registry.run(registry.Input(x, x, 4), registry.parse(m)))
    assert got == want
    own = {s: sum(r["seq_id"] == s for r in spark.sql("SELECT * FROM cut(TABLE(some_units) PARTITION BY (seq_id) ORDER BY (pos), 'divisive')").collect()) for s in v}
    assert own == {s: 2 + s for s in v}
