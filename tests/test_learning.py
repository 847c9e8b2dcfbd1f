"""Numbering, spread choices and candidate features against plain forms."""

import numpy as np
import pytest

from strandline.operators import candidates, stats


def test_numbering_by_ranges(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in "ab" for v in range(300)], "k string, v double").repartition(3)
    assert all(r["_before"] == r["v"] for r in stats.before(rows, ["k"], "v").collect())


def test_spread_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(b)) for s in range(20) for b in rng.choice(200, rng.integers(1, 15), replace=False)]
    got = {}
    for r in candidates.max_spread(spark.createDataFrame(rows, "seq_id long, boundary int"), 6).collect():
        got.setdefault(r["seq_id"], []).append(r["boundary"])
    for s in range(20):
        b = sorted(x for i, x in rows if i == s)
        sel = list(b) if len(b) <= 6 else [b[len(b) // 2]]
        while len(sel) < min(6, len(b)):
            sel.append(max((x for x in b if x not in sel), key=lambda x: (min(abs(x - y) for y in sel), -x)))
        assert sorted(got[s]) == sorted(sel)


def test_split_sources_and_features(spark):
    from strandline.operators import segmenters as S

    rng = np.random.default_rng(5)
    v = rng.standard_normal((40, 4))
    units = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "seq_id long, pos int, vec array<double>")
    t = spark.createDataFrame([(1, 4)], "seq_id long, t int")
    got = {(r["source"], r["boundary"]): r["score"] for r in candidates.split_sources(units, "m", t).collect()}
    want = {}
    for w in (1, 5, 9, 13):
        b = S.divisive(S.smooth(v, w), 31)
        want.update({(f"m_div_w{w}", x): 1 - i / len(b) for i, x in enumerate(sorted(b))})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    sizes = spark.createDataFrame([(1, 40)], "seq_id long, n int")
    rows = candidates.features(candidates.split_sources(units, "m", t), sizes, t, [f"m_div_w{w}" for w in (1, 5, 9, 13)], 1).orderBy("boundary").collect()
    places = [r["boundary"] for r in rows]
    for k, r in enumerate(rows):
        s = [want.get((f"m_div_w{w}", r["boundary"]), 0.0) for w in (1, 5, 9, 13)]
        near = min(abs(r["boundary"] - p) for i, p in enumerate(places) if i != k)
        assert r["mean_source"] == pytest.approx(np.mean([x for x in s if x > 0] or [0])) and r["source_std"] == pytest.approx(np.std(s)) and r["isolation"] == pytest.approx(near / 40)


def test_gap_sources_are_one_pass(spark):
    from pyspark.sql import functions as F

    from strandline.operators import gaps

    rng = np.random.default_rng(6)
    units = spark.createDataFrame([(s, i, rng.standard_normal(4).tolist()) for s, n in ((1, 90), (2, 60), (3, 1), (4, 2)) for i in range(n)], "seq_id long, pos int, vec array<double>")
    t = spark.createDataFrame([(1, 7), (2, 3), (3, 1), (4, 1)], "seq_id long, t int")
    got = candidates.gap_sources(units, "m", t)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # units and targets, each once
    rows = {(r["seq_id"], r["source"], r["boundary"]): r["score"] for r in got.collect()}
    want = {}
    for name, g in (("adj", gaps.gap_adjacent(units)), *((f"win{w}", gaps.gap_one_sided(units, w)) for w in candidates.GAP_WINDOWS)):
        for s, most in ((1, 56), (2, 50), (3, 50), (4, 50)):
            mine = [(r["score"], r["boundary"]) for r in g.where(F.col("seq_id") == s).withColumn("score", F.round("score", 6)).collect()]
            low, high = min(mine, default=(0.0, 0))[0], max(mine, default=(0.0, 0))[0]
            for x, b in sorted(mine, key=lambda z: (-z[0], z[1]))[:most]:
                want[s, f"m_{name}", b] = (x - low) / (high - low) if high > low else 0.0
    assert rows == want


def test_gradients_hold_blocks_of_rows_only():
    import tracemalloc

    from strandline.operators import learning

    rng = np.random.default_rng(9)
    n, folds, p = 10_000, 300, 6
    a, y, own = rng.standard_normal((n, p)), (rng.random(n) < 0.3).astype(float), rng.integers(-1, folds, n)
    u, k = rng.standard_normal((folds, p)) / 3, rng.random((folds, 2)) + 0.5
    tracemalloc.start()
    got = learning.gradient(a, y, own, u, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * folds / 4  # one matrix of all rows and folds takes 8 * n * folds
    r = (1 / (1 + np.exp(-a @ u.T)) - y[:, None]) * np.where((y == 1)[:, None], k[:, 1], k[:, 0])
    r[np.flatnonzero(own >= 0), own[own >= 0]] = 0.0
    assert np.allclose(got, r.T @ a)
    assert learning.vectors([np.arange(3.0), np.ones(3)], 3).to_pylist() == [[0, 1, 2], [1, 1, 1]] and len(learning.vectors([], 3)) == 0


def test_folds_make_their_rows_once(spark):
    from pyspark.sql import functions as F

    from strandline.operators import learning

    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = spark.range(60).select((F.col("id") % 12).alias("seq_id"), F.udf(counted, "double")((F.col("id") * 7 % 11).cast("double")).alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    got = learning.by_fold(rows, ["a"], "y", "logistic", 3).collect()
    assert len(got) == 60 and made.value == 60
