"""Split maps, grids and weights over them, and methods as plans, against plain forms."""

import re
from itertools import product

import numpy as np
import pytest

from strandline.operators import grouped, maps, search
from strandline.operators import segmenters as S
from strandline.plans import combinations, registry


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    v = {s: (rng.normal(size=(n, 5)).cumsum(0), rng.normal(size=(n, 5))) for s, n in enumerate((33, 21, 40, 17, 2))}
    v = {s: (S.unit_rows(a), S.unit_rows(b)) for s, (a, b) in v.items()}
    units = spark.createDataFrame([(s, i, a[i].tolist(), b[i].tolist()) for s, (a, b) in v.items() for i in range(len(a))], "seq_id long, pos int, vec1 array<double>, vec2 array<double>").repartition(3)
    k = {0: 6, 1: 4, 2: 9, 3: 2, 4: 2}
    sizes = spark.createDataFrame([(s, len(a)) for s, (a, _) in v.items()], "seq_id long, n int")
    return v, k, units, sizes, spark.createDataFrame(list(k.items()), "seq_id long, k int")


def test_maps_are_the_splits(tables):
    v, k, units, sizes, wanted = tables
    most = sizes.selectExpr("seq_id", "least(n - 1, 7) AS m")
    got = {}
    for r in maps.split_maps(units, most, [1, 5]).collect():
        got.setdefault((r["seq_id"], r["model"], r["window"]), {})[r["rank"]] = r["boundary"], r["gain"]
    for s, both in v.items():
        for (i, x), w in product(enumerate(both, 1), (1, 5)):
            order, gains = S.divisive_order(S.smooth(x, w), min(len(x) - 1, 7) + 1)
            assert got.get((s, i, w), {}) == dict(enumerate(zip(order, gains, strict=True), 1))


def norm(x):
    return np.round((x - x.min()) / (x.max() - x.min()), 9) if len(x) and x.max() > x.min() else np.zeros(len(x))


@pytest.mark.parametrize("only", [False, True])
def test_every_point_of_the_grid_equals_a_separate_run(spark, tables, only):
    v, k, units, sizes, wanted = tables
    rng = np.random.default_rng(1)
    signals = {name: {s: rng.integers(0, 5, len(a) - 1) / 4 for s, (a, _) in v.items() if s != 1} for name in ("ocr", "shot")}
    frames = {name: spark.createDataFrame([(s, i + 1, float(x)) for s, xs in rows.items() for i, x in enumerate(xs)], "seq_id long, boundary int, score double") for name, rows in signals.items()}
    grid = {"windows": [3, 5], "shares": [0.65, 1.0], "overs": [2, 4], "weights": {"ocr": [0.0, 0.3], "shot": [0.1]}, "lengths": [1, 3], "suppressions": [1, 4]}
    most = sizes.join(wanted, "seq_id").selectExpr("seq_id", "least(n - 1, 4 * k + 2) AS m")
    table = maps.split_maps(units, most, grid["windows"])
    got = {}
    for r in maps.fusion_grid(table, sizes, wanted, frames, **grid, only_candidates=only).collect():
        got.setdefault((r["seq_id"], r["method"]), []).append(r["boundary"])
    points = 0
    for s, both in v.items():
        n = len(both[0])
        for w, f, o, a, c, least, near in product(grid["windows"], grid["shares"], grid["overs"], grid["weights"]["ocr"], grid["weights"]["shot"], grid["lengths"], grid["suppressions"]):
            ask = min(n - 1, max(2, round(k[s] * f)) * o + 2)
            pair = [dict(zip(*S.divisive_order(S.smooth(x, w), ask), strict=True)) for x in both]
            top = [max(m.values(), default=1.0) or 1.0 for m in pair]
            base = norm(np.array([sum(m.get(b, 0.0) / t for m, t in zip(pair, top, strict=True)) / 2 for b in range(1, n)]))
            none = np.zeros(n - 1)
            total = norm(base + a * norm(signals["ocr"].get(s, none)) + c * norm(signals["shot"].get(s, none)))
            if only:
                total = np.where([b in pair[0] or b in pair[1] for b in range(1, n)], total, 0.0)
            chosen = []
            for b in sorted(range(1, n), key=lambda b: (-total[b - 1], b)):
                pts = [0, *sorted([*chosen, b]), n]
                if all(abs(b - x) >= near for x in chosen) and min(np.diff(pts)) >= least and len(chosen) < max(1, round(k[s] * f)):
                    chosen.append(b)
            name = f"mm_w{w}_frac{int(f * 100)}_over{o}_ocr{int(a * 100)}_shot{int(c * 100)}_min{least}_nms{near}"
            assert sorted(got.get((s, name), [])) == sorted(chosen), (s, name)
            points += 1
    assert points == 5 * 64 and {m for _, m in got} <= {m for _, m in got} and len({m for _, m in got}) == 64


def test_weights_together_equal_one_by_one():
    rng = np.random.default_rng(2)
    points = search.weight_points(30)
    assert len(points) == 3 * 48 + 30 and all(abs(sum(p[1]) - 1) < 1e-6 for p in points[144:])
    for n in (2, 12, 60):
        b = np.sort(rng.choice(np.arange(1, n), max(1, n // 2), replace=False))
        x = rng.integers(0, 4, (len(b), 10)).astype(float)
        got = {}
        for p, c in search.chosen_by_weights(b, x, n, 5, points):
            got.setdefault(p, []).append(c)
        z = np.column_stack([norm(c) if c.max() > c.min() else np.zeros(len(c)) for c in x.T])
        z = np.column_stack([(c - c.min()) / (c.max() - c.min()) if c.max() > c.min() else np.zeros(len(c)) for c in x.T])
        for p, w, f, least, near in points:
            s = np.round(z @ np.array(w), 9)
            chosen = []
            for i in sorted(range(len(b)), key=lambda i: (-s[i], b[i])):
                pts = np.diff([0, *sorted([*chosen, b[i]]), n])
                if len(chosen) < max(1, round(5 * f)) and all(abs(b[i] - c) > near for c in chosen) and pts.min() >= least:
                    chosen.append(int(b[i]))
            assert got.get(p, []) == sorted(chosen)


def test_methods_as_plans_equal_the_segmenters(tables):
    v, k, units, sizes, wanted = tables
    names = ["divisive", "divisive_smooth5", "divisive_conservative", "divisive_smooth9_frac70", "cross_e5_frac70", "cross_e5_w11_frac80", "cross_e5_thresh60", "cross_e5_adaptive_k", "cross_e5_nms8", "cross_e5_frac70_minlen5", "cross_e5_frac65_minlen10", "cross_rank_e5large", "weighted_cross_w40", "triple_model", "triple_frac70_minlen10", "multi_res_cross_e5", "cosine", "bert_seg", "cosine_drop", "cross_e5_combined_depth", "dp", "cross_e5_score_minlen10"]
    built = [n for n in names if combinations.spec(n)]
    assert len(built) == 17 and combinations.spec("iterative_cross_e5") is None
    rows = lambda f: sorted((r["seq_id"], r["method"], r["boundary"]) for r in f(units, wanted, names).collect())
    got, want = rows(combinations.run_methods), rows(grouped.run_methods)
    for name in names:
        assert [r for r in got if r[1] == name] == [r for r in want if r[1] == name], name
    assert all(registry.parse(n) for n in names)


def test_scaled_arrays_are_computed_once(spark):
    from pyspark.sql import functions as F

    made = F.transform("a", lambda x: x * 2)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(n).tolist()) for i, n in enumerate((1, 2, 50))] + [(3, []), (4, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>").select("i", maps.scaled(made).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("* 2") == 1  # the array is made in one place, not for each element
    for i, s in df.collect():
        a = np.array(rows[i][1])
        assert np.allclose(s, np.round((a - a.min()) / np.ptp(a), 9) if len(a) and np.ptp(a) else np.zeros(len(a)), atol=1e-9)


def test_combined_maps_are_dealt_out_by_their_rows_after_the_specs(spark, monkeypatch):
    rows = [(s, m, 9, 1 + (7 * b + s * m) % 19, b, 1.0 / (b + m)) for s in range(12) for m in (1, 2) for b in range(1, 13)]
    table = spark.createDataFrame(rows, "seq_id long, model int, window int, boundary int, rank int, gain double")
    sizes, wanted = (spark.createDataFrame([(s, v) for s in range(12)], f"seq_id long, {c} int") for c, v in (("n", 20), ("k", 4)))
    specs = [{"name": f"m{i}", "how": "mean", "windows": [9], "share": 0.5 + i / 10} for i in range(5)] + [{"name": "near", "how": "mean", "windows": [9], "near": 3}]
    want = sorted(map(tuple, maps.combined(table, sizes, wanted, specs).collect()))
    monkeypatch.setattr(maps, "COMBINED", 200, raising=False)
    got = maps.combined(table, sizes, wanted, specs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # 288 rows meet five specs without suppression, which makes 8 parts, and one with, which makes 2.
    assert "(seq_id#" in plan and {int(p) for p in re.findall(r"hashpartitioning\(seq_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)} == {8, 2}
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_grid_query_joins_nothing_that_it_explodes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from strandline.operators import metrics
    from strandline.plans import q_ranking as Q
    from strandline.sources import tables as T

    monkeypatch.setattr(Q, "GRID", {"windows": [3, 5], "shares": [0.65], "overs": [2], "weights": {"ocr": [0.0, 0.3], "pros": [0.1], "shot": [0.1]}, "lengths": [3], "suppressions": [1, 5]})
    monkeypatch.setattr(maps, "GAPS", 400, raising=False)
    rng, d = np.random.default_rng(3), str(tmp_path)
    # Three sequences of 50, the second without a reference (it is asked for two segments at least, so its maps too), and one of a single vector.
    rows = [(i, rng.normal(size=64).tolist(), 5 if 50 <= i < 100 else i % 9) for i in range(151)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    got = Q.QUERIES["fusion_grid"](spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The one join gives vectors their sequence's number of splits. Sequences times points are never a side, as their broadcast outgrows the driver.
    assert len(re.findall(r"\bJoin ", plan)) == 1
    # 151 vectors by 8 points, in parts of 400.
    assert re.findall(r"hashpartitioning\(seq_id#\d+L, window#\d+, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString()) == ["4"]
    u = T.vectors(spark, d)
    z, k = T.sizes(u), Q.q_segment.wanted(spark, d)
    table = maps.split_maps(T.two_models(spark, d), z.selectExpr("seq_id", "n - 1 AS m"), [3, 5])
    signal = lambda a, b: Q.Q.signal(spark, d, ((F.col("pos") * a) % b) / float(b))
    hyp = maps.fusion_grid(table, z, k, {"ocr": signal(31, 17), "pros": signal(37, 11), "shot": signal(53, 7)}, **Q.GRID).cache()
    want = {}
    for name in sorted({r["method"] for r in hyp.select("method").distinct().collect()}):
        m = metrics.pk_wd(hyp.where(F.col("method") == name), T.references(u), z).agg(F.count("*"), F.avg("pk"), F.avg("wd")).first()
        want[name] = (m[0], round(m[1], 6), round(m[2], 6))
    assert {r["method"]: (r["n"], r["pk"], r["wd"]) for r in got.collect()} == want and len(want) == 8 and all(n == 4 for n, *_ in want.values())


def test_metrics_of_windows_counted_once_equal_those_of_each_pair(spark):
    from pyspark.sql import functions as F

    from strandline.operators import metrics

    rng = np.random.default_rng(12)
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate((1, 2, 3, 10, 33, 33))], "seq_id long, n int").cache()
    some = lambda skip: {r["seq_id"]: sorted(rng.choice(np.arange(1, r["n"]), min(r["n"] - 1, 6), replace=False).tolist()) if r["seq_id"] != skip else [] for r in sizes.collect()}
    hyp, ref = some(4), some(5)
    flat = lambda x: spark.createDataFrame([(s, b) for s, bs in x.items() for b in bs], "seq_id long, boundary int")
    rows = metrics.expected(flat(ref), sizes).join(spark.createDataFrame(list(hyp.items()), "seq_id long, kept array<int>"), "seq_id")
    got = rows.select("seq_id", metrics.missed(F.col("kept"), F.col("width"), F.col("met")).alias("m")).select("seq_id", "m.pk", "m.wd")
    want = metrics.pk_wd(flat(hyp), flat(ref), sizes).select("seq_id", "pk", "wd")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
