"""Regressions without sequences, groups and pairs of sequences against plain refits."""

import numpy as np
import pytest

from strandline.operators import selectors, trees

COLUMNS = ["a", "b", "c"]


def score(mean, primary):
    pk, wd = mean[0], mean[1]
    return {"pk": (pk, wd), "wd": (wd, pk), "balanced": ((pk + wd) / 2, pk)}[primary]


def ranked(cube, videos, top, primary):
    means = {}
    for m in sorted({m for m, _ in cube}):
        rows = [cube[m, v] for v in videos if (m, v) in cube]
        if len(rows) >= max(3, round(0.8 * len(videos))):
            means[m] = np.mean(rows, 0)
    return sorted(means, key=lambda m: (*np.round(score(means[m], primary), 12), m))[:top]


def refit(cube, features, videos, methods, asked, primary):
    """Predictions for a sequence: features of the training rows are imputed, scaled and fitted anew."""
    mean = {m: np.mean(rows, 0) if (rows := [cube[m, v] for v in videos if (m, v) in cube]) else (1.0, 1.0, 0.0) for m in methods}
    row = lambda m, v: [*features[v], methods.index(m) / max(1, len(methods) - 1), *mean[m]]
    x = np.array([row(m, v) for m in methods for v in videos if (m, v) in cube], float)
    y = np.array([score(cube[m, v], primary)[0] for m in methods for v in videos if (m, v) in cube])
    x1 = np.array([row(m, asked) for m in methods], float)
    fill = np.nanmedian(x, axis=0)
    x, x1 = (np.where(np.isnan(z), fill, z) for z in (x, x1))
    mu, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    x, x1 = (x - mu) / scale, (x1 - mu) / scale
    w = np.linalg.solve(x.T @ x + 10.0 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return dict(zip(methods, x1 @ w + y.mean(), strict=True))


def made(n=24, methods=6, seed=1, gaps=0.08, missing=0.0):
    rng = np.random.default_rng(seed)
    features = {i: [float(i % 7), float(rng.normal()), 5.0] for i in range(n)}
    if missing:
        features = {i: [np.nan if rng.random() < missing else x for x in f[:2]] + f[2:] for i, f in features.items()}
    cube = {}
    for m in range(methods):
        for v in range(n):
            if rng.random() >= gaps or m == 0:
                pk = 0.4 + 0.03 * m * np.nan_to_num(features[v][1]) * (-1) ** m + rng.normal() * 0.05
                cube[f"m{m}", v] = (pk, pk + abs(rng.normal()) * 0.05, rng.random())
    return features, cube


def frames(spark, features, cube):
    f = spark.createDataFrame([(v, *(None if x != x else float(x) for x in xs), f"g{v % 4}") for v, xs in features.items()], "seq_id long, a double, b double, c double, g string")
    c = spark.createDataFrame([(v, m, *map(float, x), "extra") for (m, v), x in cube.items()], "seq_id long, method string, pk double, wd double, f1 double, u string")
    return f.repartition(3), c.repartition(4)


@pytest.mark.parametrize("primary,top,missing", [("pk", 80, 0.0), ("wd", 4, 0.0), ("balanced", 80, 0.2), ("pk", 4, 0.3)])
def test_each_sequence_left_out_equals_a_refit(spark, primary, top, missing):
    features, cube = made(missing=missing, seed=len(primary) + top)
    f, c = frames(spark, features, cube)
    got = {(r["seq_id"], r["method"]): r["predicted"] for r in selectors.predictions(f, COLUMNS, c, primary, top).collect()}
    want = {}
    for v in features:
        rest = [u for u in features if u != v]
        methods = [m for m in ranked(cube, rest, top, primary) if (m, v) in cube]
        want.update({(v, m): p for m, p in refit(cube, features, rest, methods, v, primary).items()})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_groups_left_out_equal_refits(spark):
    features, cube = made(seed=5)
    f, c = frames(spark, features, cube)
    got = {(r["seq_id"], r["method"]): r["predicted"] for r in selectors.predictions(f, COLUMNS, c, "balanced", 5, by="g").collect()}
    want = {}
    for v in features:
        rest = [u for u in features if u % 4 != v % 4]
        methods = [m for m in ranked(cube, rest, 5, "balanced") if (m, v) in cube]
        want.update({(v, m): p for m, p in refit(cube, features, rest, methods, v, "balanced").items()})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    best = {r["seq_id"]: r["method"] for r in selectors.chosen(selectors.predictions(f, COLUMNS, c, "balanced", 5, by="g")).collect()}
    assert best == {v: min((p, m) for (u, m), p in want.items() if u == v)[1] for v in features}


def test_rows_of_groups_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(selectors, "BLOCK", 4)
    features, cube = made(40, gaps=0.0)
    f, c = frames(spark, features, cube)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = selectors.training_rows(f, COLUMNS, c, by="g")._jdf.queryExecution()
        rows = run.toRdd().count()
        made_of, left = [], [run.executedPlan()]
        while left:
            node = left.pop()
            left += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Generate":
                made_of.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert rows == 4 * len(cube) and sum(made_of) == 10 * 4 * 6


def test_fits_make_no_product_of_three_arrays_in_a_plain_loop(monkeypatch):
    rng, plain = np.random.default_rng(3), np.einsum

    def einsum(how, *arrays, **options):
        assert len(arrays) < 3 or options.get("optimize"), how
        return plain(how, *arrays, **options)

    u, has, values = rng.normal(size=(9, 3)), np.ones((9, 4), bool), rng.random((9, 4, 3))
    y = values[..., 0]
    every = selectors.Moments(has.sum(0), has.T @ u, plain("nm,np,nq->mpq", has, u, u), y.T @ u, values.sum(0), 9)
    p = selectors.Problem(list("abcd"), list("xyz"), [], every, "pk", 80, 10.0)
    monkeypatch.setattr(selectors.np, "einsum", einsum)
    got, _ = selectors.fitted(p, every, u[:, None], has[:, None], values[:, None], u, has)
    assert np.isfinite(got).all()


@pytest.mark.parametrize("primary,top,block", [("pk", 80, 256), ("balanced", 3, 5)])
def test_guarded_choice_equals_nested_refits(spark, monkeypatch, primary, top, block):
    monkeypatch.setattr(selectors, "BLOCK", block)
    features, cube = made(14, 5, 3)
    baseline = "m0"
    margins = (-0.02, 0.0, 0.01, 0.03)
    f, c = frames(spark, features, cube)
    got = {r["seq_id"]: r for r in selectors.guarded(f, COLUMNS, c, baseline, primary, top, margins=margins).collect()}

    def asked(rest, v):
        methods = [m for m in ranked(cube, rest, top, primary) if (m, v) in cube]
        methods = methods if baseline in methods else [baseline, *methods]
        p = refit(cube, features, rest, methods, v, primary)
        best = min(p, key=p.get)
        return best, p[baseline] - p[best]

    for v in features:
        rest = [u for u in features if u != v]
        records = [(u, *asked([x for x in rest if x != u], u)) for u in rest]
        order = []
        for t in margins:
            mean = np.mean([cube[best if margin >= t else baseline, u] for u, best, margin in records], 0)
            one, two = score(mean, primary)
            order.append((round(one, 4), round(two, 4), sum(margin >= t for *_, margin in records)))
        threshold = margins[min(range(len(margins)), key=lambda i: order[i])]
        best, margin = asked(rest, v)
        r = got[v]
        assert (r["threshold"], r["best_method"]) == (threshold, best) and r["margin"] == pytest.approx(margin, abs=1e-8)
        assert r["method"] == (best if margin >= threshold else baseline) and r["switched"] == (r["method"] != baseline)
        assert r["inner_switch_rate"] == pytest.approx(np.mean([m >= threshold for *_, m in records]))


def test_empty_tables_and_bounds(spark, monkeypatch):
    f, c = frames(spark, *made(6, 3))
    assert selectors.predictions(f.limit(0), COLUMNS, c).count() == 0 and selectors.predictions(f, COLUMNS, c.limit(0)).count() == 0
    monkeypatch.setattr(selectors, "MOST_METHODS", 2)
    with pytest.raises(ValueError):
        selectors.predictions(f, COLUMNS, c)


@pytest.mark.parametrize("by,missing", [(None, 0.0), ("g", 0.0), (None, 0.2)])
def test_trees_without_each_sequence_or_group(spark, by, missing):
    features, cube = made(10, 4, 8, missing=missing)
    f, c = frames(spark, features, cube)
    got = {(r["seq_id"], r["method"]): r["predicted"] for r in selectors.tree_predictions(f, COLUMNS, c, "pk", 3, by=by, count=5).collect()}
    want = {}
    for v in features:
        rest = [u for u in features if (u % 4 != v % 4 if by else u != v)]
        methods = [m for m in ranked(cube, rest, 3, "pk") if (m, v) in cube]
        mean = {m: np.mean([cube[m, u] for u in rest if (m, u) in cube], 0) for m in methods}
        row = lambda m, u: [*features[u], methods.index(m) / max(1, len(methods) - 1), *mean[m]]  # noqa: B023, E731
        pairs = [(m, u) for m in methods for u in rest if (m, u) in cube]
        x, x1 = np.array([row(*p) for p in pairs], float), np.array([row(m, v) for m in methods], float)
        fill = np.nanmedian(x, axis=0)
        x, x1 = (np.where(np.isnan(z), fill, z) for z in (x, x1))
        shift = np.array([np.nanmean([z[i] for z in features.values()]) for i in range(3)] + [0.0] * 4)  # cuts don't depend on it but for the last digits
        nodes = trees.long_hash(17, np.arange(5))
        y = np.array([cube[p][0] for p in pairs])
        p = trees.grown(np.concatenate((x, x1)) - shift, np.concatenate((y, np.zeros(len(x1)))), np.arange(len(x) + len(x1)) < len(x), nodes, 3)[len(x) :]
        want.update({(v, m): z for m, z in zip(methods, p, strict=True)})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
