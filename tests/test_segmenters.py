import itertools

import numpy as np
import pytest

from strandline.operators import segmenters as S
from strandline.plans import registry


def planted(seed=7, topics=3, length=6, dim=48, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(topics):
        c = rng.standard_normal(dim)
        rows += [c / np.linalg.norm(c) + noise * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(length)]
    v = np.array(rows)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("f", [S.divisive, S.treeseg, S.dp])
def test_planted_change_points(f):
    assert f(planted(), 3) == [6, 12]


def naive_divisive(v, k):
    segments, out = [(0, len(v))], []
    while len(out) < k - 1:
        found = []
        for i, (a, e) in enumerate(segments):
            for s in range(a + 1, e):
                x, y = v[a:s].mean(0), v[s:e].mean(0)
                found.append((1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y)), -i, -s, a, e))
        if not found:
            break
        _, _, s, a, e = max(found)
        segments.remove((a, e))
        segments += [(a, -s), (-s, e)]
        out.append(-s)
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_divisive_against_brute_force(seed):
    v = np.random.default_rng(seed).standard_normal((12, 5))
    for k in (2, 4, 7):
        assert S.divisive(v, k) == naive_divisive(v, k)


@pytest.mark.parametrize("seed", range(5))
def test_dp_against_all_choices(seed):
    v = np.random.default_rng(seed).standard_normal((10, 4))
    value = lambda cuts: sum((v[a:e].sum(0) ** 2).sum() / (e - a) for a, e in itertools.pairwise([0, *cuts, 10]))
    assert value(S.dp(v, 4)) == pytest.approx(max(map(value, itertools.combinations(range(1, 10), 3))))


def test_constrained_lengths_and_small_inputs():
    v = np.random.default_rng(1).standard_normal((40, 6))
    b = S.divisive(v, 6, 5)
    assert min(np.diff([0, *b, 40])) >= 5 and S.divisive(v[:8], 3, 5) == []
    for n in range(1, 5):
        for f in (S.divisive, S.dp, S.treeseg, S.cosine_seg):
            assert all(0 < x < n for x in f(v[:n], 3))


def test_min_segment_filter():
    assert S.min_seg_filter([5, 10, 15], 20, 6) == []
    assert S.min_seg_filter([1, 10], 20, 5) == [10]
    assert S.min_seg_filter([10, 12], 30, 5, np.arange(30.0)) == [12]
    assert S.min_seg_filter([], 3, 5) == []


def test_text_segmenters():
    a, b = [["cat", "dog", "pet", "fur"]] * 12, [["star", "moon", "sky", "sun"]] * 12
    t = S.term_vectors(a + b)
    lowest = S.c99(S.cosines(t[:, None], t[None]), 2)
    assert len(lowest) == 1 and lowest != [12]  # the lowest density is asked for, and a true border has the highest
    assert S.texttiling(a + b, 8, 4) == [11]  # the sentence in which the block ends


def plain_c99(s, k, w=5):
    n = len(s)
    rank = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            x = s[max(0, i - w) : i + w + 1, max(0, j - w) : j + w + 1]
            rank[i, j] = (1 + (x < s[i, j]).sum()) / x.size
    p = np.zeros((n + 1, n + 1))
    p[1:, 1:] = rank.cumsum(0).cumsum(1)
    score = [p[b, b] / b**2 + (p[n, n] - p[b, n] - p[n, b] + p[b, b]) / (n - b) ** 2 for b in range(1, n)]
    return sorted(sorted(range(1, n), key=lambda b: (score[b - 1], b))[: k - 1])


@pytest.mark.parametrize("cells", [1, 500, 1 << 20])
def test_c99_in_tiles(cells):
    rng = np.random.default_rng(4)
    t = [[f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 12))] for _ in range(70)]
    v = S.term_vectors(t)
    assert S.c99_text(t, 9, cells) == plain_c99(S.cosines(v[:, None], v[None]), 9) == S.c99(S.cosines(v[:, None], v[None]), 9)


def sees_all_units(spark, monkeypatch, name):
    """A document of 900 units gives the boundaries of the method over all of them."""
    from strandline.plans import q_segment as Q

    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'abc'[i // 300]}{x}" for x in rng.integers(0, 30, 6)) for i in range(900)]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "seq_id long, pos int, text string")
    monkeypatch.setattr(Q.T, "text_units", lambda s, d: units)
    rows = Q.documents(spark, "").orderBy("pos").collect()
    v = np.array([r["vec1"] for r in rows], np.float64)
    want = registry.run(registry.Input(v, v, 10, None, [list(r["tokens"]) for r in rows]), registry.parse({"c99_lite": "c99", "texttiling": "texttiling", "document_divisive": "divisive_smooth9"}[name]))
    assert sorted(r["boundary"] for r in Q.QUERIES[name](spark, "").collect()) == sorted(want) != []


def test_c99_sees_all_units(spark, monkeypatch):
    sees_all_units(spark, monkeypatch, "c99_lite")


@pytest.mark.parametrize("name", ["texttiling", "document_divisive"])
def test_text_queries_see_all_units(spark, monkeypatch, name):
    sees_all_units(spark, monkeypatch, name)


def test_dp_candidates_keep_lengths():
    b = S.dp_candidates({3: 1.0, 10: 0.9, 11: 0.8, 20: 0.7, 28: 1.0}, 30, 2)
    assert len(b) == 2 and min(np.diff([0, *b, 30])) >= 5


def test_registry_reads_every_name():
    names = registry.names()
    assert len(names) == len(set(names)) > 230
    v = planted(topics=4, length=8)
    x = registry.Input(v[:, :24], v[:, 24:], 4, np.zeros(len(v)), [["a"]] * len(v))
    for n in names:
        assert all(0 < b < len(v) for b in registry.run(x, registry.parse(n))), n
    m = registry.parse("cross_e5_w11_frac70_minlen12")
    assert (m.family, m.window, m.frac, m.min_seg) == ("cross", 11, 0.7, 12)
    with pytest.raises(ValueError):
        registry.parse("unknown_method")


def test_document_divisive_reads_documents_once(spark, tmp_path):
    from strandline.operators import grouped
    from strandline.plans import q_segment as Q

    words = ["alpha beta gamma delta", "one two three four", "sun moon star sky"]
    rows = [(i, " ".join(f"{words[(i + j * j) % 3]} w{j % 5}." for j in range(n)), "en", "web", 0) for i, n in enumerate((1, 2, 30, 90))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["document_divisive"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    table = grouped.run_methods(Q.documents(spark, str(tmp_path)), Q.heuristics(spark, str(tmp_path)), ["divisive_smooth9"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect())) and got.count() > 0
    n = spark.range(1, 3000).selectExpr("id", "greatest(2, cast(bround(sqrt(id) / 3) AS int)) AS k").collect()
    assert all(Q.by_root(r["id"]) == r["k"] for r in n)


def test_document_divisive_makes_no_tokens(spark, monkeypatch):
    from strandline.plans import q_segment as Q

    units = spark.createDataFrame([(1, i, f"apple{i % 3} bread{i // 30} cake") for i in range(60)], "seq_id long, pos int, text string").repartition(3)
    monkeypatch.setattr(Q.T, "text_units", lambda s, d: units)
    pairs = lambda df: sorted((r["pos"], list(r["tokens"])) for r in df.collect())
    assert pairs(Q.documents(spark, "")) == pairs(Q.text.tokens(units))
    plan = Q.QUERIES["document_divisive"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and "first(" not in plan
