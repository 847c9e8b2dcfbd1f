from collections import Counter

import numpy as np

from strandline.llm import ann


def brute(ids, x, asks, top):
    out = {}
    for q in asks:
        score = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:top]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def run(spark, rows, top=20, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), top, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12000, 16)).astype(np.float32)
    x[3000:7000] = x[3]  # a third of all rows is one vector
    x[5] *= 3
    ids = np.arange(len(x))
    got = run(spark, [(int(i), v.tolist(), "s") for i, v in zip(ids, x)])
    asks = ids[::20][:60]
    want = brute(ids, x.astype(np.float64), asks, 20)
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in asks]
    assert np.mean(hits) / 20 >= 0.9 and all(len(got[q]) == 20 for q in asks)
    score = {(q, a): s for q in asks for a, s in got[q]}
    assert all(abs(s - float(x[q].astype(np.float64) @ x[a].astype(np.float64))) < 1e-9 for (q, a), s in score.items())
    tied = got[3000]
    same = [a for a, _ in tied if 3000 <= a < 7000 or a == 3]
    assert same == sorted(same)


def test_small_and_odd_tables_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 4)).astype(np.float32)
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)] + [(100, None, ""), (120, [0.0] * 4, ""), (140, [1.0, None, 0.0, 0.0], ""), (160, [float("nan"), 1.0, 1.0, 1.0], ""), (180, [float("inf"), 1.0, 1.0, 1.0], ""), (200, [1.0], ""), (None, [1.0] * 4, "")]
    got = run(spark, rows)
    want = brute(np.arange(50), x.astype(np.float64), [0, 20, 40], 20)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert run(spark, rows[:1]) == {}
    assert run(spark, [(100, None, "")]) == {}


def test_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((42, 4)).astype(np.float32)
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    rows += [rows[7], rows[20], rows[20], (20, x[3].tolist(), "")]  # equal rows, and an id with another vector
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = Counter(tuple(r)[:3] for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20, share=1.0).collect())
    want = Counter()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    for j in np.flatnonzero(ids % 20 == 0):
        score = (m * m[j]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != j][:20]
        want.update((int(ids[j]), k, int(ids[i])) for k, i in enumerate(order, 1))
    assert got == want


def test_clustered_vectors_visit_few(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((200, 32)) * 3
    x = centres[rng.integers(0, 200, 8000)] + rng.standard_normal((8000, 32)) * 0.3
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(vectors, "vec_id", "embedding")
    assert index.share < 0.1
    got = {}
    for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 200 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(8000), x, np.arange(0, 8000, 200), 20)
    assert np.mean([len(got[q] & {a for a, _ in v}) / 20 for q, v in want.items()]) >= 0.9


def test_vectors_are_sent_once_and_only_where_asked(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((30, 16)) * 4)[rng.integers(0, 30, 4000)] + rng.standard_normal((4000, 16)) * 0.2
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(ann, "BLOCK", 64)
    index = ann.Index(vectors, "vec_id", "embedding")
    blocks = int((index.start + index.parts).max())
    visits = spark.createDataFrame([(a, a % 3) for a in range(900)], "asked long, block int")  # of three blocks, 300 queries each
    of = lambda asks: monkeypatch.setattr(ann, "ASKS", asks) or index.dealt(index.visited(visits)).groupBy("block").count().collect()
    one, many = {r["block"]: r["count"] for r in of(1000)}, {r["block"]: r["count"] for r in of(100)}
    assert blocks > 20 and one.keys() == {0, 1, 2} and many == {b: 3 * n for b, n in one.items()}
    results = []
    for asks in (1 << 14, 7):
        monkeypatch.setattr(ann, "ASKS", asks)
        results.append(sorted(map(tuple, ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect())))
    assert results[0] == results[1] and len(results[0]) == 200 * 20
