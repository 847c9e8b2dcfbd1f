import pytest

from strandline.operators import search


def test_grid_and_weights(spark):
    assert search.grid(spark, k=[1, 2], w=[0.5, 0.7]).count() == 4
    rows = search.random_weights(spark, ["a", "b"], 5).collect()
    assert all(abs(r["a"] + r["b"] - 1) < 1e-12 for r in rows)
    with pytest.raises(ValueError):
        search.grid(spark, a=list(range(200)), b=list(range(200)))


def test_search_finds_the_right_k(spark):
    scores = spark.createDataFrame([(s, b, 1.0 if b in (5, 10) else 0.1 / b) for s in (1, 2) for b in range(1, 15)], "seq_id long, boundary int, score double")
    refs = spark.createDataFrame([(s, b) for s in (1, 2) for b in (5, 10)], "seq_id long, boundary int")
    sizes = spark.createDataFrame([(1, 15), (2, 15)], "seq_id long, n int")
    got = {r["k"]: r["wd"] for r in search.search_top_k(scores, refs, sizes, search.grid(spark, k=[1, 2, 4])).collect()}
    assert min(got, key=got.get) == 2 and got[2] == 0
    recall = search.candidate_recall(scores.where("boundary = 6"), refs, 1).collect()
    assert all(r["recall"] == 0.5 for r in recall)


def test_votes(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 0.0, 0.0, 0.0, 0.0), (1, 2, 1.0, 1.0, 0.0, 0.0, 0.0)], "seq_id long, boundary int, a double, b double, c double, d double, e double")
    got = {r["boundary"]: r["score"] for r in search.vote_score(rows).collect()}
    assert got == {1: pytest.approx(0.45), 2: pytest.approx(0.525)}
