"""Small hand-made cases and properties of the metrics and folds."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import folds, fusion, metrics, portfolio, stats
from strandline.operators import segmenters as S
from strandline.streaming import sessions


def rows(spark, lists):
    return spark.createDataFrame([(s, b) for s, bs in lists.items() for b in bs], "seq_id long, boundary int")


def sizes(spark, ns):
    return spark.createDataFrame(list(ns.items()), "seq_id long, n int")


def test_identity_and_empty_sides(spark):
    h = rows(spark, {1: [10, 20, 30], 3: [1, 99]})
    r = rows(spark, {1: [10, 20, 30], 2: [10, 20]})
    z = sizes(spark, {1: 40, 2: 30, 3: 20, 4: 0 + 5})
    got = {x["seq_id"]: x for x in metrics.evaluate(h, r, z).collect()}
    assert (got[1]["pk"], got[1]["wd"], got[1]["bs"], got[1]["f1_t2"]) == (0, 0, 1, 1)
    assert got[2]["pk"] > 0 and got[2]["wd"] > 0 and got[2]["f1_t2"] == got[2]["recall_t2"] == 0
    assert got[4]["bs"] == got[4]["f1_t2"] == 1 and got[4]["pk"] == 0


def naive_pk_wd(h, r, n):
    k = max(1, round(n / (len(r) + 1) / 2))
    pk = wd = 0
    for i in range(n - k):
        a, b = (sum(i < x <= i + k for x in s) for s in (h, r))
        pk += (a > 0) != (b > 0)
        wd += a != b
    return (pk / (n - k), wd / (n - k)) if n > k else (0, 0)


def test_random_cases_against_slices(spark):
    rng = random.Random(3)
    cases = {i: (sorted(rng.sample(range(1, n), rng.randint(0, min(6, n - 1)))), sorted(rng.sample(range(1, n), rng.randint(0, min(6, n - 1)))), n) for i in range(40) for n in [rng.randint(2, 40)]}
    h, r, z = rows(spark, {i: c[0] for i, c in cases.items()}), rows(spark, {i: c[1] for i, c in cases.items()}), sizes(spark, {i: c[2] for i, c in cases.items()})
    for x in metrics.pk_wd(h, r, z).collect():
        assert (x["pk"], x["wd"]) == pytest.approx(naive_pk_wd(*cases[x["seq_id"]]))


def test_tolerance_and_taxonomy(spark):
    z = sizes(spark, {1: 30, 2: 30})
    h, r = rows(spark, {1: [11], 2: [15]}), rows(spark, {1: [10], 2: [10]})
    assert {x["seq_id"]: x["f1"] for x in metrics.tolerance_f1(h, r, z).collect()} == {1: 1.0, 2: 0.0}
    got = {x["seq_id"]: (x["tp"], x["near"], x["fp"], x["fn"]) for x in metrics.error_taxonomy(h, r, z).collect()}
    assert got == {1: (1, 1, 0, 0), 2: (0, 0, 1, 1)}


def test_folds_match_the_plain_filter(spark):
    rng = random.Random(5)
    cases = {i: sorted(rng.sample(range(1, 60), rng.randint(1, 14))) for i in range(25)}
    z = sizes(spark, dict.fromkeys(cases, 60))
    got = {}
    for x in folds.min_segment_filter(rows(spark, cases), z, 6).collect():
        got.setdefault(x["seq_id"], []).append(x["boundary"])
    for i, b in cases.items():
        assert sorted(got.get(i, [])) == S.min_seg_filter(b, 60, 6)
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 12, 0.3)], "seq_id long, boundary int, score double")
    assert [x["boundary"] for x in folds.nms(scored, 5).collect()] == [10]


def test_fusion_rejects_unequal_signals(spark):
    bad = spark.createDataFrame([(1, 1, "a", 0.1), (1, 2, "a", 0.5), (1, 1, "b", 0.2)], "seq_id long, boundary int, signal string, score double")
    with pytest.raises(Exception, match="different length"):
        fusion.fuse(bad).collect()


def test_wilcoxon_edges(spark):
    pairs = spark.createDataFrame([("same", 0.5, 0.5)] * 5 + [("far", 0.1, 0.9 + i / 1000) for i in range(10)], "g string, a double, b double")
    got = {x["g"]: x["p"] for x in stats.wilcoxon(pairs, ["g"]).collect()}
    assert got["same"] == 1.0 and got["far"] < 0.05


def test_leave_one_out_skips_the_own_sequence(spark):
    cube = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.9), ("a", 3, 0.9), ("b", 1, 0.5), ("b", 2, 0.5), ("b", 3, 0.5)], "method string, seq_id long, pk double").withColumns({"wd": F.col("pk"), "f1": F.col("pk"), "error": F.lit(None).cast("string")})
    assert {x["seq_id"]: x["method"] for x in portfolio.leave_one_out(cube).collect()} == {1: "b", 2: "a", 3: "a"}


def test_sessions_stream_like_a_batch(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 09:00:00", 3.0)], "user_id long, t string, value double").select("user_id", F.col("t").cast("timestamp").alias("ts"), "value")
    batch = sorted((x["n"], x["value"]) for x in sessions.sessions(e).collect())
    e.write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found_sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert batch == [(1, 3.0), (2, 3.0)] and spark.table("found_sessions").count() <= 2


def test_relaxed_metrics_make_boundaries_once(spark):
    from pyspark.sql import functions as F

    from strandline.operators import metrics

    hyp = spark.range(1, 21).select((F.col("id") % 2).alias("seq_id"), (F.col("id") * F.lit(2222) / 1111).cast("int").alias("boundary"))
    ref = spark.range(1, 9).select((F.col("id") % 2).alias("seq_id"), (F.col("id") * 5).cast("int").alias("boundary"))
    sizes = spark.createDataFrame([(0, 50, 500.0), (1, 50, 500.0), (2, 50, 500.0)], "seq_id long, n int, duration double")
    starts = sizes.select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("pos")).withColumn("start", F.col("pos") * 10.0)
    rows = metrics.relaxed(hyp, ref, sizes, starts)
    assert "2222" not in rows._jdf.queryExecution().optimizedPlan().toString()  # what makes the boundaries is no part of the metrics' plan
    got = rows.collect()
    assert {(r["seq_id"], r["n_predicted"], r["n_reference"]) for r in got} == {(0, 10, 4), (1, 10, 4), (2, 0, 0)}
