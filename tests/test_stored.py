import os

from strandline.sources import stored


def test_hit_miss_changed_version_and_dead_writer(spark, tmp_path):
    source, folder = str(tmp_path / "in.parquet"), str(tmp_path / "kept")
    spark.range(3).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id", "id * 2 AS twice")

    get = lambda **p: sorted(map(tuple, stored.cached(spark, folder, "examples", p, [source], build).collect()))
    assert get(window=3) == [(0, 0), (1, 2), (2, 4)] and len(built) == 1
    assert get(window=3) == [(0, 0), (1, 2), (2, 4)] and len(built) == 1  # a hit
    get(window=5)
    assert len(built) == 2  # other parameters
    spark.range(5).write.mode("overwrite").parquet(source)
    assert len(get(window=3)) == 5 and len(built) == 3  # other input
    version = stored.version(spark, {"window": 3}, [source])
    os.remove(f"{folder}/examples/{version}/_SUCCESS")  # as of a writer that died
    os.makedirs(f"{folder}/examples/_staged-dead")
    assert len(get(window=3)) == 5 and len(built) == 4
    assert stored.forgotten(spark, folder, "examples", keep=version) == 3
    assert sorted(os.listdir(f"{folder}/examples")) == [version] and len(get(window=3)) == 5 and len(built) == 4
    assert stored.forgotten(spark, folder, "nothing") == 0


def test_stored_tables_can_be_dropped(spark):
    t = stored.stored(spark.range(4), "numbers")
    assert t.count() == 4
    stored.dropped(t)
    assert not os.path.exists(t.stored_at.removeprefix("file://"))
