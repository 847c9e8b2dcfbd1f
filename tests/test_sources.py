import json

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import text
from strandline.sources import readers, sinks


def test_manifest_and_skips(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id": "a", "title": "one"}\n\nnot json\n{"id": "a", "title": "two"}\n{"id": "b", "title": "x"}\n')
    rows = {r["id"]: r["title"] for r in readers.manifest(spark, str(p)).collect()}
    assert rows == {"a": "two", "b": "x"}
    ids = spark.createDataFrame([("a",), ("c",)], "seq_id string")
    assert [r[0] for r in readers.not_yet(ids, ids.where("seq_id = 'a'")).collect()] == ["c"]


def test_annotations_and_truth(spark, tmp_path):
    a = {"video_id": "v", "annotator": "x", "status": "draft", "chapters": [{"start_sec": 0, "title": "A"}, {"start_sec": 9, "title": "B"}], "subtopics": [{"start_sec": 4, "chapter_idx": 0, "title": "s"}]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=1))
    assert readers.annotations(spark, str(tmp_path / "a.json")).count() == 0
    assert readers.annotations(spark, str(tmp_path / "a.json"), drafts=True).count() == 3
    (tmp_path / "f.json").write_text(json.dumps({"video_id": "v", "boundaries_sec": [1.5, 2.0], "titles": ["x", "y"]}))
    assert [(r["start_sec"], r["title"]) for r in readers.flat_truth(spark, str(tmp_path / "f.json")).orderBy("ord").collect()] == [(1.5, "x"), (2.0, "y")]


def test_captions(spark, tmp_path):
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500\n<c>Hello</c>  world\n\n1:00:03.000 --> 1:00:04.000\nagain\n")
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n")
    assert [(r["start"], r["end"], r["text"]) for r in readers.captions(spark, str(tmp_path / "c.vtt")).orderBy("pos").collect()] == [(1.0, 2.5, "Hello world"), (3603.0, 3604.0, "again")]
    assert [r["text"] for r in readers.captions(spark, str(tmp_path / "c.srt")).collect()] == ["hi there"]
    body = json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 20, "segs": [{"utf8": "a "}, {"utf8": "\nb"}]}, {"tStartMs": 2000}]})
    got = spark.createDataFrame([(body, '<t><text start="1" dur="2">x  y</text></t>')], "j string, x string").select(readers.json3(F.col("j")).alias("j"), readers.xml_captions(F.col("x")).alias("x")).first()
    assert [tuple(c) for c in got["j"]] == [(1.5, 1.6, "a b")] and [tuple(c) for c in got["x"]] == [(1.0, 3.0, "x y")]


def test_embedded_json_and_tracks(spark):
    page = 'var x = {"a": "}{\\"", "b": {"c": 1}}; rest {'
    assert json.loads(readers.json_after(page, "var x =")) == {"a": '}{"', "b": {"c": 1}}
    assert readers.json_after("x {", "x") is None and readers.json_after(None, "x") is None
    df = spark.createDataFrame([(page,), (None,)], "h string").select(readers.embedded_json("var x =")("h").alias("j"))
    assert sorted(r["j"] is None for r in df.collect()) == [False, True]
    t = spark.createDataFrame([("v", "de", "", "1"), ("v", "en-GB", "asr", "2"), ("v", "en", "", "3")], "seq_id string, lang string, kind string, url string")
    assert readers.best_track(t).first()["url"] == "3"


def test_info_npy_results_choi(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "video.info.json").write_text(json.dumps({"duration": 100, "chapters": [{"start_time": 40, "title": "b"}, {"start_time": 0, "title": "a"}]}))
    r = readers.info_files(spark, str(tmp_path)).first()
    assert [c["title"] for c in r["chapters"]] == ["b"] and r["flags"] == ["few"]
    np.save(tmp_path / "e.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [x["vec"] for x in readers.npy_vectors(spark, str(tmp_path), "m").orderBy("pos").collect()][3] == [9.0, 10.0, 11.0]
    (tmp_path / "r.json").write_text(json.dumps({"results": {"m": {"v1": {"pk": 0.5, "bad": "n/a"}, "v2": {"error": "timeout"}}}}))
    assert [tuple(x) for x in readers.results(spark, str(tmp_path / "r.json")).collect()] == [("r", "m", "v1", "pk", 0.5)]
    doc = spark.createDataFrame([("d", "==========\na\nb\n==========\nc\n==========\nd\ne\n==========\n")], "seq_id string, text string")
    assert tuple(text.choi(doc).first()) == ("d", 5, [2, 3])


def test_sinks(spark, tmp_path):
    cube = spark.createDataFrame([("m", "v", "pk", 0.25), ("m", "w", "pk", 0.75)], "method string, seq_id string, metric string, value double")
    sinks.results_json(cube, str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert row["summary"]["pk"] == 0.5 and row["results"]["w"]["pk"] == 0.75
    table = spark.createDataFrame([("a_b", 0.5), ("c", 0.25)], "method string, pk double")
    assert "\\textbf{0.2500}" in sinks.latex_table(table, "method", {"pk": True}) and "a\\_b" in sinks.latex_table(table, "method", {"pk": True})
    assert "▲ 50.0%" in sinks.markdown_report(table, "method", "a_b", {"pk": True})
    chapters = spark.createDataFrame([("v", 3661.0, "B"), ("v", 5.0, "A")], "seq_id string, start double, title string")
    assert sinks.chapter_text(chapters).first()["text"] == "00:05 A\n01:01:01 B"
    b = spark.createDataFrame([(1, "m", 3), (1, "m", 1)], "seq_id int, method string, boundary int")
    sinks.predictions_json(b, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first()["boundaries"] == [1, 3]
    sinks.release(cube, b, cube, str(tmp_path / "rel"))
    assert spark.read.parquet(str(tmp_path / "rel/boundaries")).count() == 2


def test_trees_and_features_come_back(spark, tmp_path):
    levels = spark.createDataFrame([(1, 4, "chapter"), (1, 9, "subtopic"), (2, 3, "chapter")], "seq_id long, boundary int, level string")
    sinks.tree_json(levels, str(tmp_path / "t"))
    assert sorted(map(tuple, sinks.load_tree(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, levels.collect()))
    rows = spark.createDataFrame([(1, 0, "text", [1.0]), (1, 0, "shots", [2.0])], "seq_id long, pos int, modality string, vec array<double>")
    sinks.features_parquet(rows, str(tmp_path / "f"))
    assert sinks.load_features(spark, str(tmp_path / "f")).count() == 2
    assert [r["vec"] for r in sinks.load_features(spark, str(tmp_path / "f"), "shots").collect()] == [[2.0]]


def test_answers_and_shares(spark):
    a = 'Sure: {"subtopics": [{"start": "01:00", "title": " A "}, {"start": "x", "title": "B"}, {"start": "99:00", "title": "C"}, {"start": "02:30", "title": ""}]} done'
    df = spark.createDataFrame([(a,), ("none",), ('{"subtopics": [}',)], "a string").select(readers.subtopics_of(F.col("a"), F.lit(100.0), F.lit(1000.0)).alias("s"))
    assert [[tuple(x) for x in r["s"]] for r in df.collect()] == [[(100.0, "A"), (940.0, "C")], [], []]
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k int, x double").select("k", scalars.softmax(F.col("x"), ["k"]).alias("p")).collect()
    assert sorted(round(r["p"], 6) for r in rows) == [0.268941, 0.731059, 1.0]


def test_accumulation_until_a_sentence_ends(spark):
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b", "c d.", "e f", "g", "h?", "i"])], "seq_id long, pos int, text string")
    got = text.accumulate(units, 30, r"[.!?]").orderBy("piece").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 1), (2, 4), (5, 5)]
