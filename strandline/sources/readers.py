"""Readers of the formats that transcripts, captions, annotations and results come in. All give DataFrames with explicit schemas; none needs a driver loop."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "id string, url string, domain string, title string, duration_sec double, path string, num_chapters int, downloaded_at string"
TRANSCRIPT = "video_id string, language string, duration_sec double, segments array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>"
SENTENCES = "video_id string, sentences array<struct<idx:int,start:double,end:double,text:string>>"
FLAT = "video_id string, boundaries_sec array<double>, titles array<string>, num_chapters int, duration_sec double"
ANNOTATION = "video_id string, annotator string, status string, double_mode boolean, chapters array<struct<start_sec:double,title:string>>, subtopics array<struct<start_sec:double,chapter_idx:int,title:string>>"
PREDICTION = "video_id string, n_sentences int, model string, n_chapters int, n_subtopics int, chapters array<int>, subtopics array<int>, titles array<string>"
JSON3 = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs array<struct<utf8:string>>>>".replace("segs array", "segs:array")
CUBE = "map<string,map<string,map<string,string>>>"


def manifest(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """A JSONL manifest, one row for each id; of repeated ids the last line stands. Bad lines are dropped, or fail without `tolerant`."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path).where("id is not null")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "_at")]), "_at").alias("r")).select("id", "r.*")


def annotations(spark: SparkSession, path: str, statuses: tuple[str, ...] = ("reviewed", "done"), drafts: bool = False) -> DataFrame:
    """(seq_id, annotator, level, ord, start_sec, title) of hierarchical annotations of the wanted statuses."""
    rows = spark.read.schema(ANNOTATION).json(path, multiLine=True).where(F.col("status").isin(*statuses, *(("draft",) if drafts else ())))
    one = lambda level, c: rows.select(F.col("video_id").alias("seq_id"), "annotator", F.lit(level).alias("level"), F.posexplode(c).alias("ord", "x")).select("seq_id", "annotator", "level", "ord", "x.start_sec", "x.title")
    return one("chapter", "chapters").union(one("subtopic", "subtopics"))


def flat_truth(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, ord, start_sec, title) of flat ground truth: starts zipped with titles."""
    rows = spark.read.schema(FLAT).json(path, multiLine=True)
    return rows.select(F.col("video_id").alias("seq_id"), F.posexplode(F.arrays_zip("boundaries_sec", "titles")).alias("ord", "x")).select("seq_id", "ord", F.col("x.boundaries_sec").alias("start_sec"), F.col("x.titles").alias("title"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SENTENCES).json(path, multiLine=True)
    return rows.select(F.col("video_id").alias("seq_id"), F.posexplode("sentences").alias("pos", "x")).select("seq_id", "pos", "x.start", "x.end", "x.text")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seg, start, end, text, words)."""
    rows = spark.read.schema(TRANSCRIPT).json(path, multiLine=True)
    return rows.select(F.col("video_id").alias("seq_id"), F.posexplode("segments").alias("seg", "x")).select("seq_id", "seg", "x.*")


def health(ids: DataFrame, transcripts: DataFrame, least_seconds: float = 60.0) -> DataFrame:
    """(seq_id, health): missing, empty, short or ok, for each wanted id."""
    t = transcripts.groupBy("seq_id").agg(F.max("end").alias("e"), F.sum(F.length(F.trim("text"))).alias("c"))
    return ids.join(t, "seq_id", "left").select("seq_id", F.when(F.col("e").isNull(), "missing").when(F.coalesce("c", F.lit(0)) == 0, "empty").when(F.col("e") < least_seconds, "short").otherwise("ok").alias("health"))


def info_chapters(info: Column) -> Column:
    """Chapters of a downloader's info JSON, by start, without those at or before 0; null without chapters."""
    c = F.from_json(info, "chapters array<struct<start_time:double,end_time:double,title:string>>")["chapters"]
    kept = F.filter(F.array_sort(c), lambda x: x["start_time"] > 0)
    return F.when(F.size(c) > 0, kept)


def info_files(spark: SparkSession, root: str, pattern: str = "*.info.json", fallback: str | None = "*.json") -> DataFrame:
    """(path, duration, chapters, flags) of info files below a folder: those of the pattern or, if there are none, those of the fallback; names that start with _ are left out."""
    found = lambda p: spark.read.option("pathGlobFilter", p).option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("info"))
    rows = found(pattern)
    if fallback and not rows.inputFiles():
        rows = found(fallback)
    d = F.get_json_object("info", "$.duration").cast("double")
    return rows.select("path", d.alias("duration"), info_chapters(F.col("info")).alias("chapters")).withColumn("flags", sanity(F.col("chapters.start_time"), F.col("duration")))


def sanity(starts: Column, duration: Column) -> Column:
    """Names of what is odd: fewer than three chapters, one under 30 seconds, one over 30 minutes."""
    edges = F.concat(F.array(F.lit(0.0)), F.coalesce(starts, F.array().cast("array<double>")), F.array(duration))
    lengths = F.zip_with(F.slice(edges, 2, F.size(edges) - 1), F.slice(edges, 1, F.size(edges) - 1), lambda x, y: x - y)
    return F.array_compact(F.array(F.when(F.size(lengths) < 3, "few"), F.when(F.exists(lengths, lambda x: x < 30), "short"), F.when(F.exists(lengths, lambda x: x > 1800), "long")))


def cues(body: Column) -> Column:
    """(start, end, text) of the cues of a WebVTT or SRT text, tags stripped and white space collapsed."""
    from ..functions.scalars import seconds_of

    blocks = F.split(F.regexp_replace(body, "\r\n?", "\n"), r"\n{2,}")
    stamp = r"((?:\d+:)?\d+:\d+[.,]\d+)"
    timed = F.filter(blocks, lambda b: F.rlike(b, F.lit(stamp + r"\s*-->\s*" + stamp)))

    def cue(b):
        at = F.regexp_extract_all(b, F.lit(stamp), 1)
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]*>", ""), r"\s+", " ")
        return F.struct(seconds_of(F.element_at(at, 1)).alias("start"), seconds_of(F.element_at(at, 2)).alias("end"), F.trim(text).alias("text"))

    return F.filter(F.transform(timed, cue), lambda c: c["text"] != "")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, start, end, text) of .vtt or .srt files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(cues(F.col("value"))).alias("pos", "c"))
    return rows.select("path", "pos", "c.*")


def json3(body: Column) -> Column:
    """(start, end, text) in seconds of JSON3 captions: joined pieces, at least 0.1 seconds, empty ones dropped."""
    events = F.from_json(body, JSON3)["events"]
    text = lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: s["utf8"]), ""), r"\s+", " "))
    start = lambda e: e["tStartMs"] / 1000.0
    return F.filter(F.transform(events, lambda e: F.struct(start(e).alias("start"), (start(e) + F.greatest(F.lit(0.1), F.coalesce(e["dDurationMs"], F.lit(0)) / 1000.0)).alias("end"), text(e).alias("text"))), lambda c: c["text"] != "")


def xml_captions(body: Column) -> Column:
    """(start, end, text) of <text start dur> elements."""
    zipped = F.arrays_zip(F.xpath(body, F.lit("//text/@start")).alias("s"), F.xpath(body, F.lit("//text/@dur")).alias("d"), F.xpath(body, F.lit("//text/text()")).alias("t"))
    return F.transform(zipped, lambda x: F.struct(x["s"].cast("double").alias("start"), (x["s"].cast("double") + F.greatest(F.lit(0.1), x["d"].cast("double"))).alias("end"), F.trim(F.regexp_replace(x["t"], r"\s+", " ")).alias("text")))


MARKS = re.compile(r'["{}]')
STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def json_after(text: str | None, marker: str) -> str | None:
    """The JSON object that follows a marker: braces matched outside strings. The search jumps from mark to mark and over strings."""
    at = (text or "").find(marker)
    start = text.find("{", at + len(marker)) if at >= 0 else -1
    depth, i = 0, start
    while i >= 0 and (m := MARKS.search(text, i)):
        i = m.end()
        if m[0] == '"':
            end = STRING_END.match(text, i)
            if not end:
                return None
            i = end.end()
        else:
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[start:i]
    return None


def subtopics_of(answer: Column, start: Column, end: Column) -> Column:
    """(start_sec, title) of the subtopics in an answer that holds a JSON object with them: times clamped to [start, end - 60], the first moved to the start; items without a time
    or title drop out, and an answer without such an object gives none."""
    from ..functions.scalars import seconds_of

    body = F.regexp_extract(answer, r'(?s)(\{.*"subtopics".*\})', 1)
    items = F.from_json(body, "subtopics array<struct<start:string,title:string>>")["subtopics"]
    stamp = lambda x: F.when(F.rlike(F.trim(x), F.lit(r"^\d+(:\d+){0,2}(\.\d+)?$")), F.trim(x))
    timed = F.transform(items, lambda x: F.struct(F.when(stamp(x["start"]).isNotNull(), seconds_of(stamp(x["start"]))).alias("t"), F.trim(x["title"]).alias("title")))
    kept = F.filter(timed, lambda x: x["t"].isNotNull() & (F.coalesce(F.length(x["title"]), F.lit(0)) > 0))
    at = lambda x, i: F.when(i == 0, start).otherwise(F.round(F.greatest(start, F.least(x["t"], end - 60)), 1))
    none = F.array().cast("array<struct<start_sec:double,title:string>>")
    return F.coalesce(F.transform(kept, lambda x, i: F.struct(at(x, i).cast("double").alias("start_sec"), x["title"].alias("title"))), none)


def embedded_json(marker: str):
    """A column function for json_after; brace matching is beyond regular expressions, so it is an Arrow-batched function."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json_after(x, marker))

    return f


def best_track(tracks: DataFrame) -> DataFrame:
    """One caption track (seq_id, lang, kind, url) of each sequence: English first, then written over recognised ones, then by url."""
    w = Window.partitionBy("seq_id").orderBy((~F.startswith("lang", F.lit("en"))).cast("int"), (F.col("kind") == "asr").cast("int"), "url")
    return tracks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def npy_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(path, pos, model, vec) of .npy matrices: a one-off import; each file is one array of a sequence."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def load(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(c), allow_pickle=False)
                for i in range(0, len(m), 4096):
                    yield pd.DataFrame({"path": p, "pos": range(i, min(i + 4096, len(m))), "model": model, "vec": list(m[i : i + 4096].astype(np.float32))})

    return files.mapInPandas(load, "path string, pos int, model string, vec array<float>")


def result_cube(body: Column) -> Column:
    """method -> sequence -> metric -> text of a result report's JSON; error rows keep their message under `error`."""
    return F.from_json(F.get_json_object(body, "$.results"), CUBE)


def results(spark: SparkSession, path: str) -> DataFrame:
    """(stem, method, seq_id, metric, value) of finite numbers in result reports."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), F.explode(result_cube(F.col("value"))).alias("method", "by"))
    rows = rows.select("stem", "method", F.explode("by").alias("seq_id", "m")).select("stem", "method", "seq_id", F.explode("m").alias("metric", "v"))
    x = F.expr("try_cast(v AS double)")
    return rows.select("stem", "method", "seq_id", "metric", x.alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def not_yet(wanted: DataFrame, done: DataFrame, key: str = "seq_id") -> DataFrame:
    """Keys whose output isn't there: the batch form of skipping what exists."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
