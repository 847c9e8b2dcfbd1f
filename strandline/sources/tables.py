"""Canonical relations over the provided tables: vectors, reference boundaries, text units, timed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH = 50  # vectors of a sequence
MOST_UNITS = 800  # of a sequence, unless a caller says otherwise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, vec array<double>, label)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {LENGTH}").alias("seq_id"), (F.col("vec_id") % LENGTH).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, vec1, vec2): either half of the components stands for a model."""
    v = vectors(spark, sf_dir)
    return v.select("seq_id", "pos", F.slice("vec", 1, 32).alias("vec1"), F.slice("vec", 33, 32).alias("vec2"), "label")


def references(units: DataFrame) -> DataFrame:
    """(seq_id, boundary) of labelled vectors."""
    return units.where((F.col("pos") > 0) & F.col("label").isin(0, 1)).select("seq_id", F.col("pos").alias("boundary"))


def sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("seq_id").agg(F.count("*").cast("int").alias("n"))


def text_units(spark: SparkSession, sf_dir: str, least_tokens: int = 3) -> DataFrame:
    """(seq_id, pos, text): documents cut at sentence ends and line breaks, without pieces of fewer than three tokens."""
    pieces = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.posexplode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n+")).alias("at", "text"))
    kept = pieces.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_tokens)
    return kept.select("seq_id", (F.row_number().over(Window.partitionBy("seq_id").orderBy("at")) - 1).alias("pos"), F.trim("text").alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, role, text) of conversations."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("turn").cast("int").alias("pos"), "role", "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


def timed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, start, end): views and clicks of a user, each up to the next; the last lasts a microsecond."""
    w = Window.partitionBy("seq_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return e.select("seq_id", (F.row_number().over(w) - 1).alias("pos"), F.col("us").alias("start"), F.coalesce(F.lead("us").over(w), F.col("us") + 1).alias("end"))


def marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(seq_id, event_id, us, value) of the events of one type."""
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("seq_id", "event_id", "us", "value")


# The same relations in DuckDB's SQL, as members of a WITH list.
SQL = {
    "vectors": f"vectors AS (SELECT vec_id // {LENGTH} AS seq_id, (vec_id % {LENGTH})::INT AS pos, embedding::DOUBLE[] AS vec, label FROM embeddings)",
    "refs": "refs AS (SELECT seq_id, pos AS boundary FROM vectors WHERE pos > 0 AND label IN (0, 1))",
    "sizes": "sizes AS (SELECT seq_id, count(*)::INT AS n FROM vectors GROUP BY seq_id)",
    "units": r"""pieces AS (
  SELECT doc_id AS seq_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS text,
         generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), 1) AS ix FROM documents),
units AS (SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY ix) - 1)::INT AS pos, trim(text) AS text FROM pieces
  WHERE len(string_split_regex(trim(text), '\s+')) >= 3)""",
    "turns": "turns AS (SELECT conv_id AS seq_id, turn::INT AS pos, role, text FROM conversations)",
    "ev": "ev AS (SELECT user_id AS seq_id, event_id, epoch_us(ts) AS us, event_type, value FROM events)",
    "timed": "timed AS (SELECT seq_id, (row_number() OVER w - 1)::INT AS pos, us AS start, coalesce(lead(us) OVER w, us + 1) AS fin FROM ev WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY seq_id ORDER BY us, event_id))",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
