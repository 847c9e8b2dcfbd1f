"""Small helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows, so that a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo `modulus`; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(**columns: tuple) -> pa.RecordBatch:
    """A record batch from name=(values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def grouped(items: Iterable[tuple], most: int, weight) -> Iterator[list[tuple]]:
    """Consecutive items, in lists of a total weight of at most `most` (one heavier item stands alone)."""
    held, total = [], 0
    for x in items:
        w = weight(x)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += w
    if held:
        yield held


def excerpt(text: Column, key: Column, most: int) -> Column:
    """At most `most` characters of a text from a place that a hash of its key picks: for fitting on a bounded sample only."""
    room = F.greatest(F.length(text) - F.lit(most), F.lit(0)) + F.lit(1)
    return F.substring(text, F.pmod(F.xxhash64(key, F.lit("place")), room).cast("int") + F.lit(1), F.lit(most))


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int, most_classes: int = 1000) -> DataFrame:
    """About `per_class` rows of each label, picked by a hash of the key: at most 2 * per_class * most_classes rows.

    The most frequent `most_classes` labels are counted on the driver; only these few counts are collected."""
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), F.col(label)).limit(most_classes).collect()
    share = F.coalesce(*[F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, per_class / r["count"]))) for r in counts]) if counts else F.lit(0.0)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < share).limit(2 * per_class * max(1, len(counts)))


def sampled_documents(docs: DataFrame, labels: DataFrame, label: str, key: str, per_class: int, where: Column | None = None) -> DataFrame:
    """The documents of about `per_class` labelled keys of each class 0 and 1, with the label as y. The sample is drawn from the labels alone and is at most
    4 * per_class rows, so it is broadcast and no text is shuffled."""
    known = labels.where(F.col(label).isin(0, 1) & (F.lit(True) if where is None else where)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    few = sample_by_class(known, "y", "k", per_class, most_classes=2)
    return docs.withColumnRenamed(key, "k").drop("y").join(F.broadcast(few), "k")


def files_of(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, else, only where it is unset and Spark runs on one machine, a local one."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    df.write.parquet(path := files_of(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Delete the files of a table of `written` that nothing refers to any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
