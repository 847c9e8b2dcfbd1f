"""Tables written to the folder that driver and executors share, so that lineage ends there; and tables that are kept for further runs under a name made of what they depend on."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    df.write.parquet(path := f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Delete the files of a table of `stored` that nothing refers to any more."""
    at, files = _files(df.sparkSession, df.stored_at)
    files.delete(at, True)


def version(spark: SparkSession, parameters: dict, inputs: list[str]) -> str:
    """A name for what parameters and input files give: of the parameters, and of each input file's path, length and time of change."""
    found = []
    for path in sorted(inputs):
        at, files = _files(spark, path)
        each = files.listFiles(at, True) if files.getFileStatus(at).isDirectory() else None
        one = [files.getFileStatus(at)] if each is None else []
        while each is not None and each.hasNext():
            one.append(each.next())
        found.append(sorted([str(f.getPath()), f.getLen(), f.getModificationTime()] for f in one))
    return hashlib.sha256(json.dumps([parameters, found], sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, name: str, parameters: dict, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that `build` gives, read from `folder` where one of the same parameters and input files is, else built and kept there.

    A table is written under a name of its own and renamed once whole, and a table counts only with Spark's mark of success; so a writer that dies leaves nothing that is
    read, and of two writers at once the first to rename wins. Old versions stay until `forgotten`."""
    target = f"{folder.rstrip('/')}/{name}/{version(spark, parameters, inputs)}"
    at, files = _files(spark, target)
    whole = lambda: files.exists(_files(spark, target + "/_SUCCESS")[0])
    if not whole():
        made = build()
        made.write.parquet(staged := f"{folder.rstrip('/')}/{name}/_staged-{uuid.uuid4().hex}")
        if not whole():
            files.delete(at, True)
            files.rename(_files(spark, staged)[0], at)
        if files.exists(_files(spark, staged)[0]):
            files.delete(_files(spark, staged)[0], True)
    return spark.read.parquet(target)


def forgotten(spark: SparkSession, folder: str, name: str, keep: str | None = None) -> int:
    """Delete all kept tables of a name, and what dead writers left, but the version to keep. How many were deleted."""
    at, files = _files(spark, f"{folder.rstrip('/')}/{name}")
    gone = [f.getPath() for f in files.listStatus(at) if f.getPath().getName() != keep] if files.exists(at) else []
    for path in gone:
        files.delete(path, True)
    return len(gone)
