"""The evaluation battery: methods over sequences, metrics of each, means of each method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps, metrics, select
from ..sources import tables as T
from . import combinations
from .common import fixed, rounded

DEFAULT = ["cosine", "divisive", "divisive_smooth9", "dp", "treeseg", "depth", "cross_e5_frac70", "cross_e5_frac70_minlen10", "iterative_cross_e5", "hierarchical"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap scores, the nine best gaps of each sequence, and their Pk and WindowDiff against the reference with the means over all sequences. Pure DataFrame
    operations: scan, window frames, ranking, equi self-join, aggregation."""
    units = T.vectors(spark, sf_dir)
    hyp = select.top_k(fixed(gaps.gap_one_sided(units, 3)), 9).select("seq_id", "boundary")
    m = metrics.pk_wd(hyp, T.references(units), T.sizes(units))
    return rounded(m.rollup("seq_id").agg(F.avg("pk").alias("pk"), F.avg("wd").alias("wd"), F.count("*").alias("n")))


def results(spark: SparkSession, sf_dir: str, methods: list[str] | None = None) -> DataFrame:
    """(method, seq_id, pk, wd, bs, f1) of registry methods on each sequence: the result cube that portfolio and selector operators take."""
    methods = methods or DEFAULT
    units = T.two_models(spark, sf_dir)
    sizes, refs = T.sizes(units), T.references(units)
    k = refs.groupBy("seq_id").agg((F.count("*") + 1).cast("int").alias("k"))
    hyp = combinations.run_methods(units, sizes.join(k, "seq_id", "left").select("seq_id", F.coalesce("k", F.lit(1)).alias("k")), methods)
    key = lambda df: df.withColumn("seq_id", F.struct("seq_id", "method")).drop("method")
    every = lambda df: key(df.withColumn("method", F.explode(F.array(*map(F.lit, methods)))))  # noqa: E731  a short fixed list
    hyp, refs, sizes = key(hyp), every(refs), every(sizes)
    m = metrics.evaluate(hyp, refs, sizes, (2,)).withColumnRenamed("f1_t2", "f1")
    return m.select("seq_id.method", "seq_id.seq_id", "pk", "wd", "bs", "f1")


def battery(spark: SparkSession, sf_dir: str, methods: list[str] | None = None) -> DataFrame:
    """(method, n, pk, wd, bs, f1): means over sequences. The method is part of the sequence key, so metrics of all methods are one pass."""
    return rounded(results(spark, sf_dir, methods).groupBy("method").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("pk", "wd", "bs", "f1")]))
