"""Choosing boundaries from scores (seq_id, boundary, score). Ties always go to the smaller boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def every() -> WindowSpec:
    return Window.partitionBy("seq_id")


def best_first(score: str = "score") -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy(F.desc(score), "boundary")


def top_k(scores: DataFrame, k: Column | int, score: str = "score", largest: bool = True) -> DataFrame:
    """The k best of each sequence; k may be a column. The ranking filter lets Spark keep only the head of each sequence before the shuffle when k is a number."""
    order = Window.partitionBy("seq_id").orderBy(F.desc(score) if largest else F.asc(score), "boundary")
    return scores.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def mean_std(scores: DataFrame, c: float, above: bool = True) -> DataFrame:
    """Scores above mean + c * population deviation, or below mean - c * deviation."""
    m, s = F.avg("score").over(every()), F.stddev_pop("score").over(every())
    rows = scores.withColumn("_t", m + c * s if above else m - c * s)
    return rows.where(F.col("score") > F.col("_t") if above else F.col("score") < F.col("_t")).drop("_t")


def below(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("score") < threshold)


def relative_to_max(scores: DataFrame, share: float, min_k: int, max_k: int) -> DataFrame:
    """Scores of at least a share of the largest, but at least min_k and at most max_k of them."""
    rows = scores.withColumn("_m", F.max("score").over(every())).withColumn("_r", F.row_number().over(best_first()))
    return rows.where((F.col("_r") <= min_k) | ((F.col("score") >= share * F.col("_m")) & (F.col("_r") <= max_k))).drop("_m", "_r")


def adaptive_share(scores: DataFrame) -> DataFrame:
    """(seq_id, cv, share): 0.60 for a coefficient of variation under 0.40, 0.80 over 0.65, else 0.70."""
    cv = F.stddev_pop("score") / (F.avg("score") + F.lit(1e-8))
    return scores.groupBy("seq_id").agg(cv.alias("cv")).withColumn("share", F.when(F.col("cv") < 0.40, 0.60).when(F.col("cv") > 0.65, 0.80).otherwise(0.70))


def oversample(scores: DataFrame, k: int, factor: int, rescore: DataFrame) -> DataFrame:
    """The k best by a second score among the factor * k best by the first."""
    first = top_k(scores, k * factor).select("seq_id", "boundary")
    return top_k(first.join(rescore, ["seq_id", "boundary"]), k)


def elbow(scores: DataFrame) -> DataFrame:
    """(seq_id, k): where the second difference of the sorted scores is least, plus two segments."""
    w = Window.partitionBy("seq_id").orderBy(F.desc("score"), "boundary")
    rows = scores.withColumn("_i", F.row_number().over(w)).withColumn("_d", F.lead("score").over(w) - 2 * F.col("score") + F.lag("score").over(w)).where(F.col("_d").isNotNull())
    return rows.groupBy("seq_id").agg(F.min_by("_i", F.struct("_d", "_i")).alias("_i")).select("seq_id", (F.col("_i") + 1).alias("k"))
