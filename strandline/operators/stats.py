"""Statistics over paired scores and resamples, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf


#: Ranges that an ordering is cut into, so that numbering it is no single task.
RANGES = 64


def ranges(rows: DataFrame, order: str) -> tuple[DataFrame, str]:
    """Adds the number of the range of `order` that a row lies in; about as many rows in each. Equal values share a range."""
    cuts = sorted(set(rows.stat.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005)))
    return rows.withColumn("_range", sum((F.when(F.col(order) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))), "_range"


def before(rows: DataFrame, by: list[str], order: str, count: str | None = None) -> DataFrame:
    """Adds `_before`: how many rows (or the sum of `count`) of the same `by` come before a row in `order`. Rows are summed within ranges of the order and the ranges'
    totals, a few for each key, are added up, so no key's rows meet in one task."""
    rows, part = ranges(rows, order)
    own = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    value = F.lit(1) if count is None else F.col(count)
    totals = rows.groupBy(*by, part).agg(F.sum(value).alias("_t"))
    totals = totals.withColumn("_t", F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_b", F.coalesce(F.sum(value).over(own), F.lit(0))).join(totals, [*by, part]).withColumn("_before", F.col("_b") + F.col("_t")).drop("_b", "_t", part)


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, w, z, p) of rows (by, a, b): signed ranks of b - a without zeros, average ranks of ties, the normal approximation without corrections."""
    d = pairs.withColumn("d", F.round(F.col("b") - F.col("a"), 9)).where("d <> 0").withColumn("m", F.abs("d"))
    m = d.groupBy(*by, "m").agg(F.count("*").alias("_c"), F.count_if(F.col("d") > 0).alias("_up"))
    r = F.col("_before") + (F.col("_c") + 1) / 2  # the mean rank of ties
    m = before(m, by, "m", "_c").withColumn("r", r)
    g = m.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_up") * F.col("r")).alias("up"), F.sum((F.col("_c") - F.col("_up")) * F.col("r")).alias("down"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    g = g.withColumn("w", F.least("up", "down")).withColumn("z", z).withColumn("p", F.round(2 * normal_cdf(-F.abs("z")), 4))
    return pairs.select(*by).distinct().join(g, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("p", F.lit(1.0)).alias("p"))


def bootstrap(rows: DataFrame, by: list[str], order: str, value: str, resamples: int = 200, alpha: float = 0.05, statistic=F.avg) -> DataFrame:
    """(by, mean, low, high): percentile interval of a statistic over resamples. The i-th draw of resample r takes the row whose number is a fixed linear
    congruence of r and i, so every engine draws alike; draws meet rows in an equi join on that number. Draws are generated by row: n * resamples of them."""
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    x = before(rows, by, order).withColumn("_i", F.col("_before").cast("int")).join(n, by)
    draws = x.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    # Fixed values of the generator.
    place = F.floor((((F.col("_r").cast("long") * 7919 + F.col("_i").cast("long") * 104729 + 12345) * 48271) % 2147483647) % F.col("_n"))
    draws = draws.select(*by, "_r", place.cast("int").alias("_i"))
    means = draws.join(x.select(*by, "_i", value), [*by, "_i"]).groupBy(*by, "_r").agg(F.round(statistic(value), 9).alias("_m"))
    ends = means.groupBy(*by).agg(F.array_sort(F.collect_list("_m")).alias("_s"))
    at = lambda share: F.element_at("_s", int(min(resamples - 1, max(0, int(share * resamples)))) + 1)
    ends = ends.select(*by, F.round(at(alpha / 2), 4).alias("low"), F.round(at(1 - alpha / 2), 4).alias("high"))
    return rows.groupBy(*by).agg(F.round(statistic(value), 4).alias("mean")).join(ends, by)


def compare_methods(cube: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """(n, mean_a, mean_b, delta, wins, losses, ties, p, significant) of two methods over the sequences that both have; lower is better."""
    x = cube.where((F.col("method") == a) & F.col("error").isNull()).select("seq_id", F.col(metric).alias("a"))
    y = cube.where((F.col("method") == b) & F.col("error").isNull()).select("seq_id", F.col(metric).alias("b"))
    pairs = x.join(y, "seq_id").withColumn("all", F.lit(1))
    s = pairs.groupBy("all").agg(F.count("*").alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count_if(F.col("b") < F.col("a")).alias("wins"), F.count_if(F.col("b") > F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"))
    return s.join(wilcoxon(pairs, ["all"]).select("all", "p"), "all").select("n_pairs", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), "wins", "losses", "ties", "p", (F.col("p") < 0.05).alias("significant"))


def improvement(baseline: Column, value: Column) -> Column:
    """Percent by which a value is below a baseline."""
    return F.when(baseline != 0, 100 * (baseline - value) / baseline)


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, median, least and largest."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))
