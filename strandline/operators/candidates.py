"""Candidate boundaries: the sources that name them, their features, hand-weighted scores, and choices among them.

A source is a map (seq_id, boundary, source, model, score, votes) that one model's gaps or splits give. Everything after it is aggregation and windows by
sequence, so candidates of all sequences and sources are one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gaps, grouped, metrics, portfolio
from . import segmenters as S
from .folds import apart, fold, long_enough, ranked

#: Windows of splits and of gaps, weights of the vote score and of the score families over the feature columns.
SPLIT_WINDOWS, GAP_WINDOWS = (1, 5, 9, 13), (3, 5, 9)
VOTE = {"vote": 0.45, "max_source": 0.30, "mean_source": 0.15, "prosody": 0.05, "shots": 0.05}
FAMILIES = {
    "vote": {"vote": 0.45, "max_source": 0.25, "mean_source": 0.15, "agreement": 0.10, "density": 0.05},
    "agreement": {"vote": 0.30, "agreement": 0.30, "density": 0.20, "max_source": 0.15, "mean_source": 0.05},
    "transition": {"max_source": 0.30, "mean_source": 0.20, "vote": 0.20, "prosody": 0.10, "shots": 0.10, "density": 0.10},
    "stable": {"vote": 0.25, "max_source": 0.25, "agreement": 0.20, "mean_source": 0.15, "density": 0.10, "isolation": 0.05},
    "contrast": {"max_source": 0.35, "source_std": 0.20, "vote": 0.20, "density": 0.15, "agreement": 0.10},
    "balanced": {"vote": 0.24, "max_source": 0.22, "mean_source": 0.16, "agreement": 0.16, "density": 0.10, "prosody": 0.05, "shots": 0.03, "centre": 0.04, "early": -1.0, "late": -1.0},
}
#: Most points of a search: they are a table that the driver makes.
MOST_POINTS = 10_000


def within(*by: str):
    return Window.partitionBy(*(by or ("seq_id",)))


def scaled(c: str) -> Column:
    """Min-max over a sequence; flat is 0."""
    lo, hi = F.min(c).over(within()), F.max(c).over(within())
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def gap_sources(units: DataFrame, model: str, targets: DataFrame) -> DataFrame:
    """The max(8 t, 50) largest gaps of neighbours and of one-sided windows, min-maxed; `targets` is (seq_id, t). All are columns of one pass, so vectors are read once a model."""
    names = ["adj", *(f"win{w}" for w in GAP_WINDOWS)]
    g = gaps.gaps_together(units, GAP_WINDOWS).select("seq_id", "boundary", *(F.round(n, 6).alias(n) for n in names))
    g = g.select("seq_id", "boundary", *(scaled(n).alias(n) for n in names)).join(targets, "seq_id")
    each = F.array(*(F.struct(F.lit(f"{model}_{n}").alias("source"), F.col(n).alias("score")) for n in names))
    rows = g.select("seq_id", "boundary", "t", F.inline(each))
    rank = F.row_number().over(within("seq_id", "source").orderBy(F.desc("score"), "boundary"))
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= F.greatest(8 * F.col("t"), F.lit(50)))
    return best.select("seq_id", "boundary", "source", F.lit(model).alias("model"), "score", F.lit(1).alias("votes"))


def split_sources(units: DataFrame, model: str, targets: DataFrame) -> DataFrame:
    """Greedy splits of smoothed vectors, several times as many as asked for; the score falls along the sequence. Two votes each."""

    def one(seq_id: int, pdf: pd.DataFrame) -> list[tuple]:
        v, t = np.array(pdf["vec"].tolist(), np.float64), int(pdf["t"].iloc[0])
        n, out = len(v), []
        if n < 3:
            return out
        for w in SPLIT_WINDOWS:
            got = sorted(S.divisive_order(S.smooth(v, w), min(n - 1, max(6 * t, t + 20, 30)) + 1)[0])
            out += [(seq_id, b, f"{model}_div_w{w}", model, 1 - i / len(got), 2) for i, b in enumerate(got)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in grouped.sequences(batches, one):
            yield pd.DataFrame(out, columns=["seq_id", "boundary", "source", "model", "score", "votes"]).astype({"seq_id": "int64"})

    rows = units.select("seq_id", "pos", "vec").join(targets, "seq_id")
    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "pos").mapInPandas(run, "seq_id long, boundary int, source string, model string, score double, votes int")


def features(sources: DataFrame, sizes: DataFrame, targets: DataFrame, names: list[str], n_models: int, prosody: DataFrame | None = None, shots: DataFrame | None = None) -> DataFrame:
    """(seq_id, boundary, place, edge, log_n, target, vote, agreement, mean_source, max_source, isolation, prosody, shots, density, source_std, *names): the eleven
    features of each candidate, two more that the score families take from its sources, and a column for each of the sources. `prosody` and `shots` are (seq_id, boundary, score)."""
    value = lambda n: F.coalesce(F.max(F.when(F.col("source") == n, F.col("score"))), F.lit(0.0)).alias(n)
    rows = sources.groupBy("seq_id", "boundary").agg(F.sum("votes").alias("_votes"), F.count_distinct("model").alias("_models"), *[value(n) for n in names])
    rows = rows.join(sizes, "seq_id").join(targets, "seq_id")
    for name, signal in (("prosody", prosody), ("shots", shots)):
        rows = rows.withColumn(name, F.lit(0.0)) if signal is None else rows.join(signal.select("seq_id", "boundary", F.col("score").alias(name)), ["seq_id", "boundary"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    order = within().orderBy("boundary")
    near = F.least(F.col("boundary") - F.lag("boundary").over(order), F.lead("boundary").over(order) - F.col("boundary"))
    every = F.array(*names)
    some = F.filter(every, lambda x: x > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(every) / len(names)
    n, b = F.col("n"), F.col("boundary")
    return rows.select(
        "seq_id", "boundary", (b / n).alias("place"), (F.least(b, n - b) / n).alias("edge"), F.log1p("n").alias("log_n"), (F.col("t") / n).alias("target"), (F.col("_votes") / F.max("_votes").over(within())).alias("vote"),
        (F.col("_models") / n_models).alias("agreement"), F.coalesce(F.try_divide(total(some), F.size(some)), F.lit(0.0)).alias("mean_source"), F.coalesce(F.array_max(some), F.lit(0.0)).alias("max_source"),
        F.coalesce(near / n, F.lit(1.0)).alias("isolation"), "prosody", "shots", (F.size(some) / len(names)).alias("density"), F.sqrt(total(F.transform(every, lambda x: (x - mean) * (x - mean))) / len(names)).alias("source_std"), *names,
    )


def weighted_sum(weights: dict[str, float]) -> Column:
    """A weighted sum of feature columns, rounded."""
    extra = {
        "centre": F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.col("edge")))),
        "early": F.when(F.col("place") < 0.04, 0.15).otherwise(0.0),
        "late": F.when(F.col("place") > 0.96, 0.10).otherwise(0.0),
    }
    return F.round(sum((w * extra.get(c, F.col(c)) for c, w in list(weights.items())[1:]), list(weights.values())[0] * F.col(next(iter(weights)))), 9)


def weighted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(seq_id, boundary, score): a weighted sum of feature columns, min-maxed over the sequence."""
    return rows.select("seq_id", "boundary", weighted_sum(weights).alias("score")).withColumn("score", scaled("score"))


def vote_scores(rows: DataFrame) -> DataFrame:
    return weighted(rows, VOTE)


def score_families(rows: DataFrame) -> DataFrame:
    """(seq_id, boundary, family, score) of the six hand-weighted families, of one pass over the rows."""
    every = rows.select("seq_id", "boundary", *(weighted_sum(w).alias(name) for name, w in FAMILIES.items()))
    one = F.array(*(F.struct(F.lit(name).alias("family"), scaled(name).alias("score")) for name in FAMILIES))
    return every.select("seq_id", "boundary", one.alias("s")).select("seq_id", "boundary", F.inline("s"))


def blended(base: DataFrame, other: DataFrame, alpha: float, most: int) -> DataFrame:
    """(seq_id, boundary, score): (1 - alpha) * base + alpha * other, min-maxed, and 0 outside the `most` best of the base: a costlier judge sees a shortlist only."""
    rank = F.row_number().over(within().orderBy(F.desc("score"), "boundary"))
    rows = base.withColumn("_r", rank).join(other.select("seq_id", "boundary", F.col("score").alias("_o")), ["seq_id", "boundary"], "left")
    rows = rows.withColumn("score", F.round((1 - alpha) * F.col("score") + alpha * F.coalesce("_o", F.lit(0.0)), 9)).withColumn("score", scaled("score"))
    return rows.select("seq_id", "boundary", F.when((F.lit(alpha) == 0) | (F.col("_r") <= most), F.col("score")).otherwise(0.0).alias("score"))


def oracle(candidates: DataFrame, refs: DataFrame, tolerance: int = 2) -> DataFrame:
    """(seq_id, boundary): the candidate nearest to each reference boundary, if one is within the tolerance. The band is an equi join on offsets."""
    near = refs.select("seq_id", F.col("boundary").alias("_ref"), F.explode(F.sequence(F.col("boundary") - tolerance, F.col("boundary") + tolerance)).alias("boundary"))
    hits = near.join(candidates.select("seq_id", "boundary").distinct(), ["seq_id", "boundary"])
    pick = F.min_by("boundary", F.struct(F.abs(F.col("boundary") - F.col("_ref")), F.col("boundary"))).alias("boundary")
    return hits.groupBy("seq_id", "_ref").agg(pick).select("seq_id", "boundary").distinct()


def search(scores: DataFrame, refs: DataFrame, sizes: DataFrame, points: list[tuple[float, int, int]]) -> DataFrame:
    """(seq_id, method, pk, wd, error) of greedy choices for points (share of the reference's count, least length, suppression window): boundaries are ranked once for all points."""
    if len(points) > MOST_POINTS:
        raise ValueError(f"{len(points)} points; at most {MOST_POINTS}")
    point = F.explode(F.array(*[F.struct(F.lit(f"frac{round(100 * f)}_min{m}_nms{w}").alias("method"), F.lit(float(f)).alias("f"), F.lit(m).alias("m"), F.lit(w).alias("w")) for f, m, w in points])).alias("_p")
    t = refs.groupBy("seq_id").agg(F.count("*").alias("t"))
    rows = ranked(scores).join(sizes, "seq_id").join(t, "seq_id").select("*", point).select("*", "_p.*")
    k = F.greatest(F.lit(1), F.bround(F.col("t") * F.col("f")).cast("int"))
    kept = fold(rows, lambda acc, b: apart(acc, b, F.col("w")) & long_enough(acc, b, F.col("m"), F.col("n")), k)
    key = F.struct("seq_id", "method").alias("seq_id")
    hyp = kept.select(key, F.explode("kept").alias("boundary"))
    every = lambda df, *c: df.select("*", point).select(F.struct("seq_id", "_p.method").alias("seq_id"), *c)
    m = metrics.evaluate(hyp, every(refs.join(t.select("seq_id"), "seq_id"), "boundary"), every(sizes.join(t.select("seq_id"), "seq_id"), "n"), ())
    return m.select("seq_id.seq_id", "seq_id.method", "pk", "wd", F.lit(None).cast("string").alias("error"))


def search_left_out(cube: DataFrame) -> DataFrame:
    """(seq_id, method, pk, wd): for each sequence the point that is best over all others."""
    return portfolio.leave_one_out(cube)


def max_spread(boundaries: DataFrame, k: Column | int) -> DataFrame:
    """(seq_id, boundary): the middle boundary, and then always the one farthest from all chosen, the smaller on a tie, up to k."""
    rows = boundaries.groupBy("seq_id").agg(F.array_sort(F.collect_set(F.col("boundary").cast("int"))).alias("b"))
    k = F.lit(k) if isinstance(k, int) else k
    first = F.array(F.element_at("b", (F.size("b") / 2).cast("int") + 1))

    def step(acc: Column, _: Column) -> Column:
        apart_ = F.transform(F.filter("b", lambda x: ~F.array_contains(acc, x)), lambda x: F.struct(F.array_min(F.transform(acc, lambda a: F.abs(x - a))).alias("d"), (-x).alias("x")))
        return F.when(F.size(acc) < F.least(k, F.size("b")), F.array_append(acc, -F.array_max(apart_)["x"])).otherwise(acc)

    return rows.select("seq_id", F.explode(F.array_sort(F.when(F.size("b") <= k, F.col("b")).otherwise(F.aggregate("b", first, step)))).alias("boundary"))


def subtopic_peaks(units: DataFrame, chapters: DataFrame, window: int = 2, c: float = 0.3, least: int = 8, share: int = 20, most: int = 3) -> DataFrame:
    """(seq_id, chapter, boundary): within each chapter of `least` units or more, strict inner maxima of one-sided gaps over mean + c * deviation; the best
    min(most, max(1, length // share)) of them. `chapters` is (seq_id, boundary)."""
    marks = chapters.select("seq_id", F.col("boundary").alias("pos"), F.lit(1).alias("_b"))
    rows = units.join(marks, ["seq_id", "pos"], "left").withColumn("chapter", F.coalesce(F.sum("_b").over(Window.partitionBy("seq_id").orderBy("pos")), F.lit(0)))
    own = Window.partitionBy("seq_id", "chapter")
    rows = rows.withColumn("_n", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy("pos")) - 1).where(F.col("_n") >= least)
    key = F.struct("seq_id", "chapter").alias("seq_id")
    g = gaps.gap_one_sided(rows.select(key, F.col("_at").alias("pos"), "vec"), window).withColumn("score", F.round("score", 6))
    every, order = Window.partitionBy("seq_id"), Window.partitionBy("seq_id").orderBy("boundary")
    mean, spread = F.avg("score").over(every), F.stddev_pop("score").over(every)
    g = g.withColumn("_peak", (F.col("score") > F.round(mean + c * spread, 9)) & (F.col("score") > F.lag("score").over(order)) & (F.col("score") > F.lead("score").over(order)))
    z = rows.groupBy("seq_id", "chapter").agg(F.max("_n").alias("_n"), F.min("pos").alias("_first"))
    g = g.where("_peak").select("seq_id.*", "boundary", "score").join(z, ["seq_id", "chapter"])
    rank = F.row_number().over(own.orderBy(F.desc("score"), "boundary"))
    return g.withColumn("_r", rank).where(F.col("_r") <= F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("_n") / share)))).select("seq_id", "chapter", (F.col("_first") + F.col("boundary") - 1).alias("boundary"))


def late_fusion(text: DataFrame, other: DataFrame, w_text: float, w_other: float) -> DataFrame:
    """(seq_id, boundary, score): two min-maxed gap maps by weights that are made to add up to one; boundaries that both have."""
    a = text.withColumn("_a", scaled("score")).drop("score")
    b = other.withColumn("_b", scaled("score")).drop("score")
    total = w_text + w_other
    return a.join(b, ["seq_id", "boundary"]).select("seq_id", "boundary", (w_text / total * F.col("_a") + w_other / total * F.col("_b")).alias("score"))


#: The pause signals and their weights of pause, pitch reset and pitch deviation.
PAUSE_SIGNALS = {"pause": (1.0, 0.0, 0.0), "pitch_reset": (0.0, 1.0, 0.0), "pitch_std": (0.0, 0.0, 1.0), "fused_0.6_0.2_0.2": (0.6, 0.2, 0.2), "fused_0.5_0.3_0.2": (0.5, 0.3, 0.2), "fused_0.7_0.2_0.1": (0.7, 0.2, 0.1)}


def pause_signals(parts: DataFrame) -> DataFrame:
    """(seq_id, boundary, signal, score) of the six signals over parts (seq_id, boundary, pause, reset, spread), each min-maxed."""
    rows = parts.select("seq_id", "boundary", scaled("pause").alias("_a"), scaled("reset").alias("_b"), scaled("spread").alias("_c"))
    each = [F.struct(F.lit(n).alias("signal"), (a * F.col("_a") + b * F.col("_b") + c * F.col("_c")).alias("score")) for n, (a, b, c) in PAUSE_SIGNALS.items()]
    return rows.select("seq_id", "boundary", F.explode(F.array(*each)).alias("x")).select("seq_id", "boundary", "x.*")
