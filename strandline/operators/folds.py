"""Greedy selections over one sequence, as folds of score-ordered arrays in Catalyst.

Input rows are (seq_id, boundary, score) with sizes (seq_id, n); results are (seq_id, boundary) rows or arrays. Candidates go strongest first, ties to the
smaller boundary. A fold's state is the array accepted so far, so it needs no Python and no second shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound
from .select import best_first


def none() -> Column:
    return F.array().cast("array<int>")


def ranked(scores: DataFrame) -> DataFrame:
    """(seq_id, ranked): boundaries strongest first."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("boundary").cast("int").alias("b"))))
    return scores.groupBy("seq_id").agg(pairs.alias("_p")).select("seq_id", F.col("_p.b").alias("ranked"))


def fold(rows: DataFrame, accept: Callable[[Column, Column], Column], most: Column | None = None) -> DataFrame:
    """Adds `kept`, the accepted boundaries in rising order."""

    def step(acc, b):
        good = accept(acc, b) if most is None else accept(acc, b) & (F.size(acc) < most)
        return F.when(good, F.array_append(acc, b)).otherwise(acc)

    return rows.withColumn("kept", F.array_sort(F.aggregate("ranked", none(), step)))


def apart(acc: Column, b: Column, window: Column | int, inclusive: bool = True) -> Column:
    """No accepted boundary within the window."""
    near = (lambda x: F.abs(x - b) <= window) if inclusive else (lambda x: F.abs(x - b) < window)
    return ~F.exists(acc, near)


def long_enough(acc: Column, b: Column, least: Column | int, n: Column) -> Column:
    """All segments that accepting b would make have at least that length. Those apart from b's own two are as they were."""
    return apart(acc, b, least, inclusive=False) & (b >= least) & (n - b >= least)


def nms(scores: DataFrame, window: int = 5) -> DataFrame:
    return fold(ranked(scores), lambda acc, b: apart(acc, b, window)).select("seq_id", F.explode("kept").alias("boundary"))


def min_segment_length(scores: DataFrame, sizes: DataFrame, least: int = 8) -> DataFrame:
    rows = ranked(scores).join(sizes, "seq_id")
    return fold(rows, lambda acc, b: long_enough(acc, b, least, F.col("n"))).select("seq_id", F.explode("kept").alias("boundary"))


def postprocess(scores: DataFrame, sizes: DataFrame, window: int = 5, least: int = 8) -> DataFrame:
    """Non-maximum suppression, then minimum length."""
    kept = nms(scores, window).join(scores, ["seq_id", "boundary"])
    return min_segment_length(kept, sizes, least)


def select_boundaries(scores: DataFrame, sizes: DataFrame, k: int, least: int = 5, window: int = 3) -> DataFrame:
    """Suppression within the window, minimum length, and at most k."""
    rows = ranked(scores).join(sizes, "seq_id")
    return fold(rows, lambda acc, b: apart(acc, b, window) & long_enough(acc, b, least, F.col("n")), F.lit(k)).select("seq_id", F.explode("kept").alias("boundary"))


def spaced_top(scores: DataFrame, k: int, min_gap: int) -> DataFrame:
    """At most k, none closer than min_gap to another."""
    return fold(ranked(scores), lambda acc, b: apart(acc, b, min_gap, inclusive=False), F.lit(k)).select("seq_id", F.explode("kept").alias("boundary"))


def pick_spaced(scores: DataFrame, sizes: DataFrame, k: int, min_len: int) -> DataFrame:
    """Repeated maxima away from both edges; each masks all within min_len."""
    rows = scores.join(sizes, "seq_id").where((F.col("boundary") >= min_len) & (F.col("boundary") <= F.col("n") - min_len)).drop("n")
    return fold(ranked(rows), lambda acc, b: apart(acc, b, min_len), F.lit(k)).select("seq_id", F.explode("kept").alias("boundary"))


def min_segment_filter(boundaries: DataFrame, sizes: DataFrame, least: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """While some segment is shorter than `least`, the first shortest loses a boundary: the first segment its right one, the last its left one, others the left one
    or, with scores, the weaker (left on a tie). As many steps as boundaries, which is the fold's length."""
    pair = F.struct(F.col("boundary").cast("int").alias("b"), (F.coalesce("score", F.lit(0.0)) if scores is not None else F.lit(0.0)).alias("s"))
    rows = boundaries.join(scores, ["seq_id", "boundary"], "left") if scores is not None else boundaries
    rows = rows.groupBy("seq_id").agg(F.array_sort(F.collect_set(pair)).alias("kept")).join(sizes, "seq_id")

    def without_one(acc, lengths, i):
        weaker = F.element_at(acc, i)["s"] < F.element_at(acc, i - 1)["s"] if scores is not None else F.lit(False)
        drop = F.when(i == 1, 1).when(i == F.size(lengths), F.size(acc)).when(F.when((i > 1) & (i <= F.size(acc)), weaker).otherwise(False), i).otherwise(i - 1)
        return bound(drop, lambda d: F.filter(acc, lambda x, j: j + 1 != d))

    def shortened(acc, lengths):
        found = lambda short: F.when((F.size(acc) > 0) & (short < least), bound(F.array_position(lengths, short).cast("int"), lambda i: without_one(acc, lengths, i))).otherwise(acc)
        return bound(F.array_min(lengths), found)

    def step(acc, _):
        edges = F.concat(F.array(F.lit(0)), F.transform(acc, lambda x: x["b"]), F.array(F.col("n").cast("int")))
        lengths = lambda e: F.transform(F.slice(e, 2, F.size(acc) + 1), lambda x, i: x - F.element_at(e, i + 1))
        return bound(edges, lambda e: bound(lengths(e), lambda z: shortened(acc, z)))

    out = rows.withColumn("kept", F.aggregate(F.col("kept"), F.col("kept"), step))
    return out.select("seq_id", F.explode("kept.b").alias("boundary"))


def local_shift(boundaries: DataFrame, similarity: DataFrame, window: int = 2) -> DataFrame:
    """Each boundary moves to the least adjacent similarity (seq_id, boundary, similarity) within the window; distinct. The band is an equi join on offsets."""
    near = boundaries.select("seq_id", "boundary", F.explode(F.sequence(F.col("boundary") - window, F.col("boundary") + window)).alias("at"))
    hits = near.join(similarity.select("seq_id", F.col("boundary").alias("at"), "similarity"), ["seq_id", "at"])
    moved = hits.groupBy("seq_id", "boundary").agg(F.min_by("at", F.struct("similarity", F.abs(F.col("at") - F.col("boundary")), "at")).alias("to"))
    return moved.select("seq_id", F.col("to").alias("boundary")).distinct()


def sustained(changes: DataFrame, least: int = 5) -> DataFrame:
    """Boundaries of label changes (seq_id, boundary) that come at least `least` units after the one kept before them."""
    rows = changes.groupBy("seq_id").agg(F.array_sort(F.collect_set(F.col("boundary").cast("int"))).alias("ranked"))
    step = lambda acc, b: F.when((F.size(acc) == 0) | (b - F.element_at(acc, -1) >= least), F.array_append(acc, b)).otherwise(acc)
    first = F.when(F.size("ranked") > 0, F.slice("ranked", 1, 1)).otherwise(none())
    out = rows.withColumn("kept", F.aggregate(F.slice(F.col("ranked"), 2, F.greatest(F.lit(1), F.size("ranked"))), first, step))
    return out.select("seq_id", F.explode("kept").alias("boundary"))


def between_anchors(anchors: DataFrame, scores: DataFrame, k: int, min_len: int) -> DataFrame:
    """The anchors, and the best other boundaries outside min_len of them, k in all."""
    near = anchors.select("seq_id", F.explode(F.sequence(F.col("boundary") - min_len, F.col("boundary") + min_len)).alias("boundary")).distinct()
    free = scores.join(near, ["seq_id", "boundary"], "left_anti")
    n = anchors.groupBy("seq_id").agg(F.count("*").alias("_n"))
    extra = free.join(n, "seq_id", "left").withColumn("_r", F.row_number().over(best_first())).where(F.col("_r") <= k - F.coalesce("_n", F.lit(0)))
    return anchors.select("seq_id", "boundary").union(extra.select("seq_id", "boundary")).distinct()


def peaks(scores: DataFrame, distance: int = 1, least: int | None = None) -> DataFrame:
    """(seq_id, boundary, score): local maxima, a flat top counted once at its middle (the left of two), neither at the first nor at the last boundary of a sequence; of those
    closer than `distance` the higher stays, the later one of equals. `least` keeps only so many of the highest, the later ones of equals."""
    order = Window.partitionBy("seq_id").orderBy("boundary")
    flat = F.sum(F.when(F.col("score") == F.lag("score").over(order), 0).otherwise(1)).over(order)
    runs = scores.select("seq_id", F.col("boundary").cast("int").alias("boundary"), "score").withColumn("_at", F.row_number().over(order)).withColumn("_run", flat)
    tops = runs.groupBy("seq_id", "_run").agg(F.first("score").alias("score"), F.min("_at").alias("_a"), F.max("_at").alias("_z"), F.sort_array(F.collect_list("boundary")).alias("_b"))
    along = Window.partitionBy("seq_id").orderBy("_run")
    middle = F.element_at("_b", F.floor((F.col("_a") + F.col("_z")) / 2).cast("int") - F.col("_a") + 1)
    tops = tops.select("seq_id", middle.alias("boundary"), "score", ((F.col("score") > F.lag("score").over(along)) & (F.col("score") > F.lead("score").over(along))).alias("_top")).where("_top")
    high = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("boundary")).alias("b")))).alias("_p")
    rows = tops.groupBy("seq_id").agg(high).select("seq_id", F.transform("_p", lambda x: -x["b"]).alias("ranked"))
    kept = fold(rows, lambda acc, b: apart(acc, b, distance, inclusive=False)).select("seq_id", F.explode("kept").alias("boundary"))
    out = tops.select("seq_id", "boundary", "score").join(kept, ["seq_id", "boundary"])
    if least is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("score"), F.desc("boundary")))).where(F.col("_r") <= least).drop("_r")
