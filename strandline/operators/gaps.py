"""Gap scores and smoothing over ordered vectors. A boundary b means that a segment starts at unit b; its gap is b - 1.

Frames are ROWS frames partitioned by sequence, so each sequence is sorted once and all frames over it share that exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import vectors as V


def in_order() -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy("pos")


def frame(column: str, a: int, b: int) -> Column:
    return F.collect_list(column).over(in_order().rowsBetween(a, b))


def smooth(units: DataFrame, window: int, vec: str = "vec") -> DataFrame:
    """Mean of rows pos - w//2 .. pos + w//2, clamped, at length one. No change for windows up to 1."""
    if window <= 1:
        return units
    h = window // 2
    size = F.count("*").over(Window.partitionBy("seq_id"))
    return units.withColumn(vec, F.when(size < 2, F.col(vec)).otherwise(V.unit(V.mean_of(frame(vec, -h, h)))))


def smooth_gaussian(units: DataFrame, window: int, sigma: float, vec: str = "vec") -> DataFrame:
    """Weights exp(-d^2 / 2 sigma^2) over the clamped frame, renormalised at the edges, at length one."""
    h = window // 2
    rows = F.collect_list(F.struct("pos", vec)).over(in_order().rowsBetween(-h, h))
    weight = lambda p: F.exp(-0.5 * F.pow((p - F.col("pos")) / F.lit(sigma), 2))
    scaled = F.transform("_rows", lambda r: V.scale(r[vec], weight(r["pos"])))
    return units.withColumn("_rows", rows).withColumn(vec, V.unit(V.sum_of(scaled))).drop("_rows")  # length one makes the weights' sum drop out


def boundaries_of(units: DataFrame, score: Column, name: str = "score") -> DataFrame:
    """(seq_id, boundary, score) of every unit but the first."""
    return units.select("seq_id", F.col("pos").alias("boundary"), score.alias(name)).where("boundary > 0")


def gap_adjacent(units: DataFrame) -> DataFrame:
    """1 - cosine of neighbouring units."""
    return boundaries_of(units.withColumn("_p", F.lag("vec").over(in_order())), 1 - V.cosine(F.col("_p"), F.col("vec")))


def gap_overlapping(units: DataFrame, w: int) -> DataFrame:
    """1 - cosine of the means of rows b-1-w..b-1+w and b-w..b+w; the two overlap by design."""
    both = units.withColumn("_l", V.mean_of(frame("vec", -1 - w, -1 + w))).withColumn("_r", V.mean_of(frame("vec", -w, w)))
    return boundaries_of(both, 1 - V.cosine(F.col("_l"), F.col("_r")))


def gap_one_sided(units: DataFrame, w: int) -> DataFrame:
    """1 - cosine of the means of the w rows before a boundary and the w from it on."""
    both = units.withColumn("_l", V.mean_of(frame("vec", -w, -1))).withColumn("_r", V.mean_of(frame("vec", 0, w - 1)))
    return boundaries_of(both, 1 - V.cosine(F.col("_l"), F.col("_r")))


def gaps_together(units: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(seq_id, boundary, adj, win<w> for each window): `gap_adjacent` and `gap_one_sided` as columns, whose frames share one sort of each sequence."""
    rows = units.select("seq_id", "pos", "vec", F.lag("vec").over(in_order()).alias("_p"), *(f for w in windows for f in (frame("vec", -w, -1).alias(f"_l{w}"), frame("vec", 0, w - 1).alias(f"_r{w}"))))
    each = [(1 - V.cosine(V.mean_of(F.col(f"_l{w}")), V.mean_of(F.col(f"_r{w}")))).alias(f"win{w}") for w in windows]
    return rows.where("pos > 0").select("seq_id", F.col("pos").alias("boundary"), (1 - V.cosine(F.col("_p"), F.col("vec"))).alias("adj"), *each)


def gap_cross_block(units: DataFrame, w: int) -> DataFrame:
    """Mean of all dot products between the w rows on either side: the dot product of the two means."""
    both = units.withColumn("_l", V.mean_of(frame("vec", -w, -1))).withColumn("_r", V.mean_of(frame("vec", 0, w - 1)))
    return boundaries_of(both, V.dot(F.col("_l"), F.col("_r")), "similarity")


def gap_recency(units: DataFrame, w: int, decay: float = 0.5) -> DataFrame:
    """1 - cosine of the w // 2 + 1 rows on either side, each weighted exp(-decay * d) by distance d from the gap."""
    m = w // 2 + 1

    def side(a: int, b: int, distance) -> Column:
        rows = F.collect_list(F.struct("pos", "vec")).over(in_order().rowsBetween(a, b))
        return V.sum_of(F.transform(rows, lambda r: V.scale(r["vec"], F.exp(-decay * distance(r["pos"])))))

    both = units.withColumn("_l", side(-m, -1, lambda p: F.col("pos") - 1 - p)).withColumn("_r", side(0, m - 1, lambda p: p - F.col("pos")))
    return boundaries_of(both, 1 - V.cosine(F.col("_l"), F.col("_r")))


def along() -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy("boundary")


def every() -> WindowSpec:
    return Window.partitionBy("seq_id")


def depth_global(similarity: DataFrame) -> DataFrame:
    """Depth below the highest similarity on either side, over (seq_id, boundary, similarity)."""
    before = F.max("similarity").over(along().rowsBetween(Window.unboundedPreceding, 0))
    after = F.max("similarity").over(along().rowsBetween(0, Window.unboundedFollowing))
    return similarity.select("seq_id", "boundary", (before + after - 2 * F.col("similarity")).alias("score"))


def local_maxima(scores: DataFrame) -> DataFrame:
    """Scores above 0 that are at least the one before and above the one after; the ends have no neighbour to exceed."""
    before, after = F.lag("score").over(along()), F.lead("score").over(along())
    return scores.withColumn("is_peak", (F.col("score") > 0) & F.coalesce(F.col("score") >= before, F.lit(False)) & F.coalesce(F.col("score") > after, F.lit(False)))


def moving_average(scores: DataFrame) -> DataFrame:
    """Three-tap mean of interior scores; the ends stay."""
    before, after = F.lag("score").over(along()), F.lead("score").over(along())
    return scores.withColumn("score", F.coalesce((before + F.col("score") + after) / 3, F.col("score")))


KERNEL = (0.054, 0.242, 0.399, 0.242, 0.054)  # fixed values


def kernel_smooth(scores: DataFrame) -> DataFrame:
    """Five-tap convolution with zeros beyond the ends."""
    taps = [F.coalesce(F.lag("score", 2).over(along()), F.lit(0.0)), F.coalesce(F.lag("score", 1).over(along()), F.lit(0.0)), F.col("score"), F.coalesce(F.lead("score", 1).over(along()), F.lit(0.0)), F.coalesce(F.lead("score", 2).over(along()), F.lit(0.0))]
    return scores.withColumn("score", sum((k * t for k, t in zip(KERNEL[1:], taps[1:], strict=True)), KERNEL[0] * taps[0]))


def gaussian_filter(scores: DataFrame, sigma: float = 1.5, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter that reflects at the ends: d c b a | a b c d | d c b a."""
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    k = [x / sum(k) for x in k]
    rows = scores.withColumn("_s", F.array_sort(F.collect_list(F.struct("boundary", "score")).over(every()))).withColumn("_n", F.size("_s"))
    i = F.row_number().over(along()) - 1
    place = lambda d: F.pmod(F.col("_i") + d, 2 * F.col("_n"))
    mirrored = lambda d: F.when(place(d) < F.col("_n"), place(d)).otherwise(2 * F.col("_n") - 1 - place(d))
    total = None
    for d, w in zip(range(-r, r + 1), k, strict=True):
        x = F.element_at("_s", (mirrored(d) + 1).cast("int"))["score"] * w
        total = x if total is None else total + x
    return rows.withColumn("_i", i).withColumn("score", total).drop("_s", "_n", "_i")


def minmax(scores: DataFrame, column: str = "score", flat: float | None = 0.0) -> DataFrame:
    """To 0..1 within a sequence. A flat series becomes `flat`, or stays as it is for None."""
    low, high = F.min(column).over(every()), F.max(column).over(every())
    return scores.withColumn(column, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.col(column) if flat is None else F.lit(flat)))


def chunk_means(units: DataFrame, size: int) -> DataFrame:
    """Means of every `size` units: (seq_id, pos, vec) with pos the chunk's number."""
    c = units.groupBy("seq_id", F.expr(f"pos div {size}").cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("_r"))
    return c.select("seq_id", F.col("chunk").alias("pos"), V.mean_of(F.col("_r.vec")).alias("vec"))


def chunk_to_units(boundaries: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Chunk boundaries as boundaries of units, clamped and distinct."""
    b = boundaries.join(sizes, "seq_id")
    return b.select("seq_id", F.greatest(F.lit(1), F.least(F.col("boundary") * size, F.col("n") - 1)).alias("boundary")).distinct()


def block_text(units: DataFrame, window: int) -> DataFrame:
    """Texts of the units around each, joined."""
    h = window // 2
    return units.withColumn("text", F.concat_ws(" ", F.collect_list("text").over(in_order().rowsBetween(-h, h))))


def chunk_plan(sizes: DataFrame, size: int = 80, overlap: int = 15) -> DataFrame:
    """Overlapping chunks (seq_id, chunk, start, end) that cover a sequence."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 1 - overlap), F.lit(step))
    return sizes.select("seq_id", "n", F.posexplode(starts).alias("chunk", "start")).select("seq_id", "chunk", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def label_changes(units: DataFrame, label: str = "label") -> DataFrame:
    """Boundaries where a label differs from the one before."""
    return units.withColumn("_p", F.lag(label).over(in_order())).where((F.col("pos") > 0) & (F.col("_p") != F.col(label))).select("seq_id", F.col("pos").alias("boundary"))
