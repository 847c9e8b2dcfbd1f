"""Alignment of timed streams with ordered units: as-of, nearest, containment, overlap and band joins.

Units are (seq_id, pos, start, end) in integer time, sorted and half-open; marks are (seq_id, event_id, us). Every join has seq_id as its equi key.
As-of joins are one union and one window over both sides, linear in their rows; no inequality join is left to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(units: DataFrame, marks: DataFrame, unit_time: str = "start", unit_first: bool = True) -> DataFrame:
    """Units and marks in one time order. At equal times units come first or last."""
    u = units.select("seq_id", F.col(unit_time).alias("t"), F.lit(0 if unit_first else 2).alias("kind"), F.col("pos").cast("int").alias("pos"), F.lit(None).cast("long").alias("event_id"))
    m = marks.select("seq_id", F.col("us").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pos"), "event_id")
    return u.union(m)


def by_time(reverse: bool = False):
    cols = ["t", "kind", "pos", "event_id"]
    return Window.partitionBy("seq_id").orderBy(*[F.desc(c) if reverse else F.asc(c) for c in cols])


def asof_backward(units: DataFrame, marks: DataFrame, unit_time: str = "start") -> DataFrame:
    """(seq_id, event_id, pos): the last unit that starts at or before a mark; null before the first."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return merged(units, marks, unit_time).withColumn("at", F.last("pos", ignorenulls=True).over(w)).where("kind = 1").select("seq_id", "event_id", F.col("at").alias("pos"))


def count_before(units: DataFrame, marks: DataFrame, unit_time: str, inclusive: bool) -> DataFrame:
    """(seq_id, event_id, i): how many units start before a mark, or at it too. It is the forward as-of position."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return merged(units, marks, unit_time, unit_first=inclusive).withColumn("i", F.count("pos").over(w)).where("kind = 1").select("seq_id", "event_id", "i")


def nearest(units: DataFrame, marks: DataFrame, unit_time: str = "start") -> DataFrame:
    """(seq_id, event_id, pos): the unit nearest in time, the smaller position on a tie. Of equal times the first unit counts."""
    first = units.groupBy("seq_id", F.col(unit_time).alias("t")).agg(F.min("pos").alias("pos")).select("seq_id", F.col("t").alias(unit_time), "pos")
    rows = merged(first, marks, unit_time)
    pair = F.when(F.col("pos").isNotNull(), F.struct("t", "pos"))
    back, ahead = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time(True).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("b", F.last(pair, ignorenulls=True).over(back)).withColumn("a", F.last(pair, ignorenulls=True).over(ahead)).where("kind = 1")
    d = lambda x: F.abs(F.col(x + ".t") - F.col("t"))
    side = lambda x: F.when(F.col(x).isNotNull(), F.struct(d(x).alias("d"), F.col(x + ".pos").alias("pos")))
    return rows.select("seq_id", "event_id", F.least(side("b"), side("a"))["pos"].alias("pos"))


def clamp(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(i, n - 1))


MODES = ("start_left", "start_right", "start_nearest", "center_left", "center_nearest", "contains_before", "contains_after")


def aligned(units: DataFrame, marks: DataFrame, skip_first: bool = False) -> DataFrame:
    """(seq_id, mode, boundary) of each mark in all seven modes, clamped and distinct. Without units there is nothing to align to.

    start_left and start_right count the units that start before, or up to, the mark; center_left does so for centres; the nearest modes take
    the nearest start or centre; the contains modes take the first unit with start <= t <= end, or the one after it, and fall back on start_left."""
    n = units.groupBy("seq_id").agg(F.count("*").cast("int").alias("n"))
    mid = units.withColumn("mid", F.col("start") + F.col("end"))  # twice the centre, so that it stays an integer
    twice = marks.withColumn("us", F.col("us") * 2)
    if skip_first:
        w = Window.partitionBy("seq_id").orderBy("us", "event_id")
        keep = marks.withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")
        return aligned(units, keep)
    key = ["seq_id", "event_id"]
    left, right = count_before(units, marks, "start", False), count_before(units, marks, "start", True)
    # Sorted, half-open units: those with start <= t <= end are the last that starts by t and, where it ends just then, the one before.
    ends = units.select("seq_id", F.col("pos").alias("p"), "end")
    within = right.join(marks, key).withColumn("p", F.explode(F.array((F.col("i") - 2).cast("int"), (F.col("i") - 1).cast("int")))).join(ends, ["seq_id", "p"]).where("us <= end")
    within = within.groupBy(*key).agg(F.min("p").alias("hit"))
    rows = left.withColumnRenamed("i", "start_left").join(right.withColumnRenamed("i", "start_right"), key)
    rows = rows.join(nearest(units, marks).withColumnRenamed("pos", "start_nearest"), key)
    rows = rows.join(count_before(mid, twice, "mid", False).withColumnRenamed("i", "center_left"), key)
    rows = rows.join(nearest(mid, twice, "mid").withColumnRenamed("pos", "center_nearest"), key)
    rows = rows.join(within, key, "left").withColumn("contains_before", F.coalesce("hit", "start_left")).withColumn("contains_after", F.coalesce(F.col("hit") + 1, "start_left"))
    long = rows.join(n, "seq_id").where("n > 1").select("seq_id", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).cast("int").alias("i")) for m in MODES])).alias("x"))
    return long.select("seq_id", F.col("x.mode").alias("mode"), clamp(F.col("x.i"), F.col("n")).alias("boundary")).distinct()


def assign_contained(units: DataFrame, marks: DataFrame) -> DataFrame:
    """(seq_id, event_id, pos): the first unit with start <= t < end, else the unit with the nearest centre."""
    last = asof_backward(units, marks).join(marks, ["seq_id", "event_id"]).join(units.select("seq_id", F.col("pos"), "end"), ["seq_id", "pos"], "left")
    inside = last.select("seq_id", "event_id", F.when(F.col("us") < F.col("end"), F.col("pos")).alias("hit"))
    mid = units.withColumn("mid", F.col("start") + F.col("end"))
    near = nearest(mid, marks.withColumn("us", F.col("us") * 2), "mid")
    return inside.join(near, ["seq_id", "event_id"]).select("seq_id", "event_id", F.coalesce("hit", "pos").alias("pos"))


def assign_mean(units: DataFrame, marks: DataFrame) -> DataFrame:
    """(seq_id, pos, n_marks, mean_value, max_value): marks' values by their unit; 0 without, and maxima start at 0."""
    got = assign_contained(units, marks).join(marks, ["seq_id", "event_id"]).groupBy("seq_id", "pos").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x"))
    rows = units.select("seq_id", "pos").join(got, ["seq_id", "pos"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("seq_id", "pos", F.coalesce("n", F.lit(0)).alias("n_marks"), zero("m").alias("mean_value"), F.greatest(F.lit(0.0), zero("x")).alias("max_value"))


def assign_vectors(units: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(seq_id, pos, n_marks, mean, max): element-wise means and maxima of the vectors (seq_id, event_id, us, vec) of each unit's marks; zeros without marks, and maxima start at 0.

    Vectors are added up component by component where they lie and only sums are shuffled: 2 * width numbers for each unit a task has marks of."""
    x = lambda i: F.col("vec")[i].cast("double")
    got = assign_contained(units, marks).join(marks.select("seq_id", "event_id", "vec"), ["seq_id", "event_id"])
    sums = got.groupBy("seq_id", "pos").agg(F.count("*").alias("n"), *(F.sum(x(i)).alias(f"s_{i}") for i in range(width)), *(F.max(x(i)).alias(f"x_{i}") for i in range(width)))
    rows = units.select("seq_id", "pos").join(sums, ["seq_id", "pos"], "left")
    mean = F.array(*(F.coalesce(F.col(f"s_{i}") / F.col("n"), F.lit(0.0)) for i in range(width)))
    most = F.array(*(F.greatest(F.lit(0.0), F.coalesce(f"x_{i}", F.lit(0.0))) for i in range(width)))
    return rows.select("seq_id", "pos", F.coalesce("n", F.lit(0)).alias("n_marks"), mean.alias("mean"), most.alias("max"))


def overlapping(units: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """(seq_id, span, n_units, first_pos, last_pos): units that meet each span (seq_id, span, s, e). Time buckets make the range an equi join; a pair that
    shares several buckets counts in the first."""
    b = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket)))
    u = units.where("end > start").withColumn("bucket", b("start", "end"))
    s = spans.where("e > s").withColumn("bucket", b("s", "e"))
    met = u.join(s, ["seq_id", "bucket"]).where((F.col("end") > F.col("s")) & (F.col("start") < F.col("e")) & (F.col("bucket") == F.floor(F.greatest("start", "s") / bucket)))
    return met.groupBy("seq_id", "span").agg(F.count("*").alias("n_units"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def within_band(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """The boundaries of `a` that have one of `b` within the tolerance: a semi join on exploded offsets."""
    wide = b.select("seq_id", F.explode(F.sequence(F.col("boundary") - tolerance, F.col("boundary") + tolerance)).alias("boundary")).distinct()
    return a.join(wide, ["seq_id", "boundary"], "left_semi")


def nearest_within(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """(seq_id, boundary, nearest): for each of `a` the nearest of `b` within the tolerance, the smaller on a tie, else null."""
    wide = b.select("seq_id", F.col("boundary").alias("other"), F.explode(F.sequence(F.col("boundary") - tolerance, F.col("boundary") + tolerance)).alias("boundary"))
    near = wide.groupBy("seq_id", "boundary").agg(F.min_by("other", F.struct(F.abs(F.col("other") - F.col("boundary")), "other")).alias("nearest"))
    return a.select("seq_id", "boundary").join(near, ["seq_id", "boundary"], "left")


def nested(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(seq_id, inner, outer): the outer segment (seq_id, ord, start, end) that holds each inner one wholly, by as-of on starts."""
    w = Window.partitionBy("seq_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = outer.select("seq_id", "ord", "start", "end", F.lit(0).alias("kind")).union(inner.select("seq_id", "ord", "start", "end", F.lit(1).alias("kind")))
    rows = both.withColumn("o", F.last(F.when(F.col("kind") == 0, F.struct("ord", "end")), ignorenulls=True).over(w)).where("kind = 1 and o.end >= end")
    return rows.select("seq_id", F.col("ord").alias("inner"), F.col("o.ord").alias("outer"))


def pauses(units: DataFrame, threshold: int = 0) -> DataFrame:
    """(seq_id, pos, pause): time from a unit's end to the next start, not below 0; 0 after the last. Only pauses of at least the threshold."""
    gap = F.greatest(F.lit(0), F.coalesce(F.lead("start").over(Window.partitionBy("seq_id").orderBy("pos")) - F.col("end"), F.lit(0)))
    return units.select("seq_id", "pos", gap.alias("pause")).where(F.col("pause") >= threshold)
