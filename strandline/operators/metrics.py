"""Segmentation metrics. Hypotheses and references are (seq_id, boundary) rows; sizes are (seq_id, n).

Sequences without a boundary on a side count too: results have a row for each sequence of `sizes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..functions.vectors import let
from ..sources.stored import stored


def inside(boundaries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct integer boundaries with 0 < b < n, and n."""
    return boundaries.withColumn("boundary", F.col("boundary").cast("int")).join(sizes, "seq_id").where("boundary > 0 and boundary < n").select("seq_id", "boundary").distinct()


def counted(hyp: DataFrame, ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, n, p, ch, cr, k): boundaries up to each position on either side, and the metrics' window."""
    both = inside(hyp, sizes).withColumn("h", F.lit(1)).withColumn("r", F.lit(0)).union(inside(ref, sizes).withColumn("h", F.lit(0)).withColumn("r", F.lit(1)))
    marks = both.groupBy("seq_id", "boundary").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    refs = inside(ref, sizes).groupBy("seq_id").agg(F.count("*").alias("refs"))
    rows = sizes.join(refs, "seq_id", "left").withColumn("k", F.greatest(F.lit(1), half_even(F.col("n") / (F.coalesce("refs", F.lit(0)) + 1) / 2).cast("int")))
    rows = rows.select("seq_id", "n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    rows = rows.join(marks.withColumnRenamed("boundary", "p"), ["seq_id", "p"], "left")
    w = Window.partitionBy("seq_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ch", F.coalesce(F.sum("h").over(w), F.lit(0))).withColumn("cr", F.coalesce(F.sum("r").over(w), F.lit(0)))


def pk_wd(hyp: DataFrame, ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, k, pk, wd): shares of windows [i, i + k] whose having any, or number of, boundaries differs. 0 where no window fits.

    The window's other end is k rows ahead and k varies, so it is an equi self-join on the position."""
    c = counted(hyp, ref, sizes)
    ahead = c.select("seq_id", (F.col("p") - F.col("k")).alias("p"), F.col("ch").alias("ch2"), F.col("cr").alias("cr2"))
    rows = c.join(ahead, ["seq_id", "p"], "left")
    dh, dr = F.col("ch2") - F.col("ch"), F.col("cr2") - F.col("cr")
    wrong = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return rows.groupBy("seq_id").agg(F.max("k").alias("k"), wrong((dh > 0) != (dr > 0)).alias("pk"), wrong(dh != dr).alias("wd"))


def boundary_similarity(hyp: DataFrame, ref: DataFrame, sizes: DataFrame, n: int = 2) -> DataFrame:
    """(seq_id, bs): mean of both directed means of 1 - d / (n + 1) for the nearest counterpart within n."""
    a, b = inside(hyp, sizes), inside(ref, sizes)

    def directed(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        near = x.withColumn("at", F.explode(F.sequence(F.col("boundary") - n, F.col("boundary") + n)))  # the band as equi keys
        hits = near.join(y.select("seq_id", F.col("boundary").alias("at"), F.lit(True).alias("hit")), ["seq_id", "at"], "left")
        score = F.max(F.when(F.col("hit"), 1 - F.abs(F.col("at") - F.col("boundary")) / (n + 1.0)).otherwise(0.0))
        return hits.groupBy("seq_id", "boundary").agg(score.alias("s")).groupBy("seq_id").agg(F.avg("s").alias(name))

    rows = sizes.select("seq_id").join(directed(a, b, "h"), "seq_id", "left").join(directed(b, a, "r"), "seq_id", "left")
    return rows.select("seq_id", F.when(F.col("h").isNull() & F.col("r").isNull(), 1.0).when(F.col("h").isNull() | F.col("r").isNull(), 0.0).otherwise((F.col("h") + F.col("r")) / 2).alias("bs"))


def lists(hyp: DataFrame, ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, n, hyp, ref) as rising arrays."""
    group = lambda x, name: inside(x, sizes).groupBy("seq_id").agg(F.array_sort(F.collect_list("boundary")).alias(name))
    none = F.array().cast("array<int>")
    rows = sizes.join(group(hyp, "hyp"), "seq_id", "left").join(group(ref, "ref"), "seq_id", "left")
    return rows.withColumn("hyp", F.coalesce("hyp", none)).withColumn("ref", F.coalesce("ref", none))


def matched(rows: DataFrame, tolerance: int) -> DataFrame:
    """Adds the references that rising hypotheses take, each the smallest free one within the tolerance."""
    free = lambda acc, h: F.filter("ref", lambda r: (F.abs(r - h) <= tolerance) & ~F.array_contains(acc, r))
    step = lambda acc, h: F.when(F.size(free(acc, h)) > 0, F.array_append(acc, F.element_at(free(acc, h), 1))).otherwise(acc)
    return rows.withColumn("taken", F.aggregate("hyp", F.array().cast("array<int>"), step))


def tolerance_f1(hyp: DataFrame, ref: DataFrame, sizes: DataFrame, tolerance: int = 2) -> DataFrame:
    """(seq_id, tp, precision, recall, f1). Both sides empty: all 1; one empty: all 0."""
    rows = matched(lists(hyp, ref, sizes), tolerance)
    tp, h, r = F.size("taken"), F.size("hyp"), F.size("ref")
    share = lambda d: F.when((h == 0) & (r == 0), 1.0).when((h == 0) | (r == 0), 0.0).otherwise(tp / d)
    rows = rows.select("seq_id", tp.alias("tp"), share(h).alias("precision"), share(r).alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0))


def hierarchical_wd(chapters: DataFrame, subtopics: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * WD of chapters + (1 - alpha) * WD of subtopics, from two results of pk_wd."""
    return chapters.select("seq_id", F.col("wd").alias("c")).join(subtopics.select("seq_id", F.col("wd").alias("s")), "seq_id").select("seq_id", (alpha * F.col("c") + (1 - alpha) * F.col("s")).alias("h_wd"))


def evaluate(hyp: DataFrame, ref: DataFrame, sizes: DataFrame, tolerances: tuple[int, ...] = (1, 2, 3, 5), near: int = 2) -> DataFrame:
    """All metrics of each sequence, equal to the single ones: both sides are gathered once as arrays, and the metrics are expressions over them, so that a bundle
    costs no shuffle more than one metric. A sequence's boundaries must fit a row, and windows cost its length times its boundaries."""
    rows = lists(hyp, ref, sizes).withColumn("k", F.greatest(F.lit(1), half_even(F.col("n") / (F.size("ref") + 1) / 2).cast("int")))
    upto = lambda b: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.size(F.filter(b, lambda x: x <= p)))
    rows = rows.withColumn("_h", upto("hyp")).withColumn("_r", upto("ref"))
    ahead = lambda c, i: F.element_at(c, i + F.col("k")) - F.element_at(c, i)
    starts = F.when(F.col("n") > F.col("k"), F.sequence(F.lit(1), F.col("n") - F.col("k"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_w", F.transform(starts, lambda i: F.struct(ahead("_h", i).alias("h"), ahead("_r", i).alias("r"))))
    share = lambda wrong: F.coalesce(F.try_divide(F.size(F.filter("_w", wrong)), F.size("_w")), F.lit(0.0))
    score = lambda x, others: F.aggregate(others, F.lit(0.0), lambda m, y: F.greatest(m, F.when(F.abs(x - y) <= near, 1 - F.abs(x - y) / (near + 1.0)).otherwise(0.0)))
    mean = lambda a, b: F.aggregate(a, F.lit(0.0), lambda t, x: t + score(x, b)) / F.size(a)
    h, r = F.size("hyp"), F.size("ref")
    bs = F.when((h == 0) & (r == 0), 1.0).when((h == 0) | (r == 0), 0.0).otherwise((mean("hyp", "ref") + mean("ref", "hyp")) / 2)
    out = ["seq_id", "k", share(lambda w: (w["h"] > 0) != (w["r"] > 0)).alias("pk"), share(lambda w: w["h"] != w["r"]).alias("wd"), bs.alias("bs")]
    for t in tolerances:
        rows = matched(rows, t).withColumnRenamed("taken", f"_t{t}")
        tp = F.size(f"_t{t}")
        of = lambda d, tp=tp: F.when((h == 0) & (r == 0), 1.0).when((h == 0) | (r == 0), 0.0).otherwise(tp / d)
        f1 = F.when((h == 0) & (r == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * tp, h + r), F.lit(0.0)))
        out += [of(h).alias(f"precision_t{t}"), of(r).alias(f"recall_t{t}"), f1.alias(f"f1_t{t}")]
    return rows.select(*out)


def expected(ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, n, width, met): the metrics' window, and the reference's boundaries in each window (p, p + width], for `missed`."""
    none = F.array().cast("array<int>")
    rows = sizes.join(inside(ref, sizes).groupBy("seq_id").agg(F.collect_list("boundary").alias("ref")), "seq_id", "left").withColumn("ref", F.coalesce("ref", none))
    rows = rows.withColumn("width", F.greatest(F.lit(1), half_even(F.col("n") / (F.size("ref") + 1) / 2).cast("int")))
    starts = F.when(F.col("n") > F.col("width"), F.sequence(F.lit(0), F.col("n") - F.col("width") - 1)).otherwise(none)
    return rows.select("seq_id", "n", "width", F.transform(starts, lambda p: F.size(F.filter("ref", lambda x: (x > p) & (x <= p + F.col("width"))))).alias("met"))


def missed(hyp: Column, width: Column, met: Column) -> Column:
    """(pk, wd) of distinct boundaries inside a sequence, equal to those of `pk_wd`. What the reference gives is made once by `expected`, however many hypotheses a sequence has."""
    share = lambda w, wrong: F.coalesce(F.try_divide(F.size(F.filter(w, wrong)), F.size(w)), F.lit(0.0))
    both = lambda w: F.struct(share(w, lambda x: (x["h"] > 0) != (x["r"] > 0)).alias("pk"), share(w, lambda x: x["h"] != x["r"]).alias("wd"))
    seen = lambda h: F.transform(met, lambda r, p: F.struct(F.size(F.filter(h, lambda x: (x > p) & (x <= p + width))).alias("h"), r.alias("r")))
    return let(hyp, lambda h: let(seen(h), both))


def error_taxonomy(hyp: DataFrame, ref: DataFrame, sizes: DataFrame, tolerance: int = 2) -> DataFrame:
    """(seq_id, tp, near, fp, fn, over, under). Rising hypotheses: an exact hit is right and marks its reference; else the nearest unmarked reference
    within the tolerance makes a near miss, which is right too; else wrong. References left unmarked are missed."""
    start = F.struct(F.array().cast("array<int>").alias("marked"), F.lit(0).alias("tp"), F.lit(0).alias("near"), F.lit(0).alias("fp"))

    def step(acc, h):
        exact = F.array_contains("ref", h)
        free = F.filter("ref", lambda r: (F.abs(r - h) <= tolerance) & ~F.array_contains(acc["marked"], r))
        nearest = F.array_min(F.transform(free, lambda r: F.struct(F.abs(r - h).alias("d"), r.alias("r"))))["r"]
        take = F.when(exact, h).otherwise(nearest)
        hit = take.isNotNull()
        return F.struct(
            F.when(hit, F.array_union(acc["marked"], F.array(take))).otherwise(acc["marked"]).alias("marked"),
            (acc["tp"] + hit.cast("int")).alias("tp"),
            (acc["near"] + (hit & ~exact).cast("int")).alias("near"),
            (acc["fp"] + (~hit).cast("int")).alias("fp"),
        )

    rows = lists(hyp, ref, sizes).withColumn("e", F.aggregate("hyp", start, step))
    h, r = F.size("hyp"), F.size("ref")
    return rows.select("seq_id", "e.tp", "e.near", "e.fp", (r - F.size("e.marked")).alias("fn"), (h > 1.5 * r).alias("over"), (h < 0.5 * r).alias("under"))


def taxonomy_summary(errors: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and F1 over sequences, and how many are over- or under-segmented."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    rows = errors.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    s = lambda c: F.sum(c)
    one = rows.agg(F.coalesce(F.try_divide(s("tp"), s("tp") + s("fp")), F.lit(0.0)).alias("micro_precision"), F.coalesce(F.try_divide(s("tp"), s("tp") + s("fn")), F.lit(0.0)).alias("micro_recall"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"), F.count_if("over").alias("n_over"), F.count_if("under").alias("n_under"))
    p, r = F.col("micro_precision"), F.col("micro_recall")
    return one.withColumn("micro_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def kappa_asym(a: DataFrame, b: DataFrame, sizes: DataFrame, tolerance: int = 1) -> DataFrame:
    """(seq_id, kappa): Cohen's kappa of unit-wise marks, where only the second annotator's are widened by the tolerance."""
    marks_a = inside(a, sizes).select("seq_id", F.col("boundary").alias("p"), F.lit(1).alias("a"))
    wide = inside(b, sizes).select("seq_id", F.explode(F.sequence(F.col("boundary") - tolerance, F.col("boundary") + tolerance)).alias("p")).distinct().withColumn("b", F.lit(1))
    rows = sizes.select("seq_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p")).join(marks_a, ["seq_id", "p"], "left").join(wide, ["seq_id", "p"], "left")
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    g = rows.groupBy("seq_id").agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select("seq_id", F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def segments(boundaries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, ord, start, end) of each segment."""
    edges = inside(boundaries, sizes).select("seq_id", F.col("boundary").alias("start")).union(sizes.select("seq_id", F.lit(0)))
    w = Window.partitionBy("seq_id").orderBy("start")
    return edges.join(sizes, "seq_id").select("seq_id", (F.row_number().over(w) - 1).alias("ord"), "start", F.coalesce(F.lead("start").over(w), F.col("n")).alias("end"))


def best_overlap(hyp: DataFrame, ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, mean_iou): mean over predicted segments of the best overlap over hull with a reference segment of the same sequence. Only segments that
    meet need comparing, since others overlap in nothing."""
    p, r = segments(hyp, sizes), segments(ref, sizes).select("seq_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = p.join(r, (p.seq_id == r.seq_id) & (F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end"))).drop(r.seq_id)
    iou = (F.least("end", "e2") - F.greatest("start", "s2")) / (F.greatest("end", "e2") - F.least("start", "s2"))
    return met.groupBy("seq_id", "ord").agg(F.max(iou).alias("best")).groupBy("seq_id").agg(F.avg("best").alias("mean_iou"))


def length_audit(boundaries: DataFrame, sizes: DataFrame, short: int = 5) -> DataFrame:
    """(seq_id, n_segments, shortest, longest, mean_length, n_short)."""
    length = F.col("end") - F.col("start")
    return segments(boundaries, sizes).groupBy("seq_id").agg(F.count("*").alias("n_segments"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean_length"), F.count_if(length < short).alias("n_short"))


#: Tolerances of the relaxed metrics, in units and in seconds.
UNIT_TOLERANCES, TIME_TOLERANCES = (1, 2, 3, 5, 10), (10, 30, 60)


def in_seconds(boundaries: DataFrame, sizes: DataFrame, starts: DataFrame) -> DataFrame:
    """(seq_id, boundary): whole seconds of the starts (seq_id, pos, start) of the units at boundaries, within the duration of sizes (seq_id, n, duration)."""
    rows = inside(boundaries, sizes.select("seq_id", "n")).join(starts.select("seq_id", F.col("pos").alias("boundary"), "start"), ["seq_id", "boundary"]).join(sizes.select("seq_id", "duration"), "seq_id")
    return rows.select("seq_id", F.greatest(F.lit(1), F.least(half_even(F.col("start")).cast("int"), F.ceil("duration").cast("int") - 1)).alias("boundary")).distinct()


def relaxed(hyp: DataFrame, ref: DataFrame, sizes: DataFrame, starts: DataFrame) -> DataFrame:
    """Strict and relaxed metrics of each sequence: those of `evaluate` with F1 up to ten units, F1 within seconds, counts, their error and ratio, and the mean best overlap
    of segments. `sizes` is (seq_id, n, duration), `starts` (seq_id, pos, start) in seconds.
    Boundaries and sizes are stored first, as five metrics read them: else one task would hold the sorts that make them once for each."""
    sizes = stored(sizes, "sizes")
    n = sizes.select("seq_id", "n")
    hyp, ref = stored(inside(hyp, n), "hyp"), stored(inside(ref, n), "ref")
    unit = evaluate(hyp, ref, n, UNIT_TOLERANCES).select("seq_id", "pk", "wd", "bs", *[f"f1_t{t}" for t in UNIT_TOLERANCES])
    seconds = sizes.select("seq_id", (F.ceil("duration") + 1).cast("int").alias("n"))
    rows = lists(in_seconds(hyp, sizes, starts), in_seconds(ref, sizes, starts), seconds)
    h, r = F.size("hyp"), F.size("ref")
    out = []
    for t in TIME_TOLERANCES:
        rows = matched(rows, t).withColumnRenamed("taken", f"_t{t}")
        out.append(F.when((h == 0) & (r == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.size(f"_t{t}"), h + r), F.lit(0.0))).alias(f"time_f1_{t}s"))
    rows = rows.select("seq_id", *out)
    counts = lists(hyp, ref, n).select("seq_id", F.size("ref").alias("n_reference"), F.size("hyp").alias("n_predicted"))
    error = F.col("n_predicted") - F.col("n_reference")
    counts = counts.withColumn("count_error", error).withColumn("abs_count_error", F.abs(error)).withColumn("boundary_ratio", F.col("n_predicted") / F.greatest(F.lit(1), F.col("n_reference")))
    return unit.join(rows, "seq_id").join(counts, "seq_id").join(best_overlap(hyp, ref, n).withColumnRenamed("mean_iou", "mean_best_tiou"), "seq_id")


def agreement(a: DataFrame, b: DataFrame, sizes: DataFrame, tolerance: int = 1) -> DataFrame:
    """(seq_id, kappa, precision, recall, f1) of two annotators' boundaries, to four digits."""
    f = tolerance_f1(a, b, sizes, tolerance)
    return kappa_asym(a, b, sizes, tolerance).join(f, "seq_id").select("seq_id", *[F.round(c, 4).alias(c) for c in ("kappa", "precision", "recall", "f1")])


def agreement_summary(chapters: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(n, kappa_chapter, f1_chapter, kappa_subtopic, f1_subtopic): means over sequences, to four digits."""
    rows = chapters.select("seq_id", F.col("kappa").alias("k1"), F.col("f1").alias("f1")).join(subtopics.select("seq_id", F.col("kappa").alias("k2"), F.col("f1").alias("f2")), "seq_id")
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return rows.agg(F.count("*").alias("n"), mean("k1", "kappa_chapter"), mean("f1", "f1_chapter"), mean("k2", "kappa_subtopic"), mean("f2", "f1_subtopic"))
