"""Fusion of gap signals: (seq_id, boundary, signal, score) rows in, (seq_id, boundary, score) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gaps import minmax


def reliability(signals: DataFrame, mode: str = "entropy", fixed: dict[str, float] | None = None) -> DataFrame:
    """(seq_id, signal, entropy, raw, weight). Entropy is that of the scores shifted to start at 0, over its largest value; raw is exp(-entropy), or 1, or a
    given weight; weights sum to 1."""
    by = Window.partitionBy("seq_id", "signal")
    x = signals.withColumn("x", F.col("score") - F.min("score").over(by))
    x = x.withColumn("t", F.sum("x").over(by)).withColumn("n", F.count("*").over(by))
    x = x.withColumn("p", F.coalesce(F.try_divide("x", "t"), F.lit(0.0)) + 1e-9).withColumn("p", F.col("p") / F.sum("p").over(by))
    h = F.when((F.max("t") < 1e-9) | (F.max("n") < 2), 1.0).otherwise(-F.sum(F.col("p") * F.log2("p")) / F.log2(F.max("n")))
    rows = x.groupBy("seq_id", "signal").agg(h.alias("entropy"))
    raw = {"entropy": F.exp(-F.col("entropy")), "uniform": F.lit(1.0), "fixed": F.coalesce(*[F.when(F.col("signal") == k, F.lit(float(v))) for k, v in (fixed or {}).items()], F.lit(0.0))}[mode]
    rows = rows.withColumn("raw", raw)
    return rows.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("seq_id")))


def fuse(signals: DataFrame, mode: str = "entropy", fixed: dict[str, float] | None = None) -> DataFrame:
    """Min-max each signal, weigh, sum, min-max again; a flat series stays as it is in both. Every signal must cover every boundary of its sequence."""
    w = reliability(signals, mode, fixed).select("seq_id", "signal", "weight")
    by = Window.partitionBy("seq_id", "signal")
    low, high = F.min("score").over(by), F.max("score").over(by)
    scaled = signals.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))
    signals_of = Window.partitionBy("seq_id")
    scaled = scaled.withColumn("_n", F.count("*").over(Window.partitionBy("seq_id", "boundary"))).withColumn("_m", F.max("_n").over(signals_of))
    scaled = scaled.where(F.when(F.col("_n") == F.col("_m"), True).otherwise(F.raise_error(F.lit("signals of different length")).cast("boolean"))).drop("_n", "_m")
    return minmax(scaled.join(w, ["seq_id", "signal"]).groupBy("seq_id", "boundary").agg(F.sum(F.col("weight") * F.col("score")).alias("score")), flat=None)


def two_stage(text: DataFrame, fused: DataFrame, gate: float = 0.5, c: float = 1.2) -> DataFrame:
    """Boundaries whose text gap is over mean + gate * deviation and whose fused score is over mean + c * deviation."""
    from .select import mean_std

    return mean_std(fused, c).join(mean_std(text, gate).select("seq_id", "boundary"), ["seq_id", "boundary"], "left_semi")


def hierarchy(fused: DataFrame, text: DataFrame, k: int, ratio: float = 0.3) -> DataFrame:
    """(seq_id, boundary, level): the k - 1 best fused scores are subtopics; the best by text gap among them are chapters too."""
    from .select import top_k

    sub = top_k(fused, k - 1).select("seq_id", "boundary")
    n = F.least(F.greatest(F.lit(2), F.bround(ratio * (F.count("*").over(Window.partitionBy("seq_id")) + 1)).cast("int")), F.count("*").over(Window.partitionBy("seq_id")) + 1)
    rows = sub.join(text, ["seq_id", "boundary"]).withColumn("_n", n)
    chapters = top_k(rows, F.col("_n") - 1).select("seq_id", "boundary").withColumn("_c", F.lit(True))
    return sub.join(chapters, ["seq_id", "boundary"], "left").select("seq_id", "boundary", F.when(F.col("_c"), "chapter").otherwise("subtopic").alias("level"))


def spikes(events: DataFrame) -> DataFrame:
    """Largest value of each gap, five-tap smoothed and min-maxed: (seq_id, boundary, score) of events (seq_id, boundary, score)."""
    from .gaps import kernel_smooth

    return minmax(kernel_smooth(events.groupBy("seq_id", "boundary").agg(F.max("score").alias("score"))))


def prosody_gap(units: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """(seq_id, boundary, score) from (seq_id, pos, pause_after, mean_pitch, pitch_std): pause, mean deviation of a pair and pitch reset, each min-maxed."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    nxt = lambda c: F.lead(c).over(w)
    reset = F.when(F.col("mean_pitch") > 1e-3, F.abs(nxt("mean_pitch") - F.col("mean_pitch")) / F.col("mean_pitch")).otherwise(F.lit(1.0))
    rows = units.select("seq_id", (F.col("pos") + 1).alias("boundary"), F.col("pause_after").alias("a"), reset.alias("b"), ((F.col("pitch_std") + nxt("pitch_std")) / 2).alias("c"), nxt("pos").alias("_n")).where("_n is not null").drop("_n")
    for name in "abc":
        rows = minmax(rows, name)
    return rows.select("seq_id", "boundary", (weights[0] * F.col("a") + weights[1] * F.col("c") + weights[2] * F.col("b")).alias("score"))


def rerank(a: DataFrame, b: DataFrame, w: float) -> DataFrame:
    """w * a + (1 - w) * b where both have a score; where b has none, a alone: the weights of what is missing are dealt out again."""
    other = b.select("seq_id", "boundary", F.col("score").alias("_o"))
    return a.join(other, ["seq_id", "boundary"], "left").select("seq_id", "boundary", F.when(F.col("_o").isNull(), F.col("score")).otherwise(w * F.col("score") + (1 - w) * F.col("_o")).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Divided by the sequence's largest; a largest of 0 divides by 1."""
    m = F.max("score").over(Window.partitionBy("seq_id"))
    return scores.withColumn("score", F.col("score") / F.when(m == 0, 1.0).otherwise(m))


def mean_of_maps(maps: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Full outer combination of score maps: a missing score is 0, and the divisor is the number of maps. A union and one aggregation, not a chain of joins."""
    weights = weights or [1.0 / len(maps)] * len(maps)
    rows = None
    for m, w in zip(maps, weights, strict=True):
        part = normalised(m).select("seq_id", "boundary", (F.col("score") * w).alias("score"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("seq_id", "boundary").agg(F.sum("score").alias("score"))


def borda(maps: list[DataFrame]) -> DataFrame:
    """Negated sum of ranks by falling score; a boundary that a map lacks ranks one after the last of the longest map of its sequence."""
    every = None
    for i, m in enumerate(maps):
        r = m.select("seq_id", "boundary", F.lit(i).alias("m"), F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("score"), "boundary")).alias("r"))
        every = r if every is None else every.union(r)
    absent = F.max("r").over(Window.partitionBy("seq_id")) + 1
    got = every.withColumn("absent", absent).groupBy("seq_id", "boundary").agg(F.sum("r").alias("x"), F.count("*").alias("n"), F.max("absent").alias("absent"))
    return got.select("seq_id", "boundary", (-(F.col("x") + (len(maps) - F.col("n")) * F.col("absent"))).cast("double").alias("score"))


def ocr_change(frames: DataFrame) -> DataFrame:
    """(seq_id, boundary, score) from (seq_id, pos, text, confidence): 0.7 * Jaccard distance + 0.3 * changed, times the confidence within 0.1 to 1; neighbours get
    half, and a boundary the largest that it gets."""
    from ..functions.scalars import jaccard, token_set

    w = Window.partitionBy("seq_id").orderBy("pos")
    rows = frames.withColumn("_t", token_set(F.col("text"))).withColumn("_p", F.lag(F.struct("text", "_t")).over(w)).where("_p is not null")
    s = (0.7 * (1 - jaccard(F.col("_p._t"), F.col("_t"))) + 0.3 * (F.col("_p.text") != F.col("text")).cast("double")) * F.least(F.lit(1.0), F.greatest(F.lit(0.1), "confidence"))
    spread = F.explode(F.array(*[F.struct((F.col("pos") + d).cast("int").alias("boundary"), (F.lit(f) * F.col("s")).alias("score")) for d, f in ((-1, 0.5), (0, 1.0), (1, 0.5))])).alias("x")
    n = frames.groupBy("seq_id").agg(F.count("*").alias("n"))
    got = rows.withColumn("s", s).select("seq_id", spread).select("seq_id", "x.boundary", "x.score").join(n, "seq_id").where("boundary > 0 and boundary < n")
    return got.groupBy("seq_id", "boundary").agg(F.max("score").alias("score"))


def auto_count(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, n_subtopics): scores over mean + half a deviation, and one, but two at least and a third of the units at most."""
    w = Window.partitionBy("seq_id")
    rows = scores.withColumn("_over", F.col("score") > F.round(F.avg("score").over(w) + 0.5 * F.stddev_pop("score").over(w), 9))
    n = rows.groupBy("seq_id").agg(F.count_if("_over").alias("_n")).join(sizes, "seq_id")
    return n.select("seq_id", F.least(F.greatest(F.lit(2), F.col("_n") + 1), F.floor(F.col("n") / 3)).cast("int").alias("n_subtopics"))
