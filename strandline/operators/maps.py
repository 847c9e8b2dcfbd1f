"""Split maps: the greedy splits of each sequence, model and smoothing window, made once and read by all methods that combine them.

Splits are nested, so the first splits of a longer list are those that a shorter one would have. A map is thus a table (seq_id, model, window, boundary, rank, gain), and what differs between
methods, how many splits they ask for, how they scale and weigh them and what they choose, is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import grouped, metrics
from . import segmenters as S
from .folds import apart, fold

#: Points of a grid; their parameters are literals of the plan.
MOST_POINTS = 10_000
#: Gaps of a task of a grid, about, counted once for each point.
GAPS = 500_000


def split_maps(units: DataFrame, most: DataFrame, windows: list[int], models: tuple[str, ...] = ("vec1", "vec2")) -> DataFrame:
    """(seq_id, model, window, boundary, rank, gain): the first m splits, by `most` (seq_id, m), of each model's vectors smoothed by each window; models count from 1."""

    def one(seq_id: int, pdf: pd.DataFrame) -> list[tuple]:
        out, m = [], int(pdf["m"].iloc[0])
        for i, c in enumerate(models, 1):
            v = np.array(pdf[c].tolist(), np.float64)
            for w in windows:
                order, gains = S.divisive_order(S.smooth(v, w), m + 1)
                out += [(seq_id, i, w, int(b), r, float(g)) for r, (b, g) in enumerate(zip(order, gains, strict=True), 1)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in grouped.sequences(batches, one):
            yield pd.DataFrame(out, columns=["seq_id", "model", "window", "boundary", "rank", "gain"])

    rows = units.select("seq_id", "pos", *models).join(most, "seq_id")
    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "pos").mapInPandas(run, "seq_id long, model int, window int, boundary int, rank int, gain double")


def scaled(a: Column) -> Column:
    """Min-max of an array; flat is 0. The array and its ends are bound: inside a lambda they would be computed again for each element."""
    one = lambda v, m: F.transform(v, lambda x: F.when(m["hi"] > m["lo"], F.round((x - m["lo"]) / (m["hi"] - m["lo"]), 9)).otherwise(0.0))
    return V.let(a, lambda v: V.let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda m: one(v, m)))


def explode(values: list, name: str, kinds: list[str]) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(kinds, v, strict=True))) for v in values))).alias(name)


def grid_choices(maps: DataFrame, facts: DataFrame, signals: dict[str, DataFrame], windows: list[int], shares: list[float], overs: list[int], weights: dict[str, list[float]], lengths: list[int], suppressions: list[int], only_candidates: bool = False) -> DataFrame:
    """(seq_id, n, method, kept) of every point of a grid, a row for each sequence and point, `kept` in rising order: split maps of two models (rank up to least(n - 1, over * share of k + 2)
    segments, each over its largest, their mean), signals added by weight, and a greedy choice of the share of k with suppression and least length. `facts` is (seq_id, n, k), signals
    are (seq_id, boundary, score). Other columns of `facts` go along.

    The grid is a lattice. Maps and signals of a window become one array over the sequence's gaps, the only shuffle; windows, shares and oversamplings give base scores, each of
    these one ranking for each tuple of weights, and each ranking one choice for each length and suppression. So a ranking is made once, whatever follows it.
    Gaps, maps and signals meet as a union: rows that are made here by exploding look small to the planner, which would broadcast them in joins."""
    n_points = len(windows) * len(shares) * len(overs) * len(lengths) * len(suppressions) * int(np.prod([len(w) for w in weights.values()]))
    if n_points > MOST_POINTS:
        raise ValueError(f"{n_points} points; at most {MOST_POINTS}")
    key, along = ["seq_id", "window"], [c for c in facts.columns if c not in ("seq_id", "n", "k")]
    every = F.explode(F.array(*map(F.lit, windows))).alias("window")
    at = F.col("boundary").cast("int").alias("boundary")
    rows = facts.select("seq_id", every, F.lit(0).alias("boundary"), "n", "k", *along)
    gaps = facts.where("n > 1").select("seq_id", every, "n").select(*key, F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("boundary"), F.lit(True).alias("gap"))
    side = [F.when(F.col("model") == m, F.col(c)).alias(f"{c[0]}{m}") for m in (1, 2) for c in ("rank", "gain")]
    scores = [signal.select("seq_id", every, at, F.col("score").alias(f"s_{name}")) for name, signal in signals.items()]
    for more in [gaps, maps.where(F.col("window").isin(windows)).select(*key, at, *side), *scores]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    # Rows are few and small for what is made of them, so the points, not the rows, say how many tasks there are.
    parts = max(1, -(-(facts.agg(F.sum("n")).first()[0] or 0) * n_points // GAPS))
    most = lambda names: [F.max(c).alias(c) for c in names]
    once = most(["n", "k"]) + [F.first(c, ignorenulls=True).alias(c) for c in along]
    rows = rows.repartition(parts, *key).groupBy(*key, "boundary").agg(*once, *most(["gap", "r1", "g1", "r2", "g2", *(f"s_{x}" for x in signals)]))
    cells = F.when(F.col("gap"), F.struct("boundary", "r1", "g1", "r2", "g2", *(F.coalesce(f"s_{x}", F.lit(0.0)).alias(f"s_{x}") for x in signals)))
    rows = rows.groupBy(*key).agg(*once, F.array_sort(F.collect_list(cells)).alias("d")).where("n IS NOT NULL")
    rows = rows.select(*key, "n", "k", *along, "d", *(scaled(F.col(f"d.s_{x}")).alias(f"s_{x}") for x in signals))
    # Shares and oversamplings: the base scores.
    rows = rows.select("*", explode(list(product(shares, overs)), "p", ["share", "over"])).select("*", "p.share", "p.over").drop("p")
    ask = F.least(F.col("n") - 1, F.greatest(F.lit(2), F.bround(F.col("k") * F.col("share")).cast("int")) * F.col("over") + 2)
    rows = rows.withColumn("ask", ask)
    value = lambda x, m: F.when(x[f"r{m}"] < F.col("ask"), x[f"g{m}"])
    top = [F.coalesce(F.array_max(F.transform("d", lambda x: value(x, m))), F.lit(0.0)) for m in (1, 2)]  # noqa: B023
    tops = F.struct(*(V.let(t, lambda z: F.when(z == 0, 1.0).otherwise(z)).alias(f"t{m}") for m, t in enumerate(top, 1)))
    base = V.let(tops, lambda t: F.transform("d", lambda x: (F.coalesce(value(x, 1), F.lit(0.0)) / t["t1"] + F.coalesce(value(x, 2), F.lit(0.0)) / t["t2"]) / 2))
    inside = F.transform("d", lambda x: (F.coalesce(x["r1"], F.col("n")) < F.col("ask")) | (F.coalesce(x["r2"], F.col("n")) < F.col("ask")))
    rows = rows.select("seq_id", "window", "n", "k", *along, "share", "over", *(f"s_{x}" for x in signals), scaled(base).alias("base"), inside.alias("inside"))
    # Weights: the rankings.
    names = list(weights)
    rows = rows.select("*", explode(list(product(*weights.values())), "w", names) if names else F.lit(None).alias("w"))
    total = F.transform("base", lambda x, i: sum((F.col(f"w.{name}") * F.col(f"s_{name}")[i] for name in names), x))
    rows = rows.withColumn("total", scaled(total))
    if only_candidates:
        rows = rows.withColumn("total", F.transform("total", lambda x, i: F.when(F.col("inside")[i], x).otherwise(0.0)))
    order = F.transform(F.array_sort(F.transform("total", lambda s, i: F.struct((-s).alias("s"), (i + 1).alias("b")))), lambda x: x["b"])
    percent = lambda c: F.floor(F.col(c) * 100).cast("string")
    label = F.concat(F.lit("mm_w"), F.col("window"), F.lit("_frac"), percent("share"), F.lit("_over"), F.col("over"), *(x for name in names for x in (F.lit(f"_{name}"), percent(f"w.{name}"))))
    rows = rows.select("seq_id", "n", *along, F.greatest(F.lit(1), F.bround(F.col("k") * F.col("share")).cast("int")).alias("take"), label.alias("label"), order.alias("ranked"))
    # Lengths and suppressions: the choices.
    rows = rows.select("*", explode([(x, y, max(x, y)) for x, y in product(lengths, suppressions)], "c", ["least", "near", "far"]))
    # Suppression and least length ask for distances to what was accepted: the larger one says it, in one pass, and none once all are taken.
    edges = lambda b: (b >= F.col("c.least")) & (F.col("n") - b >= F.col("c.least"))
    kept = fold(rows, lambda acc, b: (F.size(acc) < F.col("take")) & edges(b) & apart(acc, b, F.col("c.far"), inclusive=False))
    return kept.select("seq_id", "n", *along, F.concat("label", F.lit("_min"), F.col("c.least"), F.lit("_nms"), F.col("c.near")).alias("method"), "kept")


def fusion_grid(maps: DataFrame, sizes: DataFrame, wanted: DataFrame, signals: dict[str, DataFrame], windows: list[int], shares: list[float], overs: list[int], weights: dict[str, list[float]], lengths: list[int], suppressions: list[int], only_candidates: bool = False) -> DataFrame:
    """(seq_id, method, boundary) of every point of a grid, as `grid_choices` makes them; `wanted` is (seq_id, k)."""
    kept = grid_choices(maps, sizes.join(wanted, "seq_id").select("seq_id", "n", "k"), signals, windows, shares, overs, weights, lengths, suppressions, only_candidates)
    return kept.select("seq_id", "method", F.explode("kept").alias("boundary"))


def measured(hyp: DataFrame, methods: DataFrame, refs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq_id, method, pk, wd) of (seq_id, method, boundary) for every pair of a sequence and a method of `methods` (method), a short list; a pair without boundaries is one segment."""
    key = F.struct("seq_id", "method").alias("seq_id")
    names = [r[0] for r in methods.distinct().limit(MOST_POINTS + 1).collect()]
    if len(names) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} methods")
    every = lambda df, *c: df.select("*", F.explode(F.array(*map(F.lit, names))).alias("method")).select(key, *c)
    m = metrics.evaluate(hyp.select(key, "boundary"), every(refs, "boundary"), every(sizes, "n"), ())
    return m.select("seq_id.seq_id", "seq_id.method", "pk", "wd")


#: Rows of a task that combines maps, about.
COMBINED = 250_000
#: How many segments each family of combinations asks of its maps, as a multiple of the target, and the windows of several resolutions.
OVER, RESOLUTIONS = 4, (7, 9, 11)


def combined(maps: DataFrame, sizes: DataFrame, wanted: DataFrame, specs: list[dict]) -> DataFrame:
    """(seq_id, method, boundary) of the methods that only combine split maps, all in one plan.

    A spec has a name, `how` (mean, rank, threshold, adaptive), `windows`, `models`, `weights` of the models, the target as `share` of k or `fewer` segments, `over` as multiple of the target, and
    `near`, the distance below which boundaries suppress each other. Maps meet the specs in a broadcast join on the window, as specs are literals; after it all is windows by
    sequence and method."""
    spark = maps.sparkSession
    columns = "method string, how string, model int, window int, weight double, parts int, share double, fewer int, over int, threshold double, near int"
    rows = []
    for s in specs:
        pairs = [(m, w) for w in s["windows"] for m in s.get("models", (1, 2))]
        for m, w in pairs:
            rows.append((s["name"], s.get("how", "mean"), m, w, float(s["weights"][m - 1]) if s.get("weights") else 1.0 / len(pairs), len(pairs), s.get("share"), s.get("fewer", 0), s.get("over", OVER), s.get("threshold"), s.get("near", 0)))
    if len(rows) > MOST_POINTS:
        raise ValueError(f"{len(rows)} parts; at most {MOST_POINTS}")
    # Maps meet many specs each, so a task's rows after that, not before it, say how many tasks there are. Those with suppression go apart, else either kind would pass all windows.
    counts = {(r["model"], r["window"]): r["count"] for r in maps.groupBy("model", "window").count().collect()}
    facts, out = maps.join(sizes.join(wanted, "seq_id"), "seq_id"), None
    for near in (False, True):
        some = [r for r in rows if bool(r[-1]) == near]
        if some:
            parts = max(1, -(-sum(counts.get((r[2], r[3]), 0) for r in some) // COMBINED))
            got = chosen(facts.repartition(parts, "seq_id").join(F.broadcast(spark.createDataFrame(some, columns)), ["model", "window"]), near)
            out = got if out is None else out.union(got)
    return out


def chosen(met: DataFrame, near: bool) -> DataFrame:
    """(seq_id, method, boundary) of maps that have met their specs, and lie in parts by sequence; `near`: with suppression or all without."""
    k = F.col("k")
    target = F.when(F.col("how") == "adaptive", k).when(F.col("share").isNotNull(), F.greatest(F.lit(2), F.bround(k * F.col("share")).cast("int"))).when(F.col("fewer") > 0, F.greatest(F.lit(2), k - F.col("fewer"))).otherwise(k)
    met = met.withColumn("target", target)
    share = F.greatest(F.lit(2), F.bround(k * F.coalesce("share", F.lit(1.0))).cast("int"))
    ask = F.when(F.col("how") == "threshold", F.greatest(F.lit(10), F.bround(3 * k).cast("int"))).when(F.col("how") == "adaptive", F.col("over") * share + 2).otherwise(F.col("over") * F.col("target") + 2)
    met = met.where(F.col("rank") < F.least(F.col("n") - 1, ask))
    own = Window.partitionBy("seq_id", "method", "model", "window")
    top = F.max("gain").over(own)
    place = F.row_number().over(own.orderBy(F.desc("gain"), "boundary"))
    count = F.count("*").over(own)
    met = met.withColumns({"_v": F.col("weight") * F.col("gain") / F.when(top == 0, 1.0).otherwise(top), "_place": place, "_count": count})
    facts = ["seq_id", "method", "how", "n", "k", "target", "threshold", "near", "parts"]
    longest = F.max("_count").over(Window.partitionBy("seq_id", "method"))
    met = met.withColumn("_longest", longest)
    g = met.groupBy(*facts, "boundary").agg(F.sum("_v").alias("_mean"), F.sum("_place").alias("_ranks"), F.count("*").alias("_in"), F.first("_longest").alias("_longest"))
    score = F.when(F.col("how") == "rank", -(F.col("_ranks") + (F.col("parts") - F.col("_in")) * (F.col("_longest") + 1))).otherwise(F.round("_mean", 12))
    g = g.withColumn("score", score.cast("double"))
    every = Window.partitionBy("seq_id", "method")
    rank = F.row_number().over(every.orderBy(F.desc("score"), "boundary"))
    many = F.greatest(F.lit(2), F.least(F.col("_many").cast("int"), F.bround(F.lit(1.5) * k).cast("int"), F.col("n") - 1))
    g = g.withColumn("_top", F.max("score").over(every)).withColumn("_many", F.sum((F.col("score") >= F.col("threshold") * F.col("_top")).cast("int")).over(every))
    cv = F.stddev_pop("score").over(every) / (F.avg("score").over(every) + F.lit(1e-8))
    wide = F.greatest(F.lit(2), F.bround(k * F.when(cv > 0.65, 0.8).when(cv < 0.4, 0.6).otherwise(0.7)).cast("int"))
    take = F.when(F.col("how") == "threshold", many).when(F.col("how") == "adaptive", wide).otherwise(F.col("target"))
    g = g.withColumn("_take", take).withColumn("_r", rank)
    if not near:
        return g.where(F.col("_r") <= F.col("_take")).select("seq_id", "method", "boundary")
    spaced = g.groupBy("seq_id", "method", "near", "_take").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("boundary").alias("b")))), lambda x: x["b"]).alias("ranked"))
    kept = fold(spaced, lambda acc, b: apart(acc, b, F.col("near"), inclusive=False), F.col("_take"))
    return kept.select("seq_id", "method", F.explode("kept").alias("boundary"))
