"""Registry methods as plans: those whose Python is nothing but greedy splits take their splits from one table of maps, and those that need none are windows over gaps.

`run_methods` here has the signature and the results of the one in `grouped`, which runs what is left: methods that refine candidates, k-means, dynamic programming, TextTiling and C99.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import folds, gaps, grouped, maps, select
from ..sources.stored import stored
from . import registry

#: Families whose options a spec can hold, and those over gaps alone.
SPLITS, GAPS = ("divisive", "cross", "rank", "weighted", "triple", "multi_res"), ("cosine", "cosine_drop", "combined_depth")
OPTIONS = {"threshold", "adaptive", "over", "nms", "w1"}


def spec(name: str) -> dict | None:
    """The combination of split maps that a name stands for, if it is one."""
    m = registry.parse(name)
    o = m.options
    if m.family not in SPLITS or set(o) - OPTIONS or m.shift or m.family == "divisive" and m.min_seg:
        return None
    s = {"name": name, "windows": [m.window], "share": m.frac, "fewer": m.fewer, "least": m.min_seg or 0, "aware": m.score_aware, "over": o.get("over", maps.OVER)}
    if m.family == "divisive":
        return s | {"models": (1,), "how": "first"}
    if m.family == "cross":
        how = "threshold" if "threshold" in o else "adaptive" if "adaptive" in o else "mean"
        return s | {"how": how, "threshold": o.get("threshold"), "near": o.get("nms", 0)}
    if m.family == "rank":
        return s | {"how": "rank"}
    if m.family == "weighted":
        return s | {"weights": (o["w1"], 1 - o["w1"])} if "w1" in o else None
    return s | ({"models": (1, 2, 3)} if m.family == "triple" else {"windows": list(maps.RESOLUTIONS)})


def both(units: DataFrame) -> DataFrame:
    """Units with a third model, the other two side by side at length one."""
    return units.withColumn("vec3", V.unit(F.concat("vec1", "vec2")))


def of_gaps(units: DataFrame, k: DataFrame, names: list[str]) -> DataFrame:
    """(seq_id, method, boundary) of the methods over gaps."""
    out = None
    for name in names:
        m = registry.parse(name)
        model = lambda i: gaps.smooth(units.select("seq_id", "pos", F.col(f"vec{i}").alias("vec")), m.window)  # noqa: B023, E731
        if m.family == "cosine":
            similar = gaps.gap_overlapping(model(1), m.options.get("depth", 3)).select("seq_id", "boundary", (1 - F.col("score")).alias("similarity"))
            scores, minus = gaps.depth_global(similar), 1
        elif m.family == "cosine_drop":
            scores, minus = gaps.gap_cross_block(model(1), 3).select("seq_id", "boundary", (-F.col("similarity")).alias("score")), 1
        else:
            top = F.max("score").over(select.every())
            share = lambda i: gaps.gap_one_sided(model(i), m.options.get("depth", 7)).withColumn("score", F.col("score") / F.when(top == 0, 1.0).otherwise(top) / 2)  # noqa: B023, E731
            scores, minus = share(1).union(share(2)).groupBy("seq_id", "boundary").agg(F.sum("score").alias("score")), 0
        target = F.greatest(F.lit(2), F.bround(F.col("k") * m.frac).cast("int")) if m.frac is not None else F.greatest(F.lit(2), F.col("k") - m.fewer) if m.fewer else F.col("k")
        got = select.top_k(scores.withColumn("score", F.round("score", 12)).join(k, "seq_id").withColumn("_t", target - minus), F.col("_t")).select("seq_id", F.lit(name).alias("method"), F.col("boundary").cast("int").alias("boundary"))
        out = got if out is None else out.union(got)
    return out


def of_maps(units: DataFrame, k: DataFrame, specs: list[dict]) -> DataFrame:
    """(seq_id, method, boundary) of the combinations of split maps, from one stored table of them."""
    sizes = units.groupBy("seq_id").agg(F.count("*").cast("int").alias("n"))
    windows = sorted({w for s in specs for w in s["windows"]})
    models = tuple(f"vec{i}" for i in sorted({i for s in specs for i in s.get("models", (1, 2))} | {1}))
    if models == ("vec1", "vec3"):
        models = ("vec1", "vec2", "vec3")
    over = max([5, *(s["over"] for s in specs)])
    most = sizes.join(k, "seq_id").select("seq_id", F.least(F.col("n") - 1, F.greatest(F.col("k") * over + 2, F.lit(10), 2 * F.lit(over) + 2)).cast("int").alias("m"))
    table = stored(maps.split_maps(both(units) if "vec3" in models else units, most, windows, models), "maps")
    first = [s for s in specs if s.get("how") == "first"]
    out = None
    if first:
        rows = F.explode(F.array(*(F.struct(F.lit(s["name"]).alias("method"), F.lit(s["windows"][0]).alias("window"), F.lit(s["share"]).cast("double").alias("share"), F.lit(s["fewer"]).alias("fewer")) for s in first))).alias("s")
        target = F.when(F.col("s.share").isNotNull(), F.greatest(F.lit(2), F.bround(F.col("k") * F.col("s.share")).cast("int"))).when(F.col("s.fewer") > 0, F.greatest(F.lit(2), F.col("k") - F.col("s.fewer"))).otherwise(F.col("k"))
        wanted = k.select("seq_id", "k", rows).select("seq_id", F.col("s.method").alias("method"), F.col("s.window").alias("window"), target.alias("target"))
        out = table.where("model = 1").join(wanted, ["seq_id", "window"]).where("rank < target").select("seq_id", "method", "boundary")
    rest = [s for s in specs if s.get("how") != "first"]
    if rest:
        got = stored(maps.combined(table, sizes, k, rest), "combined")  # which three branches read
        plain = [s["name"] for s in rest if not s["least"]]
        kept = got.where(F.col("method").isin(plain)) if plain else None
        short = defaultdict(list)
        for s in rest:
            if s["least"]:
                short[s["least"]].append(s["name"])
        if short:
            least = F.create_map(*[F.lit(x) for n, names in short.items() for name in names for x in (name, n)])
            key = F.struct("seq_id", "method", F.element_at(least, F.col("method")).alias("least")).alias("seq_id")
            some = got.where(F.col("method").isin([n for names in short.values() for n in names])).select(key, "boundary")
            n = some.select("seq_id").distinct().select("seq_id", F.col("seq_id.seq_id").alias("_s")).join(sizes.withColumnRenamed("seq_id", "_s"), "_s").select("seq_id", "n")
            long = folds.min_segment_filter(some, n, F.col("seq_id.least")).select("seq_id.seq_id", "seq_id.method", "boundary")
            kept = long if kept is None else kept.union(long)
        out = kept if out is None else out.union(kept)
    return out


def run_methods(units: DataFrame, k: DataFrame, methods: list[str]) -> DataFrame:
    """(seq_id, method, boundary), as plans where a method is one and in Python where it isn't."""
    specs, over_gaps, left = [], [], []
    for name in methods:
        s = spec(name)
        m = registry.parse(name)
        if s and not s["aware"]:
            specs.append(s)
        elif m.family in GAPS and not m.min_seg and not m.shift:
            over_gaps.append(name)
        else:
            left.append(name)
    if all(s["how"] == "first" for s in specs if "how" in s) and all("how" in s for s in specs):  # splits alone, which need no table of maps
        left, specs = [*left, *(s["name"] for s in specs)], []
    parts = []
    if specs:
        parts.append(of_maps(units, k, specs))
    if over_gaps:
        parts.append(of_gaps(units, k, over_gaps))
    if left:
        parts.append(grouped.run_methods(units, k, left))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
