"""Portfolio analysis over a result cube (method, seq_id, pk, wd, f1, error): best method, oracle, leave-one-out choice, shortlist, dominance, roll-ups.

Leave-one-out means come from totals, (sum - own) / (n - 1), so no pair of sequences is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Points that are compared with each other: means of methods.
MOST_METHODS = 5000


def good(cube: DataFrame) -> DataFrame:
    return cube.where("error is null")


def means(cube: DataFrame) -> DataFrame:
    """(method, n, pk, wd, f1): means over the sequences that have a result."""
    return good(cube).groupBy("method").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("pk", "wd", "f1")])


def means_missing_zero(cube: DataFrame, n_sequences: DataFrame) -> DataFrame:
    """The same with missing results as 0: divided by the number of all sequences."""
    n = n_sequences.select("seq_id").distinct().agg(F.count("*").alias("all"))
    return good(cube).groupBy("method").agg(*[F.sum(c).alias(c) for c in ("pk", "wd", "f1")]).join(F.broadcast(n)).select("method", *[(F.col(c) / F.col("all")).alias(c) for c in ("pk", "wd", "f1")])


def best_global(cube: DataFrame) -> DataFrame:
    return means(cube).orderBy("pk", "wd", "method").limit(1)


def balanced(cube: DataFrame) -> DataFrame:
    """The method of least (pk + wd) / 2, then pk."""
    return means(cube).withColumn("balance", (F.col("pk") + F.col("wd")) / 2).orderBy("balance", "pk", "method").limit(1)


def oracle(cube: DataFrame) -> DataFrame:
    """(seq_id, method, pk, wd): each sequence's best method."""
    r = good(cube).groupBy("seq_id").agg(F.min_by(F.struct("method", "pk", "wd"), F.struct("pk", "wd", "method")).alias("b"))
    return r.select("seq_id", "b.method", "b.pk", "b.wd")


def leave_one_out(cube: DataFrame) -> DataFrame:
    """(seq_id, method, pk, wd): for each sequence the method best in the mean over the others, among those that have the sequence. Totals of methods are
    aggregated before they meet the sequences' rows."""
    x = good(cube)
    total = x.groupBy("method").agg(F.sum("pk").alias("_tp"), F.sum("wd").alias("_tw"), F.count("*").alias("_n")).where("_n > 1")
    others = lambda t, c: F.round((F.col(t) - F.col(c)) / (F.col("_n") - 1), 9)
    x = x.join(total, "method").withColumn("_p", others("_tp", "pk")).withColumn("_w", others("_tw", "wd"))
    r = x.groupBy("seq_id").agg(F.min_by(F.struct("method", "pk", "wd"), F.struct("_p", "_w", "method")).alias("b"))
    return r.select("seq_id", "b.method", "b.pk", "b.wd")


def shortlist(cube: DataFrame, top: int = 25, share: float = 0.8) -> DataFrame:
    """The best methods among those with results for at least max(3, half-even share of all) sequences."""
    n = good(cube).select("seq_id").distinct().agg(F.greatest(F.lit(3), F.bround(share * F.count("*"))).alias("least"))
    return means(cube).join(F.broadcast(n)).where("n >= least").orderBy("pk", "wd", "method").limit(top).select("method", "n", "pk", "wd")


def pareto(points: DataFrame) -> DataFrame:
    """(method, dominated_by): how many methods are as good in pk, wd and f1 and better in one. Points are a short list, MOST_METHODS at most; they are computed once, as
    means added up in another order differ in their last digit, and a method must not be better than itself."""
    m = stored(points.select("method", "pk", "wd", "f1"), "points")
    if m.limit(MOST_METHODS + 1).count() > MOST_METHODS:
        raise ValueError(f"more than {MOST_METHODS} points")
    o = m.select(F.col("method").alias("m2"), F.col("pk").alias("p2"), F.col("wd").alias("w2"), F.col("f1").alias("g2"))
    as_good = (F.col("p2") <= F.col("pk")) & (F.col("w2") <= F.col("wd")) & (F.col("g2") >= F.col("f1"))
    better = (F.col("p2") < F.col("pk")) | (F.col("w2") < F.col("wd")) | (F.col("g2") > F.col("f1"))
    hits = m.join(F.broadcast(o), as_good & better).groupBy("method").agg(F.count("*").alias("dominated_by"))
    return m.join(hits, "method", "left").select("method", F.coalesce("dominated_by", F.lit(0)).alias("dominated_by"))


def operating_points(points: DataFrame, deployable: str = "role <> 'oracle'") -> DataFrame:
    """(method, dominated_by, is_best_pk, is_best_wd, is_best_balanced, is_best_deployable, is_best_hits) of points (method, role, pk, wd, f1): which of them is best by
    (pk, wd), (wd, pk), ((pk + wd) / 2, pk), the same among deployable ones, and by f1."""
    points = stored(points, "points")
    balance = (F.col("pk") + F.col("wd")) / 2
    keys = {"is_best_pk": F.struct("pk", "wd", "method"), "is_best_wd": F.struct("wd", "pk", "method"), "is_best_balanced": F.struct(balance, F.col("pk"), F.col("method")), "is_best_hits": F.struct(-F.col("f1"), F.col("method"))}
    best = points.agg(*[F.min_by("method", k).alias(n) for n, k in keys.items()], F.min_by("method", F.when(F.expr(deployable), F.struct(balance.alias("b"), F.col("pk"), F.col("method")))).alias("is_best_deployable"))
    names = [*keys, "is_best_deployable"]
    return pareto(points).join(F.broadcast(best)).select("method", "dominated_by", *[(F.col("method") == F.col(n)).alias(n) for n in names])


def domain_rollup(cube: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, method, n, pk, wd) with totals of each domain and of all; null stands for all."""
    return good(cube).join(domains, "seq_id").rollup("domain", "method").agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd"))


def leave_domain_out(cube: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, method, pk): for each domain the method best in the mean over all other domains, and its mean in the domain."""
    x = good(cube).join(domains, "seq_id").groupBy("domain", "method").agg(F.sum("pk").alias("s"), F.sum("wd").alias("s2"), F.count("*").alias("n"))
    w = Window.partitionBy("method")
    rest = F.sum("n").over(w) - F.col("n")
    x = x.withColumn("_p", F.round((F.sum("s").over(w) - F.col("s")) / rest, 9)).withColumn("_w", F.round((F.sum("s2").over(w) - F.col("s2")) / rest, 9)).withColumn("_r", rest).where("_r > 0")
    r = x.groupBy("domain").agg(F.min_by(F.struct("method", (F.col("s") / F.col("n")).alias("pk")), F.struct("_p", "_w", "method")).alias("b"))
    return r.select("domain", "b.method", "b.pk")


def family(name) -> object:
    """A method's family by the start of its name."""
    rules = [("cross_rank", "rank vote"), ("cross", "cross-model"), ("iterative", "iterative"), ("triple", "ensemble"), ("divisive", "divisive"), ("depth", "depth"), ("dp", "optimal")]
    c = F
    out = None
    for start, label in rules:
        out = c.when(F.startswith(name, F.lit(start)), label) if out is None else out.when(F.startswith(name, F.lit(start)), label)
    return out.otherwise("other")


def choice_audit(choices: DataFrame, default: DataFrame) -> DataFrame:
    """(method, n, n_switched, mean_delta): how often choices (seq_id, method, pk) differ from a default's (seq_id, method, pk), and by how much."""
    d = default.select("seq_id", F.col("method").alias("m0"), F.col("pk").alias("p0"))
    return choices.join(d, "seq_id").groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("method") != F.col("m0")).alias("n_switched"), F.avg(F.col("pk") - F.col("p0")).alias("mean_delta"))


def registry_rank(cube: DataFrame) -> DataFrame:
    """(method, rank, pk, gap): rank by mean, and how far behind the best."""
    w = Window.orderBy("pk")  # over methods, of which there are few
    return means(cube).select("method", F.rank().over(w).alias("rank"), "pk", (F.col("pk") - F.min("pk").over(Window.partitionBy())).alias("gap"))


def union_renamed(cubes: list[tuple[str, DataFrame]]) -> DataFrame:
    """Cubes of several files in order; a method that an earlier file has gets the file's stem before its name."""
    every = None
    for i, (stem, c) in enumerate(cubes):
        c = c.withColumn("_ord", F.lit(i)).withColumn("_stem", F.lit(stem))
        every = c if every is None else every.unionByName(c, allowMissingColumns=True)
    first = every.groupBy("method").agg(F.min("_ord").alias("_f"))
    return every.join(first, "method").withColumn("method", F.when(F.col("_ord") == F.col("_f"), F.col("method")).otherwise(F.concat("_stem", F.lit("::"), "method"))).drop("_ord", "_stem", "_f")


def video_features(units: DataFrame) -> DataFrame:
    """(seq_id, n_units, log_units, n_words, mean_words, std_words, density) of text units."""
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    g = units.withColumn("_n", n).groupBy("seq_id").agg(F.count("*").alias("n_units"), F.log1p(F.count("*")).alias("log_units"), F.sum("_n").alias("n_words"), F.avg("_n").alias("mean_words"), F.stddev_pop("_n").alias("std_words"), F.sum(F.length("text")).alias("_c"))
    return g.withColumn("density", F.col("n_words") / F.col("_c")).drop("_c")


def training_pairs(units: DataFrame, boundaries: DataFrame, most: int = 3) -> DataFrame:
    """(seq_id, a, b, label): neighbours within a segment are positives, neighbours across a boundary negatives; at most `most` of a kind and segment, which is the
    operator's own sampling parameter."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    marks = boundaries.select("seq_id", F.col("boundary").alias("pos"), F.lit(1).alias("_b"))
    u = units.select("seq_id", "pos").join(marks, ["seq_id", "pos"], "left").withColumn("_b", F.coalesce("_b", F.lit(0))).withColumn("seg", F.sum("_b").over(w)).withColumn("prev", F.lag("pos").over(w)).where("prev is not null")
    r = F.row_number().over(Window.partitionBy("seq_id", "seg", "_b").orderBy("pos"))
    return u.withColumn("_r", r).where(F.col("_r") <= most).select("seq_id", F.col("prev").alias("a"), F.col("pos").alias("b"), (1 - F.col("_b")).alias("label"))


def robustness(settings: list[tuple[str, DataFrame]]) -> DataFrame:
    """(setting, n, pk, wd, f1, is_best_pk, is_best_wd, is_best_balanced) of choices (seq_id, method, pk, wd, f1) under several settings, a short list, and which setting is best by (pk, wd),
    (wd, pk) and ((pk + wd) / 2, pk); the first in order of names on a tie."""
    rows = None
    for name, choice in settings:
        part = choice.agg(F.lit(name).alias("setting"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("pk", "wd", "f1")))
        rows = part if rows is None else rows.union(part)
    pk, wd = F.round("pk", 9), F.round("wd", 9)
    keys = {"is_best_pk": F.struct(pk, wd, "setting"), "is_best_wd": F.struct(wd, pk, "setting"), "is_best_balanced": F.struct(F.round((F.col("pk") + F.col("wd")) / 2, 9), pk, "setting")}
    best = rows.agg(*(F.min_by("setting", k).alias(c) for c, k in keys.items()))
    return rows.join(F.broadcast(best)).select("setting", "n", "pk", "wd", "f1", *((F.col("setting") == F.col(c)).alias(c) for c in keys))
