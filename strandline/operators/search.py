"""Candidates and parameter search: recall of candidate lists, blended votes, and grids of parameters over all sequences at once."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grouped, metrics
from .align import within_band

#: Parameter points of one search; a grid is a table that the driver makes, so it is bounded.
MOST_POINTS = 10_000


def candidate_recall(candidates: DataFrame, refs: DataFrame, tolerance: int = 2) -> DataFrame:
    """(seq_id, n_refs, n_found, recall): reference boundaries with a candidate within the tolerance."""
    found = within_band(refs, candidates, tolerance).groupBy("seq_id").agg(F.count("*").alias("n_found"))
    n = refs.groupBy("seq_id").agg(F.count("*").alias("n_refs"))
    return n.join(found, "seq_id", "left").select("seq_id", "n_refs", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("n_found", F.lit(0)) / F.col("n_refs")).alias("recall"))


def vote_score(rows: DataFrame, weights: tuple[float, ...] = (0.45, 0.30, 0.15, 0.05, 0.05)) -> DataFrame:
    """(seq_id, boundary, score): blend of five columns a, b, c, d, e, each divided by its sequence's largest."""
    w = Window.partitionBy("seq_id")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
    return rows.select("seq_id", "boundary", sum((x * part(c) for c, x in zip("bcde", weights[1:], strict=True)), weights[0] * part("a")).alias("score"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of parameter values, numbered by `point`."""
    rows = [(i, *p) for i, p in enumerate(itertools.product(*values.values()))]
    if len(rows) > MOST_POINTS:
        raise ValueError(f"{len(rows)} points; at most {MOST_POINTS}")
    return spark.createDataFrame(rows, ["point", *values])


def random_weights(spark: SparkSession, names: list[str], n: int, seed: int = 42) -> DataFrame:
    """n points of weights that sum to one, uniform on the simplex, from a seeded generator."""
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; at most {MOST_POINTS}")
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.expovariate(1) for _ in names]
        rows.append((i, *(v / sum(x) for v in x)))
    return spark.createDataFrame(rows, ["point", *names])


def search_top_k(scores: DataFrame, refs: DataFrame, sizes: DataFrame, points: DataFrame) -> DataFrame:
    """(point, k, n, pk, wd): means over sequences of the k best boundaries for each point (point, k). Boundaries are ranked once; a point only cuts the ranking."""
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("score"), "boundary")))
    pairs = [(r["point"], r["k"]) for r in points.select("point", "k").limit(MOST_POINTS + 1).collect()]
    if len(pairs) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    ranked = ranked.where(F.col("_r") <= max(k for _, k in pairs))
    point = F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.lit(k).alias("k")) for p, k in pairs])).alias("_p")
    every = lambda df: df.select("*", point).select("*", "_p.k").withColumn("seq_id", F.struct("seq_id", "_p.point", "_p.k"))
    hyp = every(ranked).where(F.col("_r") <= F.col("k")).select("seq_id", "boundary")
    m = metrics.evaluate(hyp, every(refs).select("seq_id", "boundary"), every(sizes).select("seq_id", "n"), ())
    return m.groupBy(F.col("seq_id.point").alias("point"), F.col("seq_id.k").alias("k")).agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd"))


#: Weights by hand over edge, vote, agreement, mean_source, max_source, isolation, prosody, shots, density and source_std, and the choices of each point.
ANCHORS = (
    (0.05, 0.45, 0.15, 0.15, 0.25, 0.00, 0.02, 0.02, 0.10, 0.05),
    (0.02, 0.25, 0.25, 0.10, 0.25, 0.05, 0.02, 0.02, 0.20, 0.10),
    (0.05, 0.20, 0.30, 0.15, 0.20, 0.05, 0.00, 0.00, 0.25, 0.10),
)
SIGNALS = ["edge", "vote", "agreement", "mean_source", "max_source", "isolation", "prosody", "shots", "density", "source_std"]
ANCHORED = {"share": (0.55, 0.60, 0.65, 0.70), "least": (8, 10, 11, 12), "near": (2, 5, 8)}
DRAWN = {"share": (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75), "least": (6, 8, 10, 11, 12, 14, 16), "near": (2, 3, 5, 8, 10)}


def weight_points(n: int, seed: int = 41, anchors: bool = True) -> list[tuple[int, tuple[float, ...], float, int, int]]:
    """(point, weights, share, least, near): the weights by hand with every choice, and n drawn from a Dirichlet distribution (0.8) with choices drawn evenly."""
    fixed = [(w, *c) for w in ANCHORS for c in itertools.product(*ANCHORED.values())] if anchors else []
    rng = np.random.default_rng(seed)
    drawn = [(tuple(round(float(x), 9) for x in rng.dirichlet(np.full(len(SIGNALS), 0.8))), float(rng.choice(DRAWN["share"])), int(rng.choice(DRAWN["least"])), int(rng.choice(DRAWN["near"]))) for _ in range(n)]
    points = [(i, *p) for i, p in enumerate([*fixed, *drawn])]
    if len(points) > MOST_POINTS:
        raise ValueError(f"{len(points)} points; at most {MOST_POINTS}")
    return points


def chosen_by_weights(boundaries: np.ndarray, signals: np.ndarray, n: int, target: int, points: list[tuple]) -> list[tuple[int, int]]:
    """(point, boundary) of one sequence: signals (candidates x signals) by weights (signals x points) give all scores at once, and the greedy choices of all points go on together, one rank a step."""
    low, high = signals.min(0), signals.max(0)
    scaled = np.where(high > low, (signals - low) / np.where(high > low, high - low, 1.0), 0.0)
    scores = np.round(scaled @ np.array([p[1] for p in points]).T, 9)
    order = np.lexsort((np.broadcast_to(boundaries[:, None], scores.shape), -scores), axis=0)
    least, near = np.array([p[3] for p in points]), np.array([p[4] for p in points])
    most = np.array([max(1, round(target * p[2])) for p in points])
    held, count = np.full((len(points), int(most.max())), 1 << 40), np.zeros(len(points), int)
    for ranked in order:
        b = boundaries[ranked]
        away = np.abs(held - b[:, None]).min(1)
        good = (count < most) & (away > near) & (away >= least) & (b >= least) & (n - b >= least)
        held[np.flatnonzero(good), count[good]] = b[good]
        count += good
    return [(points[i][0], int(b)) for i in range(len(points)) for b in sorted(held[i, : count[i]])]


def weight_search(rows: DataFrame, sizes: DataFrame, targets: DataFrame, points: list[tuple], signals: list[str] | None = None) -> DataFrame:
    """(seq_id, point, boundary) of each point of `weight_points` on candidate rows (seq_id, boundary, signals), sizes (seq_id, n) and targets (seq_id, t). Null signals count 0."""
    signals = signals or SIGNALS

    def one(seq_id: int, pdf: pd.DataFrame) -> list[tuple]:
        x = pdf[signals].fillna(0.0).to_numpy(float)
        return [(seq_id, *r) for r in chosen_by_weights(pdf["boundary"].to_numpy(np.int64), x, int(pdf["n"].iloc[0]), int(pdf["t"].iloc[0]), points)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in grouped.sequences(batches, one):
            yield pd.DataFrame(out, columns=["seq_id", "point", "boundary"])

    each = rows.select("seq_id", "boundary", *signals).join(sizes, "seq_id").join(targets, "seq_id")
    return each.repartition("seq_id").sortWithinPartitions("seq_id", "boundary").mapInPandas(run, "seq_id long, point int, boundary int")
