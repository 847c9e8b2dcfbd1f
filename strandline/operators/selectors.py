"""Learned choice of a method for each sequence: one ridge regression over all (method, sequence) rows, refitted without each sequence, without each group of
sequences, or, for guarded choices, without each pair of sequences.

A row's features are those of its sequence, then of its method among the candidates of the fit: the place in their ranking and the means of pk, wd and f1 over the training sequences.
The latter change with each sequence left out, and so do the candidates, the medians that stand for missing features and the scaling. None of this needs another pass over the rows: counts, sums
and products of the sequences' features for each method (`moments`) are aggregated once, and a fit's normal equations are these, less the parts of the sequences left out, weighted by the
candidates. A fit then costs what its small matrices cost, whatever the number of rows, and fits run where the rows of the left-out sequences lie. Missing features enter as zeros with an
indicator, so a fit's own medians are put in afterwards by one linear map.

On the driver are the moments of MOST_METHODS methods (of each group, in all MOST_PAIRS) and the values around the medians; each is bounded, and more raises an error.

Fixed values of the method: penalty 10, at most 80 candidates, coverage of at least max(3, half-even 0.8 of the training sequences), the margins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import trees
from .stats import before

MOST_METHODS, MOST_PAIRS, MOST_SETS = 500, 20_000, 200
#: Sequences that a task of trees holds; beyond that, or with missing features, each fold's rows are dealt out.
MOST_LEFT_OUT = 100_000
#: Sequences of a block, two of which meet in a task, and fits that are solved together.
BLOCK, FITS = 256, 128
MARGINS = (-0.01, -0.005, 0.0, 0.0025, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12)
PRIMARY = {"pk": ((1.0, 0.0), (0.0, 1.0)), "wd": ((0.0, 1.0), (1.0, 0.0)), "balanced": ((0.5, 0.5), (1.0, 0.0))}
METRICS = ["pk", "wd", "f1"]


@dataclass
class Moments:
    """Of each method: rows n, sums s and products a of features, sums t of features times the target, sums y of the metrics; and the number of sequences."""

    n: np.ndarray
    s: np.ndarray
    a: np.ndarray
    t: np.ndarray
    y: np.ndarray
    sequences: int

    def less(self, o: Moments) -> Moments:
        return Moments(*(getattr(self, k) - getattr(o, k) for k in ("n", "s", "a", "t", "y", "sequences")))


@dataclass
class Problem:
    names: list[str]
    columns: list[str]
    missing: list[int]
    moments: Moments
    primary: str
    top: int
    penalty: float
    baseline: int | None = None
    #: For a set of methods as a mask and a column of `missing`: (rows before the window, values of the window, all rows).
    windows: dict | None = None

    def target(self, v: np.ndarray) -> np.ndarray:
        return v[..., :2] @ np.array(PRIMARY[self.primary][0])


def pooled(features: DataFrame, columns: list[str], cube: DataFrame, by: str | None) -> tuple[DataFrame, list[int]]:
    """A stored table of rows (seq_id, g, method, u, pk, wd, f1), and the columns that miss values: u has the features less their means, 0 where missing, then an indicator for each such column."""
    about = features.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    missing = [i for i in range(len(columns)) if about[f"n_{i}"]]
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") - F.lit(about[f"m_{i}"] if about[f"m_{i}"] == about[f"m_{i}"] else 0.0)) for i, c in enumerate(columns)]
    u = F.array(*[F.coalesce(k, F.lit(0.0)) for k in known], *[F.isnull(known[i]).cast("double") for i in missing])
    x = features.select("seq_id", (F.col(by) if by else F.lit(0)).cast("string").alias("g"), u.alias("u"))
    rows = x.join(cube.where(F.col("pk").isNotNull() & F.col("wd").isNotNull()).select("seq_id", "method", *(F.col(c).cast("double").alias(c) for c in METRICS)).fillna(0.0, ["f1"]), "seq_id")
    return stored(rows, "cube"), missing


def moments(rows: DataFrame, width: int, primary: str, by: bool) -> tuple[list[str], dict[str, Moments]]:
    """The methods in order, and the moments of each group (of one group without `by`)."""
    first = PRIMARY[primary][0]
    y, at = F.col("pk") * first[0] + F.col("wd") * first[1], lambda i: F.col("u")[i]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(at(i)).alias(f"s_{i}") for i in range(width)] + [F.sum(at(i) * at(j)).alias(f"a_{i}_{j}") for i, j in pairs] + [F.sum(at(i) * y).alias(f"t_{i}") for i in range(width)]
    most = MOST_PAIRS if by else MOST_METHODS
    found = rows.groupBy("g", "method").agg(F.count("*").alias("n"), *sums, *(F.sum(c).alias(c) for c in METRICS)).limit(most + 1).collect()
    if len(found) > most or len({r["method"] for r in found}) > MOST_METHODS:
        raise ValueError(f"more than {most} sums or {MOST_METHODS} methods")
    sequences = dict(map(tuple, rows.groupBy("g").agg(F.count_distinct("seq_id")).collect()))
    names = sorted({r["method"] for r in found})
    m = len(names)
    out = {g: Moments(np.zeros(m), np.zeros((m, width)), np.zeros((m, width, width)), np.zeros((m, width)), np.zeros((m, 3)), n) for g, n in sequences.items()}
    for r in found:
        o, i = out[r["g"]], names.index(r["method"])
        o.n[i], o.s[i], o.t[i], o.y[i] = r["n"], [r[f"s_{k}"] for k in range(width)], [r[f"t_{k}"] for k in range(width)], [r[c] for c in METRICS]
        for j, k in pairs:
            o.a[i, j, k] = o.a[i, k, j] = r[f"a_{j}_{k}"]
    return names, out


def candidates(p: Problem, base: Moments, has: np.ndarray, values: np.ndarray, can: np.ndarray) -> tuple[np.ndarray, ...]:
    """For fits without the sequences that `has` (fits, left, methods) and `values` (..., metrics) tell of: rows n and means of each method, which methods take part, in which place.
    `can` says which methods have the sequence that is asked about."""
    n = base.n - has.sum(1)
    mean = np.where(n[..., None] > 0, (base.y - (has[..., None] * values).sum(1)) / np.maximum(n, 1)[..., None], [1.0, 1.0, 0.0])
    one, two = (np.round(mean[..., :2] @ np.array(w), 12) for w in PRIMARY[p.primary])
    covered = n >= max(3, round(0.8 * (base.sequences - has.shape[1])))
    order = np.lexsort((np.broadcast_to(np.arange(len(p.names)), one.shape), two, np.where(covered, one, np.inf)), axis=-1)
    rank = np.argsort(order, axis=-1)
    part = covered & (rank < p.top) & can
    inside = np.take_along_axis(part, order, -1)
    place = np.take_along_axis(np.cumsum(inside, -1) - 1, rank, -1)
    if p.baseline is not None:  # the baseline always takes part, before all others if it isn't a candidate
        extra = ~part[:, p.baseline] & can[:, p.baseline]
        place = place + extra[:, None]
        place[extra, p.baseline] = 0
        part = part.copy()
        part[extra, p.baseline] = True
    return n, mean, part, place


def medians(p: Problem, part: np.ndarray, u: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The median of each column of `missing` over the rows of each fit (fits, columns)."""
    out = np.zeros((len(part), len(p.missing)))
    for f, mask in enumerate(part):
        key = "".join("01"[int(x)] for x in mask)
        for k, column in enumerate(p.missing):
            before_, window, total = p.windows[key, k]
            gone = [(x[column], int((h & mask).sum())) for x, h in zip(u[f], has[f], strict=True) if not x[len(p.columns) + k]]
            rest, skip = window, before_
            low = 0
            for v, c in gone:  # rows of the sequences left out: those before the window shift it, those within leave it
                total -= c
                if len(window) and v < window[0]:
                    low += c
                    continue
                at = np.searchsorted(rest, v)
                rest = np.delete(rest, slice(at, min(at + c, int(np.searchsorted(rest, v, "right")))))
            if total > 0:
                skip -= low
                out[f, k] = (rest[(total - 1) // 2 - skip] + rest[total // 2 - skip]) / 2
    return out


def fitted(p: Problem, base: Moments, u: np.ndarray, has: np.ndarray, values: np.ndarray, x: np.ndarray, can: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictions (fits, methods), infinite where a method takes no part, and the methods' places. Each fit goes without the sequences of features u (fits, left, width),
    results `has` and `values`, and is asked about the sequence of features x (fits, width) that the methods of `can` have."""
    n, mean, part, place = candidates(p, base, has, values, can)
    d = len(p.columns)
    count = part.sum(1)
    c = np.concatenate(((place / np.maximum(1, count - 1)[:, None])[..., None], mean), -1) * part[..., None]
    w = part * n
    total = w.sum(1)
    gone = (has & part[:, None, :]).astype(float)
    turned = u.transpose(0, 2, 1)
    target = p.target(values)
    sx = part @ base.s - (turned @ gone.sum(2)[..., None])[..., 0]
    xx = np.einsum("fm,mpq->fpq", part, base.a, optimize=True) - turned @ (gone.sum(2)[..., None] * u)
    xy = part @ base.t - (turned @ (gone * target).sum(2)[..., None])[..., 0]
    xc = base.s.T @ c - turned @ (gone @ c)
    cc = c.transpose(0, 2, 1) @ (w[..., None] * c)
    ym = (p.target(base.y) - (gone * target).sum(1)) * part
    cy = np.einsum("fm,fmk->fk", ym, c)
    at = x
    if p.missing:  # the medians stand for missing features
        fill = np.tile(np.concatenate((np.eye(d), np.zeros((d, u.shape[2] - d))), 1), (len(x), 1, 1))
        fill[:, p.missing, d + np.arange(len(p.missing))] = medians(p, part, u, has)
        sx, xy, xc, at = (np.einsum("fdp,fp...->fd...", fill, z) for z in (sx, xy, xc, x))
        xx = np.einsum("fdp,fpq,feq->fde", fill, xx, fill, optimize=True)
    size = np.maximum(total, 1)[:, None]
    mu = np.concatenate((sx, np.einsum("fm,fmk->fk", w, c)), 1) / size
    whole = np.concatenate((np.concatenate((xx, xc), 2), np.concatenate((xc.transpose(0, 2, 1), cc), 2)), 1)
    cov = whole / size[..., None] - mu[:, :, None] * mu[:, None, :]
    var = np.einsum("fdd->fd", cov)
    scale = np.sqrt(np.where(var > 1e-12 * (1 + mu**2), var, 1.0))
    mean_y = ym.sum(1) / size[:, 0]
    right = (np.concatenate((xy, cy), 1) - total[:, None] * mu * mean_y[:, None]) / scale
    left = total[:, None, None] * cov / (scale[:, :, None] * scale[:, None, :]) + p.penalty * np.eye(mu.shape[1])
    weights = np.linalg.solve(left, right[..., None])[..., 0] / scale
    z = np.concatenate((np.broadcast_to(at[:, None, :], (*part.shape, d)), c), 2)
    predicted = mean_y[:, None] + ((z - mu[:, None, :]) @ weights[..., None])[..., 0]
    return np.where(part, predicted, np.inf), place


def best(predicted: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The method of least prediction, the first in place among equals."""
    least = predicted == predicted.min(1, keepdims=True)
    return np.where(least, place, np.iinfo(np.int64).max).argmin(1)


def sequences(rows: DataFrame) -> DataFrame:
    """(seq_id, g, u, r): a row for each sequence with its results, one of each method at most."""
    return rows.groupBy("seq_id", "g").agg(F.first("u").alias("u"), F.collect_list(F.struct("method", *METRICS)).alias("r"))


def arrays(p: Problem, some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, width), which methods have a result (n, methods), and the results (n, methods, metrics)."""
    at = {m: i for i, m in enumerate(p.names)}
    u = np.array(some["u"].tolist(), float).reshape(len(some), -1)
    has, values = np.zeros((len(some), len(at)), bool), np.zeros((len(some), len(at), 3))
    for k, results in enumerate(some["r"]):
        for r in results:
            has[k, at[r["method"]]], values[k, at[r["method"]]] = True, [r[c] for c in METRICS]
    return u, has, values


def problem(rows: DataFrame, missing: list[int], columns: list[str], primary: str, top: int, penalty: float, by: str | None, baseline: str | None = None, fill: bool = True) -> tuple[Problem, DataFrame, dict[str, Moments]]:
    """The problem, the sequences, and the moments to fit on for each group (for "0" without groups, where sequences are left out one by one). `fill`: find what medians need, if features are missing."""
    names, own = moments(rows, len(columns) + len(missing), primary, bool(by))
    every = next(iter(own.values()))
    every = replace(every) if len(own) == 1 else Moments(*(sum(getattr(o, k) for o in own.values()) for k in ("n", "s", "a", "t", "y", "sequences")))
    p = Problem(names, columns, missing, every, primary, top, penalty, names.index(baseline) if baseline is not None else None)
    bases = {g: every.less(o) for g, o in own.items()} if by else {"0": every}
    people = sequences(rows)
    if missing and fill:
        p.windows = windows(p, people, rows, bases, bool(by))
    return p, people, bases


def windows(p: Problem, people: DataFrame, rows: DataFrame, bases: dict[str, Moments], by: bool) -> dict:
    """The values around the median of each column of `missing`, over the rows of each set of methods that a fit may have: what a fit leaves out moves its median within them."""
    if by:
        raise ValueError("features must not be missing where groups are left out")

    def run(batches):
        for b in batches:
            _, has, values = arrays(p, b)
            sets = set()
            for one in range(len(b)):
                part = candidates(p, bases["0"], has[one : one + 1, None], values[one : one + 1, None], has[one : one + 1])[2]
                sets.add("".join("01"[int(x)] for x in part[0]))
            yield pd.DataFrame({"s": sorted(sets)})

    found = {r[0] for r in people.select("seq_id", "u", "r").mapInPandas(run, "s string").distinct().limit(MOST_SETS + 1).collect()}
    if len(found) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets of candidates with missing features")
    out, reach = {}, len(p.names) + 1
    spread = rows.withColumn("s", F.explode(F.array(*map(F.lit, sorted(found)))))
    index = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(p.names) for x in (m, i + 1)]), F.col("method"))
    spread = spread.withColumn("i", index).where("substring(s, i, 1) = '1'")
    for k, column in enumerate(p.missing):
        v = spread.where(F.col("u")[len(p.columns) + k] == 0).select("s", F.col("u")[column].alias("v"))
        total = v.groupBy("s").agg(F.count("*").alias("n"))
        near = before(v.groupBy("s", "v").agg(F.count("*").alias("c")), ["s"], "v", "c").join(total, "s")
        near = near.where((F.col("_before") <= F.col("n") / 2 + reach) & (F.col("_before") + F.col("c") >= F.col("n") / 2 - reach)).orderBy("s", "v")
        for r in near.collect():
            first, values, n = out.get((r["s"], k), (r["_before"], [], r["n"]))
            out[r["s"], k] = first, [*values, *([r["v"]] * r["c"])], n
        for s in found:
            out.setdefault((s, k), (0, [], 0))
    return {key: (first, np.array(values), n) for key, (first, values, n) in out.items()}


def predictions(features: DataFrame, columns: list[str], cube: DataFrame, primary: str = "pk", top: int = 80, penalty: float = 10.0, by: str | None = None, baseline: str | None = None) -> DataFrame:
    """(seq_id, method, place, predicted, pk, wd, f1): what the regression without a sequence (or, with `by`, without all sequences of its group) predicts of each candidate method.

    Results without pk or wd take no part; sequences without a candidate give no rows; missing features take the median of the training rows; other columns are ignored; empty tables give no rows."""
    rows, missing = pooled(features, columns, cube, by)
    if rows.isEmpty():
        return features.sparkSession.createDataFrame([], f"seq_id {dict(features.dtypes)['seq_id']}, method string, place int, predicted double, pk double, wd double, f1 double")
    p, people, bases = problem(rows, missing, columns, primary, top, penalty, by, baseline)

    def run(batches):
        for b in batches:
            for g, some in b.groupby(b["g"] if by else np.zeros(len(b), int)):
                base = bases[g if by else "0"]
                for i in range(0, len(some), FITS):
                    part = some.iloc[i : i + FITS]
                    u, has, values = arrays(p, part)
                    gone = slice(0, 0) if by else slice(0, 1)  # a group is gone from its base already
                    got, place = fitted(p, base, u[:, None][:, gone], has[:, None][:, gone], values[:, None][:, gone], u, has)
                    f, m = np.nonzero(np.isfinite(got))
                    yield pd.DataFrame({"seq_id": part["seq_id"].to_numpy()[f], "method": np.array(p.names, object)[m], "place": place[f, m].astype(np.int32), "predicted": got[f, m], **{c: values[f, m, k] for k, c in enumerate(METRICS)}})

    return people.mapInPandas(run, f"seq_id {dict(people.dtypes)['seq_id']}, method string, place int, predicted double, pk double, wd double, f1 double")


def chosen(predicted: DataFrame) -> DataFrame:
    """(seq_id, method, predicted, pk, wd, f1): the method of least prediction, the first in place among equals."""
    return predicted.groupBy("seq_id").agg(F.min_by(F.struct("method", "predicted", *METRICS), F.struct("predicted", "place")).alias("b")).select("seq_id", "b.*")


def guarded(features: DataFrame, columns: list[str], cube: DataFrame, baseline: str, primary: str = "pk", top: int = 80, penalty: float = 10.0, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """(seq_id, method, best_method, threshold, margin, switched, inner_switch_rate): the method of least prediction where it is predicted better than the baseline by a margin, which
    is chosen for each sequence by fits without it and without each other sequence in turn: the margin under which the others' choices are best to four digits, then of fewest switches.

    That is a fit for each ordered pair of sequences, as the method is defined. Sequences meet in pairs of blocks; a pair of blocks adds up what each margin gives, so n rows a block leave
    it, not n * n. Only sequences with a result of the baseline take part; missing features aren't taken here."""
    known = stored(cube.where(F.col("pk").isNotNull() & F.col("wd").isNotNull()), "results")
    cube = known.join(known.where(F.col("method") == baseline).select("seq_id").distinct(), "seq_id", "left_semi")
    rows, missing = pooled(features, columns, cube, None)
    p, people, bases = problem(rows, missing, columns, primary, top, penalty, None, baseline, fill=False)
    if p.missing:
        raise ValueError("features must not be missing in nested fits")
    blocks = -(-p.moments.sequences // BLOCK)
    key = dict(people.dtypes)["seq_id"]
    mine = F.pmod(F.xxhash64("seq_id"), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    outer = people.select("seq_id", "u", "r", mine.alias("a"), each.alias("b"), F.lit(True).alias("outer"))
    inner = people.select("seq_id", "u", "r", each.alias("a"), mine.alias("b"), F.lit(False).alias("outer"))
    grid = np.array(margins)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, held = rows[rows["outer"]], rows[~rows["outer"]]
        u1, has1, values1 = arrays(p, out)
        u2, has2, values2 = arrays(p, held)
        ids, found = held["seq_id"].to_numpy(), []
        for k, seq in enumerate(out["seq_id"]):
            sums, n = np.zeros((3, len(grid))), 0
            others = np.flatnonzero(ids != seq)
            for i in range(0, len(others), FITS):
                o = others[i : i + FITS]
                both = [np.stack((np.broadcast_to(a[k], b[o].shape), b[o]), 1) for a, b in ((u1, u2), (has1, has2), (values1, values2))]
                got, place = fitted(p, bases["0"], *both, u2[o], has2[o])
                top_method, f = best(got, place), np.arange(len(o))
                switch = (got[:, p.baseline] - got[f, top_method])[:, None] >= grid
                for c in range(2):
                    sums[c] += np.where(switch, values2[o, top_method, c][:, None], values2[o, p.baseline, c][:, None]).sum(0)
                sums[2] += switch.sum(0)
                n += len(o)
            found.append((seq, *sums.tolist(), n))
        return pd.DataFrame(found, columns=["seq_id", "pk", "wd", "switches", "n"])

    parts = outer.union(inner).groupBy("a", "b").applyInPandas(run, f"seq_id {key}, pk array<double>, wd array<double>, switches array<double>, n long")
    sums = parts.groupBy("seq_id").agg(*(F.array(*(F.sum(F.col(c)[i]) for i in range(len(margins)))).alias(c) for c in ("pk", "wd", "switches")), F.sum("n").alias("n"))
    score = lambda w, i: F.round((F.col("pk")[i] * w[0] + F.col("wd")[i] * w[1]) / F.col("n"), 4)
    ranked = F.array_min(F.array(*(F.struct(*(score(w, i).alias(f"s{j}") for j, w in enumerate(PRIMARY[primary])), F.col("switches")[i].alias("k"), F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(margins))))
    chosen_at = sums.withColumn("_b", F.when(F.col("n") > 0, ranked)).select("seq_id", F.coalesce("_b.t", F.lit(float("inf"))).alias("threshold"), F.coalesce(F.element_at("switches", F.col("_b.i") + 1) / F.col("n"), F.lit(0.0)).alias("inner_switch_rate"))
    scores = predictions(features, columns, cube, primary, top, penalty, None, baseline)
    asked = scores.groupBy("seq_id").agg(F.min_by("method", F.struct("predicted", "place")).alias("best_method"), (F.max(F.when(F.col("method") == baseline, F.col("predicted"))) - F.min("predicted")).alias("margin"))
    leaves = F.col("margin") >= F.col("threshold")
    method = F.when(leaves, F.col("best_method")).otherwise(F.lit(baseline))
    return asked.join(chosen_at, "seq_id").select("seq_id", method.alias("method"), "best_method", "threshold", "margin", (method != baseline).alias("switched"), "inner_switch_rate")


def training_rows(features: DataFrame, columns: list[str], cube: DataFrame, primary: str = "pk", top: int = 80, by: str | None = None, baseline: str | None = None) -> DataFrame:
    """(fold, key, train, x, y) for learners that need rows, not moments: a fold for each sequence left out, or, with `by`, for each group and set of methods that its sequences
    have, with the rows it trains on and those it is asked about; key is (seq_id, method, place, pk, wd, f1), x has missing features filled by the fold's medians.

    A fold reads all other rows, as leaving each sequence out is defined: n folds of n sequences each. Where that is too much, give `by` a column of a few groups."""
    return dealt(*pooled(features, columns, cube, by), columns, primary, top, by, baseline)


def dealt(rows: DataFrame, missing: list[int], columns: list[str], primary: str, top: int, by: str | None, baseline: str | None) -> DataFrame:
    """The training rows of pooled ones."""
    p, people, bases = problem(rows, missing, columns, primary, top, 10.0, by, baseline, fill=False)
    kind = dict(people.dtypes)["seq_id"]

    def run(batches):
        for b in batches:
            u, has, values = arrays(p, b)
            found = []
            for k, (seq, g) in enumerate(zip(b["seq_id"], b["g"], strict=True)):
                gone = slice(k, k) if by else slice(k, k + 1)
                _, mean, part, place = candidates(p, bases[g if by else "0"], has[None, gone], values[None, gone], has[k : k + 1])
                mask = "".join("01"[int(x)] for x in has[k])
                for m in np.flatnonzero(part[0]):
                    c = [place[0, m] / max(1, part.sum() - 1), *mean[0, m]]
                    found.append((seq, f"{g}|{mask}" if by else str(seq), g if by else str(seq), p.names[m], int(place[0, m]), c))
            yield pd.DataFrame(found, columns=["seq_id", "fold", "out", "method", "place", "c"])

    asked = people.mapInPandas(run, f"seq_id {kind}, fold string, out string, method string, place int, c array<double>")
    first = PRIMARY[primary][0]
    rows = rows.select("seq_id", F.col("g" if by else "seq_id").cast("string").alias("own"), "method", "u", (F.col("pk") * first[0] + F.col("wd") * first[1]).alias("y"), *METRICS)
    # Rows of a method are many and methods few, so settings and rows also meet by blocks: of folds, or, where groups are few and their settings with them, of sequences. Only the other side is copied.
    blocks = -(-p.moments.sequences // BLOCK)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    settings = asked.select("fold", "out", "method", "c").distinct().withColumn("b", each if by else block("fold"))
    train = rows.withColumn("b", block("seq_id") if by else each).join(settings, ["method", "b"]).where("own <> out")
    key = lambda place: F.struct("seq_id", "method", place.alias("place"), *METRICS)
    x = F.concat("u", "c")
    train = train.select("fold", key(F.lit(None).cast("int")).alias("key"), F.lit(True).alias("train"), x.alias("x"), "y")
    tests = asked.join(rows, ["seq_id", "method"]).select("fold", key(F.col("place")).alias("key"), F.lit(False).alias("train"), x.alias("x"), F.lit(None).cast("double").alias("y"))
    every, d = train.union(tests), len(columns)
    if not p.missing:
        return every
    middle = every.where("train").groupBy("fold").agg(F.array(*[F.coalesce(F.median(F.when(F.col("x")[d + k] == 0, F.col("x")[i])), F.lit(0.0)) for k, i in enumerate(p.missing)]).alias("m"))
    filled = [F.when(F.col("x")[d + p.missing.index(i)] == 1, F.col("m")[p.missing.index(i)]).otherwise(F.col("x")[i]) if i in p.missing else F.col("x")[i] for i in range(d)]
    after = d + len(p.missing)
    return every.join(middle, "fold", "left").select("fold", "key", "train", F.concat(F.array(*filled), F.slice("x", after + 1, 4)).alias("x"), "y")


def left_out_by_trees(rows: DataFrame, columns: list[str], primary: str, top: int, baseline: str | None, count: int, leaf: int, seed: int) -> DataFrame:
    """Predictions by trees without each sequence, of pooled rows that miss no feature: some trees of all folds with the same candidates are one task's, which reads all sequences."""
    p, people, bases = problem(rows, [], columns, primary, top, 10.0, None, baseline, fill=False)
    key, m = dict(people.dtypes)["seq_id"], len(p.names)

    def about(batches):
        for b in batches:
            u, has, values = arrays(p, b)
            _, mean, part, place = candidates(p, bases["0"], has[:, None], values[:, None], has)
            c = np.concatenate(((place / np.maximum(1, part.sum(1) - 1)[:, None])[..., None], mean), -1)
            masks = ["".join("01"[int(x)] for x in one) for one in part]
            found = np.where(has[..., None], values, np.nan).reshape(len(b), -1)
            yield pd.DataFrame({"seq_id": b["seq_id"], "u": list(u), "v": list(found), "place": list(place.astype(np.int32)), "c": list(c.reshape(len(b), -1)), "mask": masks})

    told = stored(people.mapInPandas(about, f"seq_id {key}, u array<double>, v array<double>, place array<int>, c array<double>, mask string"), "left_out")
    masks = told.where(F.contains("mask", F.lit("1"))).select(F.col("mask").alias("m")).distinct()
    chunks = -(-count // trees.CHUNK)
    parts = told.crossJoin(masks).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(trees.PARTS, "m", "i")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        mask, first = part["m"].iloc[0], int(part["i"].iloc[0]) * trees.CHUNK
        mine = np.flatnonzero([x == "1" for x in mask])
        part = part.sort_values("seq_id")
        table = lambda c, *shape: np.array(part[c].tolist(), float).reshape(len(part), *shape)
        values, places, asked = table("v", m, 3)[:, mine], table("place", m)[:, mine], (part["mask"] == mask).to_numpy()
        owner, kind = np.nonzero(~np.isnan(values[:, :, 0]))
        y = p.target(values[owner, kind])
        roots = trees.long_hash(seed, np.arange(first, min(count, first + trees.CHUNK)))
        got = trees.left_out(table("u", len(columns)), table("c", m, 4)[:, mine], asked, owner, kind, y, roots, leaf)
        at = np.flatnonzero(asked[owner])
        o, k = owner[at], kind[at]
        results = {c: values[o, k, i] for i, c in enumerate(METRICS)}
        return pd.DataFrame({"seq_id": part["seq_id"].to_numpy()[o], "method": np.array(p.names, object)[mine[k]], "place": places[o, k].astype(np.int32), "s": got[at], "n": len(roots), **results})

    found = parts.groupBy("m", "i").applyInPandas(run, f"seq_id {key}, method string, place int, s double, n int, pk double, wd double, f1 double")
    return found.groupBy("seq_id", "method").agg(F.first("place").alias("place"), (F.sum("s") / F.sum("n")).alias("predicted"), *(F.first(c).alias(c) for c in METRICS))


def tree_predictions(features: DataFrame, columns: list[str], cube: DataFrame, primary: str = "pk", top: int = 80, by: str | None = None, baseline: str | None = None, count: int = 500, leaf: int = 3, seed: int = 17) -> DataFrame:
    """As `predictions`, by extremely randomised trees in place of the regression."""
    pool, missing = pooled(features, columns, cube, by)
    if not by and not missing and not pool.isEmpty() and pool.select("seq_id").distinct().count() <= MOST_LEFT_OUT:
        return left_out_by_trees(pool, columns, primary, top, baseline, count, leaf, seed)
    rows = dealt(pool, missing, columns, primary, top, by, baseline)
    found = trees.extra_trees(rows, len(columns) + 4, count, leaf, seed)
    return found.select("key.seq_id", "key.method", "key.place", "predicted", *(f"key.{c}" for c in METRICS))
