"""Pipelines of Spark ML fitted with folds of sequences left out. The selectors of methods are in `selectors`, extremely randomised trees in `trees`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored


def estimator(kind: str, label: str, seed: int = 42, weight: str | None = None):
    """ridge, forest (regression); logistic, boosted, forest_class (classification)."""
    more = {"weightCol": weight} if weight else {}
    return {
        "ridge": lambda: LinearRegression(featuresCol="x", labelCol=label, regParam=1.0, elasticNetParam=0.0, solver="normal"),
        "forest": lambda: RandomForestRegressor(featuresCol="x", labelCol=label, numTrees=20, maxDepth=5, seed=seed),
        "logistic": lambda: LogisticRegression(featuresCol="x", labelCol=label, maxIter=50, **more),
        "boosted": lambda: GBTClassifier(featuresCol="x", labelCol=label, maxIter=10, maxDepth=3, seed=seed, **more),
        "forest_class": lambda: RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=20, maxDepth=5, seed=seed, **more),
    }[kind]()


def pipeline(kind: str, features: list[str], label: str, weight: str | None = None) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), estimator(kind, label, weight=weight)])


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds `weight`, so that both classes weigh alike."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_t"))
    return rows.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")


def by_fold(rows: DataFrame, features: list[str], label: str, kind: str, folds: int = 5, key: str = "seq_id", weight: str | None = None) -> DataFrame:
    """Rows with an out-of-fold `prediction` (and `probability` of class 1 for classifiers). Sequences are dealt into folds by a hash, so none is in both sides.
    Fits pass over the rows many times, so these are stored first and not made again for each pass."""
    rows = stored(rows.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))), "folds")
    out = None
    for f in range(folds):  # a fixed small number of fits
        model = pipeline(kind, features, label, weight).fit(rows.where(F.col("_fold") != f))
        got = model.transform(rows.where(F.col("_fold") == f)).drop("raw", "x", "rawPrediction")
        out = got if out is None else out.unionByName(got)
    return out.drop("_fold")


#: A fit for each method and fold.
MOST_METHODS = 500


def select_methods(features: DataFrame, columns: list[str], cube: DataFrame, kind: str = "ridge", metric: str = "pk", folds: int = 5, margin: float = 0.0, default: str | None = None) -> DataFrame:
    """(seq_id, method, predicted, value): for each sequence the method of least predicted metric, out of fold. With a default and a margin, the choice only leaves the
    default if it is predicted to be better by more than the margin."""
    methods = [r[0] for r in cube.select("method").distinct().orderBy("method").limit(MOST_METHODS + 1).collect()]
    if len(methods) > MOST_METHODS:
        raise ValueError(f"more than {MOST_METHODS} methods")
    every = None
    for m in methods:  # a short list of methods
        rows = features.join(cube.where(F.col("method") == m).select("seq_id", F.col(metric).alias("y")), "seq_id")
        got = by_fold(rows, columns, "y", kind, folds).select("seq_id", F.lit(m).alias("method"), F.col("prediction").alias("predicted"), F.col("y").alias("value"))
        every = got if every is None else every.union(got)
    rank = F.col("predicted") - (F.when(F.col("method") == F.lit(default), margin).otherwise(0.0) if default else F.lit(0.0))
    return every.groupBy("seq_id").agg(F.min_by(F.struct("method", "predicted", "value"), F.struct(rank, "method")).alias("b")).select("seq_id", "b.*")


#: Folds whose fits go on together, all folds, and steps of a fit at most; rows that meet them at a time.
TOGETHER, MOST_FOLDS, STEPS = 1024, 100_000, 60
ROWS = 256


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def gradient(a: np.ndarray, y: np.ndarray, own: np.ndarray, u: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The gradient of each fold's loss at its weights u over rows a of labels y, by class weights k; a row takes no part in the fold `own`, if that is not negative. Rows meet
    the folds in blocks, so that what is held is ROWS times folds, whatever the batch."""
    out = np.zeros_like(u)
    for i in range(0, len(a), ROWS):
        b, one, mine = a[i : i + ROWS], y[i : i + ROWS] == 1, own[i : i + ROWS]
        r = sigmoid(b @ u.T)
        r -= one[:, None]
        r *= np.where(one[:, None], k[:, 1], k[:, 0])
        some = np.flatnonzero(mine >= 0)
        r[some, mine[some]] = 0.0
        out += r.T @ b
    return out


def vectors(held: list[np.ndarray], width: int) -> pa.Array:
    """Rows of doubles as an Arrow list column, without a Python object for each number."""
    flat = np.concatenate(held) if held else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * width, pa.int32()), pa.array(flat))


def logistic_left_out(rows: DataFrame, features: list[str], label: str, by: str = "seq_id", strength: float = 0.35) -> DataFrame:
    """The rows with `probability` of label 1, by logistic regressions each fitted without one value of `by`: classes weighted alike, features scaled by the training rows' means and deviations,
    the L2 penalty 1 / (2 * strength), the intercept free.

    All regressions go on together. A first fit over all rows gives, with one more pass in which each row adds to its own fold only, the second derivatives of every fold's loss at that
    fit; from there each fold's weights take steps by these, and one pass a step gives the gradients of up to TOGETHER folds as one product of matrices. Folds lie so near the
    first fit that few steps are needed. A fold whose training rows are of one class predicts its share.

    Rows of null label or `by` take no part; null or non-finite features count as 0; an empty table gives no rows. What is on the driver grows with the folds, MOST_FOLDS at most."""
    spark, p = rows.sparkSession, len(features)
    clean = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    rows = rows.where(F.col(by).isNotNull() & F.col(label).isNotNull())
    base = stored(rows.withColumns({"_f": F.col(by).cast("string"), "_y": F.col(label).cast("double"), "_x": F.array(*map(clean, features))}), "examples")
    x = lambda i: F.col("_x")[i]
    about = base.agg(*[g(x(i)).alias(f"{n}_{i}") for i in range(p) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    middle, scale = (np.array([about[f"{n}_{i}"] or (n == "s") * 1.0 for i in range(p)], float) for n in "ms")
    z = lambda i: (x(i) - F.lit(float(middle[i]))) / F.lit(float(scale[i]))
    found = base.groupBy("_f").agg(F.count_if(F.col("_y") == 1).alias("n1"), F.count_if(F.col("_y") != 1).alias("n0"), *(F.sum(z(i)).alias(f"a_{i}") for i in range(p)), *(F.sum(z(i) * z(i)).alias(f"b_{i}") for i in range(p))).orderBy("_f").limit(MOST_FOLDS + 1).collect()
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    names = [r["_f"] for r in found]
    own = np.array([[r["n0"], r["n1"]] for r in found], float).reshape(-1, 2)
    n = own.sum(0) - own  # training rows of each class
    sums, squares = (np.array([[r[f"{c}_{i}"] for i in range(p)] for r in found], float).reshape(-1, p) for c in "ab")
    size = np.maximum(n.sum(1), 1)[:, None]
    mean = (sums.sum(0) - sums) / size
    var = (squares.sum(0) - squares) / size - mean**2
    # In units of all rows' deviations the penalty on a weight is the fold's own variance.
    penalty = np.column_stack((np.zeros(len(names)), np.where(var > 1e-12, var, 1.0))) / strength
    weight = lambda k: np.where(k > 0, k.sum(-1, keepdims=True) / (2 * np.maximum(k, 1)), 0.0)
    total = own.sum(0)
    all_weight, all_penalty = weight(total), np.concatenate(([0.0], np.ones(p))) / strength

    def matrices(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
        v = (np.asarray(b.column(2).flatten(), float).reshape(-1, p) - middle) / scale
        return np.column_stack((np.ones(len(v)), v)), np.asarray(b.column(1), float), b.column(0).to_pylist()

    def curves(w: np.ndarray, keys: bool):
        """Sums of gradient and second derivatives over the rows of each class (and fold) at weights w."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for b in batches:
                a, y, f = matrices(b)
                q = sigmoid(a @ w)
                codes = np.array([at[k] for k in f]) * keys
                for c in np.unique(codes * 2 + (y == 1)):
                    mine = codes * 2 + (y == 1) == c
                    g = (q[mine] - y[mine]) @ a[mine]
                    h = (a[mine] * (q[mine] * (1 - q[mine]))[:, None]).T @ a[mine]
                    held[int(c)] = held.get(int(c), 0.0) + np.concatenate((g, h.ravel()))
            codes, width = list(held), (p + 1) * (p + 2)
            for i in range(0, len(codes), TOGETHER):
                some = codes[i : i + TOGETHER]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), vectors([held.pop(c) for c in some], width)], names=["c", "v"])

        at = {k: i for i, k in enumerate(names)} if keys else dict.fromkeys(names, 0)
        parts = base.select("_f", "_y", "_x").mapInArrow(run, "c long, v array<double>")
        width = (p + 1) * (p + 2)
        return {r["c"]: np.array(r["v"]) for r in parts.groupBy("c").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v")).collect()}

    split = lambda v: (v[: p + 1], v[p + 1 :].reshape(p + 1, p + 1))
    none = np.zeros((p + 1) * (p + 2))
    w = np.zeros(p + 1)
    if names and (total > 0).all():
        for _ in range(STEPS):
            got = curves(w, False)
            g, h = split(sum(all_weight[c] * got.get(c, none) for c in (0, 1)))
            step = np.linalg.solve(h + np.diag(all_penalty) + 1e-12 * np.eye(p + 1), g + all_penalty * w)
            w = w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-4:  # a start for the folds
                break
    each = curves(w, True) if names else {}
    both = [sum((v for c, v in each.items() if c % 2 == k), none) for k in (0, 1)]
    fits = np.tile(w, (len(names), 1))
    for start in range(0, len(names), TOGETHER):
        folds = np.arange(start, min(start + TOGETHER, len(names)))
        folds = folds[(n[folds] > 0).all(1)]
        if not len(folds):
            continue
        class_weight = weight(n[folds])
        inverse = np.linalg.inv(np.stack([split(sum(class_weight[i, k] * (both[k] - each.get(2 * int(f) + k, none)) for k in (0, 1)))[1] + np.diag(penalty[f]) for i, f in enumerate(folds)]) + 1e-12 * np.eye(p + 1))
        place = {names[f]: i for i, f in enumerate(folds)}
        for _ in range(STEPS):
            shared = spark.sparkContext.broadcast((fits[folds], class_weight, place))

            def gradients(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                u, k, at = shared.value
                out = np.zeros_like(u)
                for b in batches:
                    a, y, f = matrices(b)
                    out += gradient(a, y, np.array([at.get(name, -1) for name in f], int), u, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), vectors(list(out), p + 1)], names=["i", "g"])

            got = base.select("_f", "_y", "_x").mapInArrow(gradients, "i long, g array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("g")[j]) for j in range(p + 1))).alias("g")).orderBy("i").collect()
            g = np.array([r["g"] for r in got]) + penalty[folds] * fits[folds]
            step = np.einsum("fij,fj->fi", inverse, g)
            fits[folds] -= np.clip(step, -5, 5)
            shared.unpersist()
            if np.abs(step).max() < 1e-8:
                break
    share = n[:, 1] / np.maximum(n.sum(1), 1)
    table = spark.createDataFrame([(k, float(s) if not (m > 0).all() else None, v.tolist()) for k, s, m, v in zip(names, share, n, fits, strict=True)], "_f string, _s double, _w array<double>")
    raw = F.aggregate(F.zip_with(F.array(*(z(i) for i in range(p))), F.slice("_w", 2, p), lambda a, b: a * b), F.col("_w")[0], lambda s, v: s + v)
    out = base.join(table, "_f").withColumn("probability", F.coalesce("_s", 1 / (1 + F.exp(-raw))))
    return out.drop("_f", "_y", "_x", "_s", "_w")
