"""Segmenters as table functions: a sequence in, boundaries of all asked methods out.

A sequence's vectors cross to Python once for all methods, so the table of methods is never joined to the vectors. Parallelism comes from sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import registry
from . import segmenters as S

BOUNDARIES = "seq_id long, method string, boundary int"


def run_methods(units: DataFrame, k: DataFrame | Callable[[int], int], methods: list[str], most_units: int | None = None, side: DataFrame | None = None, shots: DataFrame | None = None, errors: bool = False) -> DataFrame:
    """(seq_id, method, boundary) of units (seq_id, pos, vec1, vec2[, tokens]) with k (seq_id, k) segments asked for, or as many as
    a function gives for a sequence's number of units, which spares a pass. Whole sequences take part, unless
    `most_units` keeps the first so many units. `side` (prosody) and `shots` hold (seq_id, boundary, score). With `errors`, a failing method gives a row with its message."""
    parsed = {m: registry.parse(m) for m in methods}
    rows = units if most_units is None else units.where(F.col("pos") < most_units)
    tokens = "tokens" in units.columns
    count = k if callable(k) else None
    if count is None:
        rows = rows.join(k.select("seq_id", F.col("k").alias("_k")), "seq_id")
    for name, signal in (("_side", side), ("_shots", shots)):
        if signal is not None:
            rows = rows.join(signal.select("seq_id", F.col("boundary").alias("pos"), F.col("score").alias(name)), ["seq_id", "pos"], "left")

    def one(seq_id: int, pdf: pd.DataFrame) -> list[tuple]:
        x = registry.Input(
            np.array(pdf["vec1"].tolist(), np.float64), np.array(pdf["vec2"].tolist(), np.float64), count(len(pdf)) if count else int(pdf["_k"].iloc[0]),
            pdf["_side"].fillna(0).to_numpy() if side is not None else None, [list(t) for t in pdf["tokens"]] if tokens else None,
            shots=pdf["_shots"].fillna(0).to_numpy() if shots is not None else None,
        )
        out = []
        for name, m in parsed.items():
            try:
                out += [(seq_id, name, b, None) for b in registry.run(x, m)]
            except Exception as e:
                if not errors:
                    raise
                out.append((seq_id, name, None, repr(e)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in sequences(batches, one):
            got = pd.DataFrame(out, columns=["seq_id", "method", "boundary", "error"]).astype({"seq_id": "int64", "boundary": "Int32"})
            yield got if errors else got[["seq_id", "method", "boundary"]]

    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "pos").mapInPandas(run, BOUNDARIES + (", error string" if errors else ""))


def sequences(batches: Iterator[pd.DataFrame], f: Callable[[int, pd.DataFrame], list]) -> Iterator[list]:
    """f of each whole sequence in batches that are sorted by sequence and position; a sequence may span batches. Many short sequences share a batch, which spares
    the cost of a group each."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        ids = pdf["seq_id"].to_numpy()
        if not len(ids):
            continue
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
        held = pdf.iloc[edges[-1] :]  # the last may go on
        out = [r for a, e in zip(edges, edges[1:], strict=False) for r in f(int(ids[a]), pdf.iloc[a:e])]
        if out:
            yield out
    if held is not None and len(held):
        yield f(int(held["seq_id"].iloc[0]), held)


def per_sequence(units: DataFrame, f: Callable[[np.ndarray], list[int]], vec: str = "vec") -> DataFrame:
    """(seq_id, boundary) of any function from a matrix to boundaries."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf.sort_values("pos")[vec].tolist(), np.float64)
        return pd.DataFrame({"seq_id": key[0], "boundary": f(v)}, columns=["seq_id", "boundary"]).astype({"boundary": "int32"})

    return units.select("seq_id", "pos", vec).groupBy("seq_id").applyInPandas(run, "seq_id long, boundary int")


def dp_select(candidates: DataFrame, sizes: DataFrame, k: int, least: int = 5, strength: float = 0.3) -> DataFrame:
    """(seq_id, boundary): k candidates (seq_id, boundary, score) by dynamic programming with length penalties."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = S.dp_candidates(dict(zip(pdf["boundary"].tolist(), pdf["score"].tolist(), strict=True)), int(pdf["n"].iloc[0]), k, least, strength=strength)
        return pd.DataFrame({"seq_id": key[0], "boundary": got}, columns=["seq_id", "boundary"]).astype({"boundary": "int32"})

    return candidates.join(sizes, "seq_id").groupBy("seq_id").applyInPandas(run, "seq_id long, boundary int")


def segment_f1(hyp: DataFrame, ref: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """(seq_id, threshold, f1): greedy one-to-one matches of segments (seq_id, ord, start, end) in the order of prediction, each with the best free reference."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, r = (x.sort_values("ord")[["start", "end"]].to_numpy(np.float64) for x in (left, right))
        seq = (left if len(left) else right)["seq_id"].iloc[0]
        out = []
        for t in thresholds:
            free, tp = list(range(len(r))), 0
            for s, e in p:
                iou = [max(0.0, min(e, r[j][1]) - max(s, r[j][0])) / max(1e-12, max(e, r[j][1]) - min(s, r[j][0])) for j in free]
                if iou and max(iou) >= t:
                    tp += 1
                    del free[int(np.argmax(iou))]
            out.append((seq, t, 2 * tp / (len(p) + len(r)) if len(p) + len(r) else 1.0))
        return pd.DataFrame(out, columns=["seq_id", "threshold", "f1"])

    return hyp.groupBy("seq_id").cogroup(ref.toDF(*ref.columns).groupBy("seq_id")).applyInPandas(run, "seq_id long, threshold double, f1 double")
