"""The named segmentation methods, as data: a name is read by rule into an operator and its parameters.

Names follow a small grammar, e.g. cross_e5_w11_frac70_minlen12: a family, then any of w<window>, frac<percent>, minlen<units>, nms<gap>, thresh<percent>,
consv<fewer>. FAMILIES lists the families with their own defaults; names() spells out the points of the parameter grid that are registered. Greedy splits are nested,
so one run for each model, window and least length serves every method and count over a sequence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np

from ..operators import segmenters as S


@dataclass(frozen=True)
class Method:
    family: str
    window: int = 9
    frac: float | None = None
    fewer: int = 0
    min_seg: int | None = None
    score_aware: bool = False
    shift: bool = False
    options: dict = field(default_factory=dict)


@dataclass
class Input:
    """One sequence: unit vectors of two models, number of segments, optional prosody and shot scores of boundaries, and tokens."""

    v1: np.ndarray
    v2: np.ndarray
    k: int
    side: np.ndarray | None = None
    tokens: list[list[str]] | None = None
    chunk: int = 4
    shots: np.ndarray | None = None
    cache: dict = field(default_factory=dict)

    def target(self, m: Method) -> int:
        """The segments asked for: a half-even share of k, or k less a few; at least two."""
        return max(2, round(self.k * m.frac)) if m.frac is not None else max(2, self.k - m.fewer) if m.fewer else self.k

    def held(self, key: tuple, make):
        if key not in self.cache:
            self.cache[key] = make()
        return self.cache[key]

    def smooth(self, model: int, window: int, sigma: float | None = None) -> np.ndarray:
        """A model's vectors (1, 2, or 3: both side by side), smoothed."""
        v = (self.v1, self.v2, None)[model - 1]
        v = self.held(("both",), lambda: S.unit_rows(np.hstack((self.v1, self.v2)))) if v is None else v
        return self.held(("smooth", model, window, sigma), lambda: S.smooth(v, window) if sigma is None else S.smooth_gaussian(v, window, sigma))

    def splits(self, model: int, window: int, k: int, min_seg: int | None = None, sigma: float | None = None) -> np.ndarray:
        """Scores of the first k - 1 greedy splits."""
        key = ("splits", model, window, min_seg, sigma)
        most, order, gains = self.cache.get(key, (0, [], []))
        if k > most:
            v = self.smooth(model, window, sigma)
            most = max(k, min(len(v) - 1, 4 * self.k + 2)) if min_seg is None and len(v) >= 4 else k
            order, gains = S.divisive_order(v, most, min_seg)
            self.cache[key] = most, order, gains
        return S.scored(len(self.v1), order[: max(0, k - 1)], gains[: max(0, k - 1)])

    def blocks(self, window: int) -> np.ndarray:
        """Vectors of the joined text of the units around each, where there are tokens; else smoothed vectors stand in."""
        if self.tokens is None:
            return self.smooth(1, window)
        from ..operators.text import hashed_counts

        n, h = len(self.v1), window // 2
        p = S.prefix(hashed_counts(self.tokens))
        i = np.arange(n)
        return S.unit_rows(p[np.minimum(i + h + 1, n)] - p[np.maximum(i - h, 0)])


def two_maps(x: Input, m: Method, over: int, window: int | None = None, sigma: float | None = None) -> list[np.ndarray]:
    """Split scores of either model, asked for `over` segments but not over all units."""
    return [x.splits(i, window or m.window, min(len(x.v1) - 1, over), None, sigma) for i in (1, 2)]


def rescored(x: Input, m: Method, how, over: int, multiple: int, w_cross: float, side: float = 0.0) -> np.ndarray:
    """A second pass over the best candidates, blended with the first; `side` is the weight of prosody, where there is any."""
    first = S.mean_maps(two_maps(x, m, over))
    c = S.best(first, multiple * x.target(m))
    maps = [how(x.smooth(i, m.window), c) for i in (1, 2)]
    again = sum(maps) / 2 if how is S.contrast else S.mean_maps(maps)
    out = np.full(len(first), np.nan)
    if side and x.side is not None and c:
        extra = x.side[c] / (x.side[c].max() if x.side[c].max() > 0 else 1.0)
        out[c] = w_cross * first[c] + (1 - w_cross - side) * again[c] + side * extra
    else:
        w = 0.5 if side else w_cross
        out[c] = w * first[c] + (1 - w) * again[c]
    return out


def reranked(scores: np.ndarray, target: int, signals: list[tuple[np.ndarray | None, float]], w: float) -> list[int]:
    """The best `target` candidates by min-maxed scores of theirs and of signals; weights are those of the signals that there are, made to add up to one."""
    c = S.found(scores)
    there = [(s, u) for s, u in signals if s is not None and u > 0]
    total = w + sum(u for _, u in there)
    out = np.full(len(scores), np.nan)
    if c:
        out[c] = w / total * S.minmax(scores[c]) + sum(u / total * S.minmax(s[c]) for s, u in there)
    return S.best(out, target)


def pool(n: int, k: int) -> int:
    """Segments to ask for where k - 1 boundaries are chosen anew."""
    target = max(1, k - 1)
    return min(max(3 * target, target + 2), max(2, n - 1)) + 1


def run(x: Input, m: Method) -> list[int]:
    """The boundaries of one method."""
    f, k, o, n = m.family, x.target(m), m.options, len(x.v1)
    scores = None
    if n < 2:
        return []
    sv = x.smooth(1, m.window)
    if f == "divisive":
        out = S.found(x.splits(1, m.window, k))
    elif f in ("divisive_chunked", "two_stage_chunked", "divisive_chunked_side"):
        size = o.get("chunk", x.chunk)
        c = np.array([x.v1[i : i + size].mean(0) for i in range(0, n, size)])
        if len(c) < 2:
            return {"divisive_chunked": S.divisive, "two_stage_chunked": S.cosine_seg}.get(f, lambda v, k: reranked(S.divisive_scores(v, pool(n, k)), max(1, k - 1), [(x.side, 0.3)], 0.7))(x.v1, k)
        if f == "divisive_chunked":
            got = S.divisive(c, k)
        elif f == "two_stage_chunked":
            got = S.best(S.fused([S.gap_overlapping(c, 3)]), k - 1)
        else:  # prosody at a border of chunks is its mean over the boundary there and its neighbours
            side = None if x.side is None or n - 1 < size else np.array([0.0, *(x.side[max(1, i * size - 1) : min(n, i * size + 2)].mean() for i in range(1, len(c)))])
            got = reranked(S.divisive_scores(c, pool(len(c), k)), max(1, k - 1), [(side, 0.3)], 0.7)
        out = sorted({max(1, min(n - 1, b * size)) for b in got})
    elif f == "divisive_block":
        out = S.divisive(x.blocks(m.window), k)
    elif f == "divisive_auto":
        out = S.found(x.splits(1, m.window, o["rule"](sv)))
    elif f == "divisive_side":
        if o.get("or_depth") and x.side is None:
            out = S.depth_seg(sv, k)
        else:
            out = reranked(x.splits(1, m.window, pool(n, k)), max(1, k - 1), [(x.side, o.get("prosody", 0.0)), (x.shots, o.get("shots", 0.0))], o["w"])
    elif f in ("divisive_recency", "ensemble"):
        drop = S.recency_scores(sv) if f == "divisive_recency" else S.cosine_drop_scores(sv)
        two = (S.over_all(x.splits(1, m.window, min(n - 1, 3 * max(1, k - 1) + 2))) + S.over_all(drop)) / 2
        out = S.best(two, max(1, k - 1)) if n >= 4 and k >= 2 else []
    elif f == "dp":
        out = S.dp(sv, k)
    elif f == "treeseg":
        out = S.treeseg(sv, k)
    elif f == "cosine":
        out = S.cosine_seg(sv, k, o.get("depth", 3))
    elif f == "kmeans":
        out = S.kmeans_seg(sv, k)
    elif f == "depth":
        out = S.depth_seg(sv, k, o.get("depth", 5))
    elif f == "cosine_drop":
        out = S.best(S.cosine_drop_scores(sv), k - 1)
    elif f == "recency":
        out = S.best(S.recency_scores(sv), max(1, k - 1)) if n >= 4 and k >= 2 else []
    elif f in ("two_stage", "hierarchical"):
        gap = S.gap_overlapping(sv, 3)
        out = S.best(S.fused([gap, *([x.side] if o.get("side") and x.side is not None else [])]), k - 1)
        if f == "hierarchical":  # chapters: the subtopic boundaries with the largest gaps in the text
            chosen = np.full(n, np.nan)
            chosen[out] = gap[out]
            out = S.best(chosen, min(max(2, round(0.3 * k)), k) - 1)
    elif f in ("texttiling", "c99"):
        t = x.tokens or [[] for _ in range(n)]
        out = S.texttiling(t) if f == "texttiling" else S.c99_text(t, k)
    elif f == "cross":
        if "threshold" in o:
            scores = S.mean_maps(two_maps(x, m, max(10, round(3 * x.k))))
            ranked = sorted(S.found(scores), key=lambda b: (-scores[b], b))
            many = sum(scores[b] >= o["threshold"] * np.nanmax(scores) for b in ranked)
            out = sorted(ranked[: max(2, min(many, round(1.5 * x.k), n - 1))])
        elif "rule" in o:
            k = o["rule"](x.v1)
            out = S.best(S.mean_maps(two_maps(x, m, 3 * k)), k)
        else:
            scores = S.mean_maps(two_maps(x, m, o.get("over", 4) * k + 2))
            if "nms" in o:
                out = S.spaced(scores, k, o["nms"])
            elif "adaptive" in o:
                s = scores[~np.isnan(scores)]
                cv = s.std() / (s.mean() + 1e-8) if len(s) else 0.0
                out = S.best(scores, max(2, round(x.k * (0.8 if cv > 0.65 else 0.6 if cv < 0.4 else 0.7))))
            elif o.get("side") and x.side is not None and (c := S.found(scores)):
                blend = np.full(n, np.nan)
                blend[c] = 0.7 * scores[c] + 0.3 * x.side[c] / (x.side[c].max() if x.side[c].max() > 0 else 1.0)
                out = S.best(blend, k)
            else:
                out = S.best(scores, k)
    elif f == "cross_constrained":
        maps = [x.splits(i, m.window, k, m.min_seg) for i in (1, 2)]
        votes = np.where(np.isnan(maps[0]), 0, 2) + np.where(np.isnan(maps[1]), 0, 1)
        out = S.min_seg_filter(S.best(np.where(votes > 0, votes, np.nan).astype(float), 2 * k), n, m.min_seg)[:k]
    elif f == "cross_gauss":
        out = S.best(S.mean_maps(two_maps(x, m, 4 * k + 2, sigma=2.0)), k)
    elif f == "rank":
        out = S.best(S.rank_mean(two_maps(x, m, 4 * k + 2)), k)
    elif f == "weighted":
        out = S.best(S.mean_maps(two_maps(x, m, 4 * k + 2), [o["w1"], 1 - o["w1"]]), k)
    elif f == "concat":
        out = S.divisive(S.unit_rows(np.hstack((sv, x.smooth(2, m.window)))), k)
    elif f == "triple":
        out = S.best(S.mean_maps([x.splits(i, m.window, min(n - 1, 4 * k + 2)) for i in (1, 2, 3)]), k)
    elif f == "multi_res":
        out = S.best(S.mean_maps([s for w in (7, 9, 11) for s in two_maps(x, m, 4 * k + 2, w)]), k)
    elif f == "combined_depth":
        out = S.best(S.mean_maps([S.gap_one_sided(x.smooth(i, m.window), o.get("depth", 7)) for i in (1, 2)]), k)
    elif f == "iterative":
        over = min(x.k, n - 1) * (4 if o.get("v2") else 3) + 2
        out = S.best(rescored(x, m, S.neighbour_dissimilarity, over, o.get("multiple", 2), o.get("w_cross", 0.5), o.get("side", 0.0)), k)
    elif f == "iterative_fixed":
        out = S.best(rescored(x, m, lambda v, c: S.neighbour_dissimilarity(v, c, 15), max(2 * k + 2, k + 4), 2, 0.4), k)
    elif f == "contrastive":
        out = S.best(rescored(x, m, S.contrast, 4 * k + 2, 2, 0.4), k)
    else:
        raise ValueError(f"no family {f}")
    least = m.min_seg
    if "adaptive_min" in o:
        least = o["adaptive_min"](n, x.k)
    if least and f != "cross_constrained":
        out = S.min_seg_filter(out, n, least, scores if m.score_aware else None)
    if m.shift:
        out = S.local_shift(out, x.v1)
    return [b for b in out if 0 < b < n]


#: Families: the start of a name, and what it means. The longest start that fits counts.
FAMILIES: dict[str, Method] = {
    "texttiling": Method("texttiling"), "c99": Method("c99"), "kmeans": Method("kmeans", 1), "two_stage": Method("two_stage", 1), "hierarchical": Method("hierarchical", 1),
    "cosine": Method("cosine", 1), "bert_seg": Method("cosine", 1, options={"depth": 5}), "cosine_drop": Method("cosine_drop", 1), "cosine_drop_smooth": Method("cosine_drop", 7),
    "two_stage_prosody": Method("two_stage", 1, options={"side": True}), "hierarchical_prosody": Method("hierarchical", 1, options={"side": True}), "two_stage_chunked": Method("two_stage_chunked", 1),
    "divisive": Method("divisive", 1), "divisive_smooth": Method("divisive", 7), "divisive_block": Method("divisive_block", 7), "divisive_chunked": Method("divisive_chunked", 1), "divisive_chunked3": Method("divisive_chunked", 1, options={"chunk": 3}),
    "divisive_conservative": Method("divisive", 1, fewer=2), "divisive_minlen": Method("divisive", 1, min_seg=8), "divisive_smooth7_minlen": Method("divisive", 7, min_seg=8), "divisive_smooth_dp": Method("dp", 9),
    "divisive_prosody": Method("divisive_side", 1, options={"w": 0.7, "prosody": 0.3}), "divisive_shots": Method("divisive_side", 1, options={"w": 0.7, "shots": 0.3}), "divisive_prosody_shots": Method("divisive_side", 1, options={"w": 0.6, "prosody": 0.2, "shots": 0.2}), "divisive_smooth3_prosody": Method("divisive_side", 3, options={"w": 0.7, "prosody": 0.3}), "divisive_chunked_prosody": Method("divisive_chunked_side", 1),
    "divisive_bic": Method("divisive_auto", 1, options={"rule": S.bic_k}), "divisive_bic_smooth": Method("divisive_auto", 7, options={"rule": S.bic_k}), "divisive_elbow": Method("divisive_auto", 1, options={"rule": S.elbow_k}), "divisive_elbow_smooth": Method("divisive_auto", 7, options={"rule": S.elbow_k}),
    "divisive_recency": Method("divisive_recency", 1), "divisive_recency_smooth": Method("divisive_recency", 7), "recency": Method("recency", 1), "recency_smooth": Method("recency", 7),
    "depth": Method("depth", 1), "depth_smooth": Method("depth", 7), "depth_smooth_prosody": Method("divisive_side", 7, options={"w": 0.7, "prosody": 0.3, "or_depth": True}), "depth_frac": Method("depth", 9, 0.7),
    "dp": Method("dp", 1), "dp_smooth": Method("dp", 7), "dp_frac": Method("dp", 9, 0.7), "treeseg": Method("treeseg", 1), "ensemble": Method("ensemble", 1), "ensemble_smooth": Method("ensemble", 7),
    "cross": Method("cross", 9, 0.7), "cross_rank": Method("rank", 9, 0.8), "cross_model": Method("cross", 9, 0.8), "weighted_cross": Method("weighted", 9, 0.7), "concat": Method("concat", 9, 0.7), "triple": Method("triple", 9, 0.7), "multi_res": Method("multi_res", 9, 0.7),
    "iterative_cross": Method("iterative", 9, 0.7), "iterative_v2": Method("iterative", 9, 0.75, options={"v2": True, "multiple": 3, "w_cross": 0.3}), "iterative_v2_segs4": Method("iterative", 9, 0.75, options={"v2": True, "w_cross": 0.3, "multiple": 4}), "iterative_fw": Method("iterative_fixed", 9, 0.7), "contrastive": Method("contrastive", 9, 0.7),
    "cross_e5_gapvar": Method("cross", 9, 0.7, options={"rule": S.gap_variance_k}), "cross_e5_adaptive_k": Method("cross", 9, 0.7, options={"adaptive": True, "over": 5}), "cross_e5_combined_depth": Method("combined_depth", 9, 0.7),
    "cross_e5_prosody": Method("cross", 9, 0.7, options={"side": True, "over": 3}), "iterative_cross_e5_prosody": Method("iterative", 9, 0.75, options={"side": 0.2, "w_cross": 0.4}), "cross_e5_gauss": Method("cross_gauss", 9, 0.7), "cross_e5_constrained": Method("cross_constrained", 9, 0.7), "cross_e5_score": Method("cross", 9, 0.7, score_aware=True),
    "cross_e5_frac70_adaptive_minlen": Method("cross", 9, 0.7, options={"adaptive_min": lambda n, k: max(5, n // max(1, 2 * k))}), "cross_e5_frac70_adaptive_minlen2": Method("cross", 9, 0.7, options={"adaptive_min": lambda n, k: max(8, min(15, round(0.3 * max(1, n // max(1, k)))))}), "cross_e5_frac70_adaptive_minlen3": Method("cross", 9, 0.7, options={"adaptive_min": lambda n, k: max(8, min(15, round(0.4 * max(1, n // max(1, k)))))}),
}
FIXED = {"divisive_chunked3", "divisive_smooth7_minlen", "divisive_smooth3_prosody", "iterative_v2_segs4", "c99", "iterative_v2_w04", "iterative_v2_w02", *(n for n in FAMILIES if "adaptive_minlen" in n)}
#: Secondary models that names may carry; which vectors stand for them is the caller's choice.
MODELS = "e5large e5base e5 bge_large bgelarge bge stella mpnet".split()


def parse(name: str) -> Method:
    """The method that a name stands for."""
    if name == "iterative_v2_w04" or name == "iterative_v2_w02":
        return replace(FAMILIES["iterative_v2"], options=FAMILIES["iterative_v2"].options | {"w_cross": int(name[-2:]) / 10})
    start = max((f for f in FAMILIES if name == f or re.match(re.escape(f) + r"(?=_|\d)", name)), key=len, default=None)
    if start is None:
        raise ValueError(f"unknown method {name}")
    m, rest = FAMILIES[start], "" if name in FIXED else name[len(start) :]
    o = dict(m.options)
    for key, digits in re.findall(r"(?:^|_)(smooth|block|w|frac|minlen|nms|thresh|consv|conservative|shift)?(\d*)(?=_|$)", rest):
        v = int(digits) if digits else None
        if key in ("smooth", "block") and v or not key and v and start in ("divisive_smooth", "divisive_block"):
            m = replace(m, window=v)
        elif key == "w" and v:
            if m.family == "weighted":
                o["w1"] = v / 100
            elif m.family in ("combined_depth", "depth"):
                o["depth"] = v
            else:
                m = replace(m, window=v)
        elif key == "frac":
            m = replace(m, frac=v / 100)
        elif key == "minlen":
            m = replace(m, min_seg=v or 8)
        elif key == "nms":
            o["nms"], o["over"] = v, 6
        elif key == "thresh":
            o["threshold"] = v / 100
        elif key in ("consv", "conservative"):
            m = replace(m, fewer=v or 2)
        elif key == "shift":
            m = replace(m, shift=True, frac=0.7 if v == 70 else 0.75 if m.family == "iterative" else m.frac)
    return replace(m, options=o)


def grid(pattern: str, *values) -> list[str]:
    """The names that a pattern gives for lists of values."""
    out = [pattern]
    for v in values:
        out = [p.replace("{}", str(x), 1) for p in out for x in v]
    return out


def names() -> list[str]:
    """The registered names: the families' plain ones and the points of their grids. Names bound to external neural or language models are not built."""
    plain = [f for f in FAMILIES if f not in ("divisive_smooth", "divisive_block", "depth_frac", "dp_frac", "cross", "cross_rank", "cross_model", "weighted_cross", "concat", "triple", "multi_res", "iterative_cross", "iterative_v2", "iterative_fw", "contrastive", "cross_e5_gauss", "cross_e5_constrained", "cross_e5_score")]
    lists = [
        grid("depth_w{}", (3, 9)), grid("divisive_smooth{}", (3, 5, 7, 9, 11, 13, 15, 19, 25)), grid("divisive_block{}", (5, 7, 9)), grid("divisive_smooth{}_conservative", (7, 9, 11, 13, 15)),
        grid("divisive_smooth9_consv{}", (3, 4, 5, 6)), grid("divisive_smooth11_consv{}", (3, 4, 5)), grid("divisive_smooth{}_frac{}", (9, 11), (65, 70, 75, 80, 85)), ["divisive_smooth10_frac80"],
        grid("cross_model_{}", ("e5large", "bge_large", "stella", "bge")), grid("cross_bge_frac{}", (70, 75)), ["cross_rank_e5large", "cross_rank_e5large_frac75", "triple_model"],
        grid("cross_e5_frac{}", (55, 60, 65, 70, 75, 80)), grid("cross_e5_w11_frac{}", (65, 70, 75, 80)), grid("cross_e5_w7_frac{}", (70, 80)), ["cross_e5_w13_frac80", "cross_e5_w9_frac90"], grid("concat_e5_frac{}", (70, 80)),
        grid("cross_e5_frac70_minlen{}", ("", 5, 9, 10, 11, 12, 15, 20)), grid("cross_e5_frac65_minlen{}", ("", 10, 11, 12, 15)), grid("cross_e5_frac60_minlen{}", (8, 10)), grid("cross_e5_frac75_minlen{}", (10, 11, 12)), grid("cross_e5_frac{}_minlen10", (68, 72, 74, 80, 85)), grid("cross_e5_frac{}_minlen11", (68, 72)),
        grid("cross_e5_w{}_frac70_minlen{}", (11, 13), (10,)), ["cross_e5_w11_frac70_minlen12", "cross_e5_w7_frac70_minlen10", "cross_e5_w13_frac70_minlen11", "cross_e5_w15_frac70_minlen11"],
        grid("weighted_cross_w{}", (40, 55, 60, 65)), grid("cross_e5_thresh{}", (50, 60, 70)), grid("triple_frac{}", (70, 75, 80)), grid("triple_frac{}_minlen10", (65, 70)), ["cross_e5_prosody_frac75", "cross_e5_frac70_shift", "cross_e5_bgelarge_frac70", "cross_model_bge_e5_frac70_minlen10"],
        grid("cross_{}_frac{}", ("stella", "e5base"), (70, 75)), ["multi_res_cross_e5", "multi_res_cross_e5_frac75", "multi_res_cross_e5_minlen10", "multi_res_e5_frac70_minlen11"],
        grid("iterative_cross_e5_frac{}", (50, 55, 60, 65, 70, 75, 80)), ["iterative_cross_e5", "iterative_cross_e5_w7", "iterative_cross_e5_w11"], grid("iterative_cross_e5_w{}_frac75", (7, 11)), grid("cross_e5_combined_depth_{}", ("frac75", "w5", "w9")), ["iterative_cross_e5_prosody_frac70", "iterative_cross_e5_shift", "iterative_cross_e5_shift70"],
        grid("iterative_v2_frac{}", (60, 65, 70, 75)), ["iterative_v2_w04", "iterative_v2_w02", "iterative_v2_frac75_minlen"], grid("iterative_cross_{}", ("e5base", "bgelarge", "stella")), grid("iterative_cross_{}_frac75", ("e5base", "bgelarge", "stella")), grid("iterative_fw_{}", ("e5base", "e5base_frac75", "stella", "bgelarge")), grid("contrastive_{}", ("e5base", "e5base_frac75", "stella")),
        grid("iterative_cross_e5_frac{}_minlen", (65, 70, 75)), ["iterative_cross_e5_frac75_minlen5"], grid("iterative_cross_e5_frac{}_minlen10", (65, 70)), grid("cross_e5_nms{}", (8, 10, 12)), grid("cross_e5_nms10_{}", ("frac75", "frac65", "w11")), grid("concat_e5_frac70_minlen{}", (10, 11)), grid("cross_rank_e5_frac70_minlen{}", (10, 11)),
        grid("cross_e5_score_minlen{}", (10, 11, 12)), grid("triple_bgelarge_e5_mpnet_frac70_minlen{}", (10, 11)), ["triple_bgelarge_e5large_bge_frac70_minlen11"], grid("dp_frac70_minlen{}", (10, 11)), ["depth_frac70_minlen11"], grid("cross_e5_gauss_frac70_minlen{}", (10, 11)), grid("cross_e5_constrained_minlen{}", (10, 11)),
    ]
    return list(dict.fromkeys([*plain, *(n for x in lists for n in x)]))
