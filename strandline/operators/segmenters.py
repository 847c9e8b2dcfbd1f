"""Segmenters of one sequence that are inherently sequential, in numpy over prefix sums.

A score map is an array over boundaries 0..N-1 with NaN where a method has no score; combinations of maps are then array arithmetic. Ties go to the
smaller boundary throughout, and rounding is half-even as Python's.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

MOST_UNITS = 800


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


def prefix(v: np.ndarray) -> np.ndarray:
    return np.vstack((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0, dtype=np.float64)))


def frame_means(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Means of rows [lo, hi), clamped; zero vectors for empty ranges."""
    p, n = prefix(v), len(v)
    lo, hi = np.clip(lo, 0, n), np.clip(hi, 0, n)
    return (p[hi] - p[lo]) / np.maximum(hi - lo, 1)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    return np.where(n > 1e-12, (a * b).sum(-1) / np.where(n > 1e-12, n, 1), 0.0)


def smooth(v: np.ndarray, window: int) -> np.ndarray:
    n, h = len(v), window // 2
    if window <= 1 or n < 2:
        return v
    i = np.arange(n)
    return unit_rows(frame_means(v, i - h, i + h + 1))


def smooth_gaussian(v: np.ndarray, window: int, sigma: float) -> np.ndarray:
    n, h = len(v), window // 2
    d = np.arange(n)[:, None] - np.arange(n)[None, :]
    w = np.where(np.abs(d) <= h, np.exp(-0.5 * (d / sigma) ** 2), 0)
    return unit_rows(w @ v / w.sum(1, keepdims=True))


def best(scores: np.ndarray, k: int) -> list[int]:
    """The k boundaries of highest score, rising. Boundary 0 and NaN don't count."""
    at = [int(b) for b in np.flatnonzero(~np.isnan(scores)) if b > 0]
    return sorted(sorted(at, key=lambda b: (-scores[b], b))[: max(0, k)])


def minmax(x: np.ndarray) -> np.ndarray:
    lo, hi = np.nanmin(x), np.nanmax(x)
    return (x - lo) / (hi - lo) if hi > lo else np.where(np.isnan(x), np.nan, 0.0)


def gap_overlapping(v: np.ndarray, w: int) -> np.ndarray:
    """1 - cosine of the overlapping frames around b - 1 and b."""
    b = np.arange(len(v))
    s = 1 - cosines(frame_means(v, b - 1 - w, b + w), frame_means(v, b - w, b + w + 1))
    s[:1] = np.nan
    return s


def gap_one_sided(v: np.ndarray, w: int) -> np.ndarray:
    b = np.arange(len(v))
    s = 1 - cosines(frame_means(v, b - w, b), frame_means(v, b, b + w))
    s[:1] = np.nan
    return s


def depths(similarity: np.ndarray) -> np.ndarray:
    s = similarity[1:]
    out = np.full(len(similarity), np.nan)
    if len(s):
        out[1:] = np.maximum.accumulate(s) + np.maximum.accumulate(s[::-1])[::-1] - 2 * s
    return out


def cosine_seg(v: np.ndarray, k: int | None = None, window: int = 3, c: float = 1.0, threshold: float | None = None) -> list[int]:
    if len(v) < 2:
        return []
    s = 1 - gap_overlapping(v, window)
    d = depths(s)
    if k is not None:
        return best(d, k - 1)
    if threshold is not None:
        return [int(b) for b in np.flatnonzero(s[1:] < threshold) + 1]
    x = d[1:]
    return [int(b) for b in np.flatnonzero(x > x.mean() + c * x.std()) + 1]


def kmeans_seg(v: np.ndarray, k: int, seed: int = 42, rounds: int = 30) -> list[int]:
    """Changes of cluster along the sequence; there may be more than k - 1."""
    if len(v) < 2 or k < 2:
        return []
    x, rng = unit_rows(v), np.random.default_rng(seed)
    best_loss, labels = np.inf, None
    for _ in range(10):
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            now = d.argmin(1)
            c = np.array([x[now == j].mean(0) if (now == j).any() else c[j] for j in range(len(c))])
        loss = d.min(1).sum()
        if loss < best_loss - 1e-12:
            best_loss, labels = loss, now
    return [int(b) for b in np.flatnonzero(labels[1:] != labels[:-1]) + 1]


def split_at(p: np.ndarray, a: int, e: int, least: int = 1) -> tuple[float, int] | None:
    """The first best split of [a, e): (1 - cosine of the two means, place)."""
    s = np.arange(a + least, e - least + 1)
    if not len(s):
        return None
    x = 1 - cosines((p[s] - p[a]) / (s - a)[:, None], (p[e] - p[s]) / (e - s)[:, None])
    i = int(x.argmax())
    return float(x[i]), int(s[i])


def greedy(n: int, count: int, split, least: int = 2) -> tuple[list[int], list[float]]:
    """Top-down: always the segment with the best split, earlier made first on ties; the left child is made before the right one. Splits and their gains come in
    the order made, so the first j of them are the splits for any smaller count."""
    heap, made, order, gains = [], 0, [], []

    def push(a, e):
        nonlocal made
        if e - a >= least and (got := split(a, e)):
            heapq.heappush(heap, (-got[0], made, got[1], a, e))
            made += 1

    push(0, n)
    while heap and len(order) < count:
        gain, _, s, a, e = heapq.heappop(heap)
        order.append(s)
        gains.append(-gain)
        push(a, s)
        push(s, e)
    return order, gains


def scored(n: int, order: list[int], gains: list[float]) -> np.ndarray:
    out = np.full(n, np.nan)
    out[order] = gains
    return out


def divisive_order(v: np.ndarray, k: int, min_seg: int | None = None) -> tuple[list[int], list[float]]:
    """Up to k - 1 greedy splits by dissimilarity of the halves' means, in the order made, and their scores."""
    n = len(v)
    if n < 2 or k < 2:
        return [], []
    if min_seg is None and n < 4:
        d = depths(1 - gap_overlapping(v, 3))
        b = sorted(best(d, n), key=lambda x: (-d[x], x))[: k - 1]
        return b, [float(d[x]) for x in b]
    p, m = prefix(v), min_seg or 1
    if n < 2 * m:
        return [], []
    return greedy(n, k - 1, lambda a, e: split_at(p, a, e, m), 2 * m)


def divisive_scores(v: np.ndarray, k: int, min_seg: int | None = None) -> np.ndarray:
    """Scores of up to k - 1 greedy splits."""
    return scored(len(v), *divisive_order(v, k, min_seg))


def found(scores: np.ndarray) -> list[int]:
    return [int(b) for b in np.flatnonzero(~np.isnan(scores))]


def divisive(v: np.ndarray, k: int, min_seg: int | None = None) -> list[int]:
    return found(divisive_scores(v, k, min_seg))


def treeseg(v: np.ndarray, k: int, penalty: float = 0.0, min_seg: int = 2) -> list[int]:
    """Greedy splits of the largest fall in squared error plus penalty * length^2."""
    n, p = len(v), prefix(v)
    q = np.concatenate(([0.0], np.cumsum((v * v).sum(1))))

    def loss(a, e):
        d = p[e] - p[a]
        return q[e] - q[a] - (d * d).sum(-1) / np.maximum(e - a, 1) + penalty * (e - a) ** 2

    def split(a, e):
        s = np.arange(a + min_seg, e - min_seg + 1)
        if not len(s):
            return None
        x = loss(a, e) - loss(np.full(len(s), a), s) - loss(s, np.full(len(s), e))
        i = int(x.argmax())
        return float(x[i]), int(s[i])

    return sorted(greedy(n, k - 1, split, 2 * min_seg)[0]) if n >= 2 and k >= 2 else []


def dp(v: np.ndarray, k: int) -> list[int]:
    """Exactly min(k, N) segments of largest sum of |sum|^2 / length; of equal predecessors the first."""
    n = len(v)
    k = min(k, n)
    if n < 2 or k < 2:
        return []
    p = prefix(v)
    value = np.full((k + 1, n + 1), -np.inf)
    back = np.zeros((k + 1, n + 1), np.int64)
    value[0, 0] = 0
    for e in range(1, n + 1):
        a = np.arange(e)
        gain = ((p[e] - p[a]) ** 2).sum(1) / (e - a)
        for j in range(1, min(k, e) + 1):
            x = value[j - 1, :e] + gain
            back[j, e] = int(x.argmax())
            value[j, e] = x[back[j, e]]
    out, e = [], n
    for j in range(k, 0, -1):
        e = int(back[j, e])
        if e > 0:
            out.append(e)
    return sorted(out)


def reflected_gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    n = len(x)
    i = (np.arange(n)[:, None] + np.arange(-r, r + 1)) % (2 * n)
    return x[np.where(i < n, i, 2 * n - 1 - i)] @ (k / k.sum())


def depth_seg(v: np.ndarray, k: int, window: int = 5, sigma: float = 1.5) -> list[int]:
    """Depth below the nearest peak on either side of smoothed one-sided similarity."""
    if len(v) < 3:
        return []
    s = reflected_gaussian(1 - gap_one_sided(v, window)[1:], sigma)
    out = np.full(len(v), np.nan)
    for i in range(len(s)):
        a = i
        while a > 0 and s[a - 1] >= s[a]:
            a -= 1
        e = i
        while e + 1 < len(s) and s[e + 1] >= s[e]:
            e += 1
        out[i + 1] = 0.5 * (s[a] - s[i]) + 0.5 * (s[e] - s[i])
    return best(out, k - 1)


def cosine_drop_scores(v: np.ndarray, window: int = 3) -> np.ndarray:
    """Negated mean similarity across each gap."""
    b = np.arange(len(v))
    s = -(frame_means(v, b - window, b) * frame_means(v, b, b + window)).sum(1)
    s[:1] = np.nan
    return s


def recency_scores(v: np.ndarray, window: int = 7, decay: float = 0.5) -> np.ndarray:
    """1 - cosine of the window // 2 + 1 rows on either side, weighted exp(-decay * d) by distance d from the gap; 0 where a side has no length."""
    n, m = len(v), window // 2 + 1
    d = np.arange(n)[None, :] - np.arange(n)[:, None]  # column less row
    w = np.exp(-decay * np.where(d >= 0, d, -1 - d))
    left, right = np.where((d < 0) & (d >= -m), w, 0) @ v, np.where((d >= 0) & (d < m), w, 0) @ v
    s = np.where((np.linalg.norm(left, axis=1) > 0) & (np.linalg.norm(right, axis=1) > 0), 1 - cosines(left, right), 0.0)
    s[:1] = np.nan
    return s


def over_all(scores: np.ndarray) -> np.ndarray:
    """Min-max over all gaps, those without a score counting 0."""
    x = np.nan_to_num(scores)
    x[:1] = np.nan
    return minmax(x)


def rank_mean(maps: list[np.ndarray]) -> np.ndarray:
    """Borda: negated sum of ranks; what a map lacks ranks one after the last of the longest map."""
    at = np.flatnonzero(np.any([~np.isnan(m) for m in maps], axis=0))
    out = np.full(len(maps[0]), np.nan)
    out[at] = 0
    absent = max(len(found(m)) for m in maps) + 1
    for m in maps:
        order = {b: i + 1 for i, b in enumerate(sorted(found(m), key=lambda b: (-m[b], b)))}
        for b in at:
            out[b] -= order.get(int(b), absent)
    return out


def entropy_weight(x: np.ndarray) -> float:
    """exp of minus the normalised entropy of scores shifted to start at 0."""
    p = x - x.min()
    if p.sum() < 1e-9 or len(x) < 2:
        return float(np.exp(-1.0))
    p = p / p.sum() + 1e-9
    p /= p.sum()
    return float(np.exp((p * np.log2(p)).sum() / np.log2(len(x))))


def fused(maps: list[np.ndarray]) -> np.ndarray:
    """Maps over all gaps, scaled to [0, 1] (a flat one stays as it is), weighted by their entropy, added and scaled again."""
    scale = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x
    rows = [m[1:] for m in maps]
    weights = [entropy_weight(x) for x in rows]
    out = np.full(len(maps[0]), np.nan)
    out[1:] = scale(sum(w / sum(weights) * scale(x) for w, x in zip(weights, rows, strict=True)))
    return out


def mean_maps(maps: list[np.ndarray], weights: list[float] | None = None) -> np.ndarray:
    """Each divided by its largest (0: by 1); missing is 0; weighted, by the number of maps if without weights."""
    weights = weights or [1 / len(maps)] * len(maps)
    out, any_ = np.zeros(len(maps[0])), np.zeros(len(maps[0]), bool)
    for m, w in zip(maps, weights, strict=True):
        there = ~np.isnan(m)
        top = np.nanmax(m) if there.any() else 1.0
        out += w * np.where(there, m, 0) / (top or 1.0)
        any_ |= there
    return np.where(any_, out, np.nan)


def min_seg_filter(b: list[int], n: int, least: int = 5, scores: np.ndarray | None = None) -> list[int]:
    """While a segment is shorter than `least`: the first shortest loses its right boundary if it is the first, its left one if last, else its left or weaker one."""
    b = sorted(b)
    while b:
        lengths = np.diff([0, *b, n])
        i = int(lengths.argmin())
        if lengths[i] >= least:
            break
        if i == 0:
            j = 0
        elif i == len(b):
            j = len(b) - 1
        else:
            s = (lambda x: 0.0 if scores is None or np.isnan(scores[x]) else scores[x])
            j = i if scores is not None and s(b[i]) < s(b[i - 1]) else i - 1
        del b[j]
    return b


def spaced(scores: np.ndarray, k: int, min_gap: int) -> list[int]:
    out: list[int] = []
    for b in sorted(found(scores), key=lambda b: (-scores[b], b)):
        if len(out) >= k:
            break
        if b > 0 and all(abs(b - x) >= min_gap for x in out):
            out.append(b)
    return sorted(out)


def local_shift(b: list[int], v: np.ndarray, window: int = 2) -> list[int]:
    """Each boundary to the least adjacent similarity nearby, as long as places stay distinct."""
    adjacent = np.concatenate(([np.inf], cosines(v[:-1], v[1:])))
    out: set[int] = set()
    for x in sorted(b):
        near = range(max(1, x - window), min(len(v) - 1, x + window) + 1)
        out.add(min(near, key=lambda y: (adjacent[y], abs(y - x), y), default=x))
    return sorted(out)


def neighbour_dissimilarity(v: np.ndarray, candidates: list[int], context: int | None = None) -> np.ndarray:
    """1 - cosine of the means of the segments before and after each candidate, or of fixed contexts."""
    c = np.array(sorted(candidates), np.int64)
    lo = np.concatenate(([0], c[:-1])) if context is None else c - context
    hi = np.concatenate((c[1:], [len(v)])) if context is None else c + context
    out = np.full(len(v), np.nan)
    if len(c):
        out[c] = 1 - cosines(frame_means(v, lo, c), frame_means(v, c, hi))
    return out


def contrast(v: np.ndarray, candidates: list[int], context: int = 10) -> np.ndarray:
    """How much better a unit fits what follows than what precedes it, centred on the median and scaled by the range."""
    c = np.array(sorted(candidates), np.int64)
    out = np.full(len(v), np.nan)
    if len(c):
        x = cosines(v[c], frame_means(v, c, c + context)) - cosines(v[c], frame_means(v, c - context, c))
        out[c] = (x - np.median(x)) / max(x.max() - x.min(), 1e-8) + 0.5
    return out


def bic_k(v: np.ndarray, most: int = 30, cap: int = 200) -> int:
    """k of least -2 * sum(mean similarity * pairs) + (k - 1) ln N over greedy splits of the first `cap` rows; k is at most a fourth of all rows."""
    if len(v) < 4:
        return 2
    most = min(most, len(v) // 4, 50)
    v = v[:cap]
    n, p = len(v), prefix(v)
    own = np.concatenate(([0.0], np.cumsum((v * v).sum(1))))
    order, _ = divisive_order(v, most)
    cost = []
    for k in range(2, most + 1):
        e = np.array([0, *sorted(order[: k - 1]), n])
        like = (((p[e[1:]] - p[e[:-1]]) ** 2).sum(1) - (own[e[1:]] - own[e[:-1]])).sum() / 2
        cost.append(-2 * like + (k - 1) * np.log(n))
    return int(np.argmin(cost)) + 2 if cost else 2


def elbow_k(v: np.ndarray, most: int = 30) -> int:
    """Where the second difference of the falling split scores is least; at most a third of the rows."""
    most = min(most, len(v) // 3, 40)
    if most < 2:
        return 2
    x = np.sort(divisive_order(v, most + 1)[1])[::-1]
    if len(x) < 3:
        return [max(2, min(most // 3, 8)), 2, 3][len(x)]
    return max(2, min(int(np.argmin(np.diff(x, 2))) + 3, most))


def gap_variance_k(v: np.ndarray, most: int = 40) -> int:
    """Where the variance of the similarities of neighbours within segments falls most from one k to the next; at most a fourth of the rows."""
    n = len(v)
    most = min(most, n // 4, 40)
    if n < 4 or most < 3:
        return 2
    x = smooth(v, 7)
    near = (x[:-1] * x[1:]).sum(1)
    order, _ = divisive_order(x, most)
    variance = []
    for k in range(2, most + 1):
        inside = np.ones(n - 1, bool)
        inside[np.array(order[: k - 1], np.int64) - 1] = False
        variance.append(near[inside].var() if inside.any() else 0.0)
    return max(2, min(int(np.argmin(np.diff(variance))) + 2, most))


def c99(similarity: np.ndarray, k: int | None = None, w: int = 5, c: float = 1.2) -> list[int]:
    """Rank transform in clamped (2w + 1)^2 windows, then the mean densities of the two corner blocks at each boundary: the k - 1 lowest, or all below
    mean - c * deviation. Block sums are two-dimensional prefix sums."""
    return c99_rows(lambda lo, hi: similarity[lo:hi], len(similarity), k, w, c)


def c99_rows(rows, n: int, k: int | None = None, w: int = 5, c: float = 1.2, cells: int = 1 << 20) -> list[int]:
    """c99 of n units over rows(lo, hi) of their similarity matrix, of which tiles of about `cells` values are held at a time."""
    if n < 3:
        return []
    step = max(1, cells // n)
    column, inner, right = np.zeros(n), np.zeros(n), np.zeros(n)  # sums of the ranks above, within the first corner block, and of whole rows
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        above, below = max(0, lo - w), min(n, hi + w)
        padded = np.full((hi - lo + 2 * w, n + 2 * w), np.nan)
        padded[above - lo + w : below - lo + w, w : n + w] = rows(above, below)
        own = padded[w : hi - lo + w, w : n + w]
        less, total = np.zeros(own.shape), np.zeros(own.shape)
        for dy in range(2 * w + 1):
            for dx in range(2 * w + 1):
                x = padded[dy : dy + hi - lo, dx : dx + n]
                total += ~np.isnan(x)
                less += x < own
        rank = (1 + less) / total
        for i in range(lo, hi):
            column += rank[i - lo]
            p = column.cumsum()
            inner[i], right[i] = p[i], p[-1]
    b = np.arange(1, n)
    score = inner[b - 1] / b**2 + (p[-1] - right[b - 1] - p[b - 1] + inner[b - 1]) / (n - b) ** 2
    if k is not None:
        return sorted(int(x) for x in b[np.lexsort((b, score))][: k - 1])
    return [int(x) for x in b[score < score.mean() - c * score.std()]]


def c99_text(sentences: list[list[str]], k: int | None = None, cells: int = 1 << 20) -> list[int]:
    """c99 over cosines of term counts, from the counts above zero alone."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for s in sentences for t in s}))}
    counts = [sorted(Counter(map(vocabulary.get, s)).items()) for s in sentences]
    size = np.array([len(x) for x in counts])
    term, count = (np.array([x[j] for row in counts for x in row], t) for j, t in ((0, np.int64), (1, np.float64)))
    start, some = np.cumsum(size) - size, np.flatnonzero(size)
    norm = np.sqrt([sum(x * x for _, x in row) for row in counts])

    def rows(lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, len(counts)))
        dense = np.zeros(len(vocabulary))
        for i in range(lo, hi):
            own = slice(start[i], start[i] + size[i])
            dense[term[own]] = count[own]
            if len(some):
                out[i - lo, some] = np.add.reduceat(dense[term] * count, start[some])
            dense[term[own]] = 0
        n = norm[lo:hi, None] * norm
        return np.where(n > 1e-12, out / np.where(n > 1e-12, n, 1), 0.0)

    return c99_rows(rows, len(counts), k, cells=cells)


def term_vectors(sentences: list[list[str]]) -> np.ndarray:
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in sentences for w in s}))}
    out = np.zeros((len(sentences), max(1, len(vocabulary))))
    for i, s in enumerate(sentences):
        for w in s:
            out[i, vocabulary[w]] += 1
    return out


def texttiling(sentences: list[list[str]], w: int = 20, k: int = 10) -> list[int]:
    """Token blocks, depth of their cosine, one three-tap pass, interior maxima; a boundary stands before the sentence in which the block ends."""
    if len(sentences) < 3:
        return []
    tokens = [t for s in sentences for t in s]
    n = len(tokens)
    w = min(w, max(3, n // 10))
    blocks = max(1, n // w)
    k = min(k, max(2, blocks // 3))
    v = term_vectors([tokens[i * w : (i + 1) * w if i + 1 < blocks else n] for i in range(blocks)])
    if blocks < 3:
        return []
    g, p = np.arange(1, blocks), prefix(v)
    s = np.round(cosines(p[g] - p[np.maximum(g - k, 0)], p[np.minimum(g + k, blocks)] - p[g]), 9)  # whole counts, so ties are ties
    d = np.maximum.accumulate(s) + np.maximum.accumulate(s[::-1])[::-1] - 2 * s
    x = np.round(d, 9)
    x[1:-1] = np.round((d[:-2] + d[1:-1] + d[2:]) / 3, 9)
    ends = np.cumsum([len(t) for t in sentences])
    out = set()
    for i in range(1, len(x) - 1):
        if x[i] > 0 and x[i] >= x[i - 1] and x[i] > x[i + 1]:
            b = int(np.searchsorted(ends, min((i + 1) * w, n)))
            if 0 < b < len(sentences):
                out.add(b)
    return sorted(out)


def dp_candidates(score: dict[int, float], n: int, k: int, least: int = 5, most: float | None = None, strength: float = 0.3) -> list[int]:
    """Exactly k of the candidates with the largest sum of scores less length penalties; greedy if no choice keeps all segments long enough."""
    c = sorted(b for b in score if 0 < b < n)
    k = min(k, len(c))
    if k < 1:
        return []
    expected = n / (k + 1)
    most = most if most is not None else 2.5 * expected

    def penalty(length):
        if length < least:
            return np.inf
        over = ((length - most) / expected) ** 2 * (strength + 0.25) if length > most else 0.0
        return over + strength * ((length - expected) / expected) ** 2

    value = [[-np.inf] * len(c) for _ in range(k)]
    back = [[-1] * len(c) for _ in range(k)]
    for i, b in enumerate(c):
        value[0][i] = score[b] - penalty(b)
        for j in range(1, k):
            for h in range(i):
                x = value[j - 1][h] + score[b] - penalty(b - c[h])
                if x > value[j][i]:
                    value[j][i], back[j][i] = x, h
    total = [value[k - 1][i] - penalty(n - b) for i, b in enumerate(c)]
    i = int(np.argmax(total))
    if total[i] == -np.inf:
        out: list[int] = []
        for b in sorted(c, key=lambda b: (-score[b], b)):
            if len(out) < k and all(abs(b - x) >= least for x in [0, n, *out]):
                out.append(b)
        return sorted(out)
    out = []
    for j in range(k - 1, -1, -1):
        out.append(c[i])
        i = back[j][i]
    return sorted(out)
