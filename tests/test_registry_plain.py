"""Families of the registry against plain forms of their definitions, on random sequences."""

from collections import Counter

import numpy as np
import pytest

from strandline.operators import segmenters as S
from strandline.operators.text import hashed_counts
from strandline.plans import registry

SEEDS = range(4)


def sequence(seed, n=64):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.standard_normal(16)
        rows += [c + rng.standard_normal(16) * 0.8 for _ in range(rng.integers(3, 12))]
    v = np.array(rows[:n])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return registry.Input(unit(v[:, :8]), unit(v[:, 8:]), int(rng.integers(4, 11)), rng.random(n), None, shots=rng.random(n))


def run(x, name):
    return registry.run(x, registry.parse(name))


def cos(a, b):
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def smooth(v, w):
    rows = [v[max(0, i - w // 2) : i + w // 2 + 1].mean(0) for i in range(len(v))]
    return np.array([r / np.linalg.norm(r) for r in rows])


def splits(v, segments):
    """{boundary: score} of the greedy top-down splits."""
    parts, out = [(0, len(v))], {}
    while len(out) < segments - 1:
        best = max(((1 - cos(v[a:s].mean(0), v[s:e].mean(0)), a, s, e) for a, e in parts for s in range(a + 1, e)), default=None)
        if best is None:
            break
        score, a, s, e = best
        parts.remove((a, e))
        parts += [(a, s), (s, e)]
        out[s] = score
    return out


def scaled(x):
    x = np.array(x, float)
    return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x * 0


def top(score, k):
    return sorted(sorted(score, key=lambda b: -score[b])[:k])


def both(s1, s2):
    m1, m2 = max(s1.values()), max(s2.values())
    return {b: (s1.get(b, 0) / m1 + s2.get(b, 0) / m2) / 2 for b in {*s1, *s2}}


def gap(v, w=3):
    return {b: 1 - cos(v[max(0, b - 1 - w) : b + w].mean(0), v[max(0, b - w) : b + w + 1].mean(0)) for b in range(1, len(v))}


def recency(v):
    out = {}
    for b in range(1, len(v)):
        left = sum(np.exp(-0.5 * d) * v[b - 1 - d] for d in range(4) if b - 1 - d >= 0)
        right = sum(np.exp(-0.5 * d) * v[b + d] for d in range(4) if b + d < len(v))
        out[b] = 1 - cos(left, right)
    return out


def halves(a, b, n):
    """Mean of two scores over all boundaries, either scaled, what is missing counting 0."""
    a, b = (scaled([s.get(i, 0.0) for i in range(1, n)]) for s in (a, b))
    return {i + 1: (a[i] + b[i]) / 2 for i in range(n - 1)}


@pytest.mark.parametrize("seed", SEEDS)
def test_mixtures_of_splits_and_gaps(seed):
    x = sequence(seed)
    v, k, n = x.v1, x.k, len(x.v1)
    s = splits(v, 3 * (k - 1) + 2)
    drop = {b: 1 - np.mean([v[i] @ v[j] for i in range(max(0, b - 3), b) for j in range(b, min(n, b + 3))]) for b in range(1, n)}
    assert run(x, "ensemble") == top(halves(s, drop, n), k - 1)
    assert run(x, "divisive_recency") == top(halves(s, recency(v), n), k - 1)
    assert run(x, "recency") == top(recency(v), k - 1)


@pytest.mark.parametrize("seed", SEEDS)
def test_side_signals(seed):
    x = sequence(seed)
    target = x.k - 1
    c = splits(x.v1, max(3 * target, target + 2) + 1)
    places = sorted(c)
    cs, ps, sh = scaled([c[b] for b in places]), scaled(x.side[places]), scaled(x.shots[places])
    want = lambda w: top(dict(zip(places, w[0] * cs + w[1] * ps + w[2] * sh, strict=True)), target)
    assert run(x, "divisive_prosody") == want((0.7, 0.3, 0))
    assert run(x, "divisive_shots") == want((0.7, 0, 0.3))
    assert run(x, "divisive_prosody_shots") == want((0.6, 0.2, 0.2))
    x.shots = None
    assert run(x, "divisive_prosody_shots") == want((0.75, 0.25, 0))


def weight(x):
    p = (x - x.min()) / (x - x.min()).sum() + 1e-9
    p /= p.sum()
    return np.exp((p * np.log2(p)).sum() / np.log2(len(p)))


@pytest.mark.parametrize("seed", SEEDS)
def test_two_stages_and_hierarchy(seed):
    x = sequence(seed)
    g = gap(x.v1)
    text, side = np.array([g[b] for b in sorted(g)]), x.side[1:]
    a, b = weight(text), weight(side)
    both_ = a / (a + b) * scaled(text) + b / (a + b) * scaled(side)
    assert run(x, "two_stage") == top(g, x.k - 1)
    assert run(x, "two_stage_prosody") == top(dict(enumerate(both_, 1)), x.k - 1)
    chapters = max(2, round(0.3 * x.k)) - 1
    assert run(x, "hierarchical") == top(g, chapters)
    sub = top(dict(enumerate(both_, 1)), x.k - 1)
    assert run(x, "hierarchical_prosody") == top({b: g[b] for b in sub}, chapters)
    chunks = np.array([x.v1[i : i + 4].mean(0) for i in range(0, len(x.v1), 4)])
    assert run(x, "two_stage_chunked") == [4 * b for b in top(gap(chunks), x.k - 1)]
    chunks = np.array([x.v1[i : i + 3].mean(0) for i in range(0, len(x.v1), 3)])
    assert run(x, "divisive_chunked3") == [3 * b for b in sorted(splits(chunks, x.k))]


@pytest.mark.parametrize("seed", SEEDS)
def test_two_models(seed):
    x = sequence(seed)
    v1, v2 = smooth(x.v1, 9), smooth(x.v2, 9)
    k = max(2, round(0.7 * x.k))
    maps = lambda over: (splits(v1, over), splits(v2, over))
    assert run(x, "cross_e5_frac70") == top(both(*maps(4 * k + 2)), k)
    s1, s2 = maps(4 * k + 2)
    absent = max(len(s1), len(s2)) + 1
    rank = lambda s: {b: i + 1 for i, b in enumerate(sorted(s, key=lambda b: -s[b]))}
    r1, r2 = rank(s1), rank(s2)
    borda = {b: -(r1.get(b, absent) + r2.get(b, absent)) for b in sorted({*s1, *s2})}
    assert registry.run(x, registry.Method("rank", 9, 0.7)) == top(borda, k)
    c = both(*maps(max(10, round(3 * x.k))))
    many = sum(s >= 0.6 * max(c.values()) for s in c.values())
    assert run(x, "cross_e5_thresh60") == top(c, max(2, min(many, round(1.5 * x.k))))
    c = both(*maps(3 * k + 2))
    most = max(x.side[b] for b in c)
    assert run(x, "cross_e5_prosody") == top({b: 0.7 * c[b] + 0.3 * x.side[b] / most for b in c}, k)
    one = lambda v: {b: 1 - cos(v[max(0, b - 7) : b].mean(0), v[b : b + 7].mean(0)) for b in range(1, len(v))}
    assert run(x, "cross_e5_combined_depth") == top(both(one(v1), one(v2)), k)
    c = both(*maps(6 * k + 2))
    picked = []
    for b in sorted(c, key=lambda b: -c[b]):
        if len(picked) < k and all(abs(b - p) >= 10 for p in picked):
            picked.append(b)
    assert run(x, "cross_e5_nms10") == sorted(picked)


@pytest.mark.parametrize("seed", SEEDS)
def test_two_passes(seed):
    x = sequence(seed)
    v1, v2, n = smooth(x.v1, 9), smooth(x.v2, 9), len(x.v1)

    def again(c, reach=None):
        edges = [0, *c, n]
        out = []
        for v in (v1, v2):
            s = {b: 1 - cos(v[(edges[i] if reach is None else max(0, b - reach)) : b].mean(0), v[b : (edges[i + 2] if reach is None else b + reach)].mean(0)) for i, b in enumerate(c)}
            out.append({b: s[b] / max(s.values()) for b in s})
        return {b: (out[0][b] + out[1][b]) / 2 for b in c}

    def check(name, frac, over, multiple, w, reach=None):
        k = max(2, round(frac * x.k))
        first = both(splits(v1, over(k)), splits(v2, over(k)))
        c = top(first, multiple * k)
        second = again(c, reach)
        assert run(x, name) == top({b: w * first[b] + (1 - w) * second[b] for b in c}, k), name

    check("iterative_cross_e5", 0.7, lambda k: 3 * x.k + 2, 2, 0.5)
    check("iterative_v2_frac75", 0.75, lambda k: 4 * x.k + 2, 3, 0.3)
    check("iterative_v2_segs4", 0.75, lambda k: 4 * x.k + 2, 4, 0.3)
    check("iterative_v2_w04", 0.75, lambda k: 4 * x.k + 2, 3, 0.4)
    check("iterative_fw_e5base", 0.7, lambda k: max(2 * k + 2, k + 4), 2, 0.4, 15)
    k = max(2, round(0.75 * x.k))
    first = both(splits(v1, 3 * x.k + 2), splits(v2, 3 * x.k + 2))
    c = top(first, 2 * k)
    second, most = again(c), max(x.side[b] for b in c)
    assert run(x, "iterative_cross_e5_prosody") == top({b: 0.4 * first[b] + 0.4 * second[b] + 0.2 * x.side[b] / most for b in c}, k)


@pytest.mark.parametrize("seed", SEEDS)
def test_numbers_of_segments(seed):
    x = sequence(seed)
    v, n = x.v1, len(x.v1)
    cost = {}
    for k in range(2, min(30, n // 4) + 1):
        e = [0, *sorted(splits(v, k)), n]
        like = sum(v[i] @ v[j] for a, b in zip(e, e[1:]) for i in range(a, b) for j in range(i + 1, b))
        cost[k] = -2 * like + (k - 1) * np.log(n)
    assert S.bic_k(v) == min(cost, key=cost.get)
    most = min(30, n // 3)
    d = np.diff(sorted(splits(v, most + 1).values(), reverse=True), 2)
    assert S.elbow_k(v) == max(2, min(int(np.argmin(d)) + 3, most))
    sv = smooth(v, 7)
    near = [sv[i] @ sv[i + 1] for i in range(n - 1)]
    cuts = [splits(sv, k) for k in range(2, n // 4 + 1)]
    spread = [np.var([near[i] for i in range(n - 1) if i + 1 not in c]) for c in cuts]
    assert S.gap_variance_k(v) == max(2, min(int(np.argmin(np.diff(spread))) + 2, n // 4))


@pytest.mark.parametrize("seed", range(25))
def test_texttiling(seed):
    rng = np.random.default_rng(seed)
    sentences = [[f"{'abcd'[i // 12]}{w}" for w in rng.integers(0, 12, rng.integers(1, 9))] for i in range(48)]
    tokens = [t for s in sentences for t in s]
    w = min(20, max(3, len(tokens) // 10))
    blocks = max(1, len(tokens) // w)
    k = min(10, max(2, blocks // 3))
    counts = [Counter(tokens[i * w : (i + 1) * w] if i < blocks - 1 else tokens[i * w :]) for i in range(blocks)]
    s = []
    for g in range(1, blocks):
        a, b = sum(counts[max(0, g - k) : g], Counter()), sum(counts[g : g + k], Counter())
        s.append(sum(a[t] * b[t] for t in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    d = [max(s[: i + 1]) + max(s[i:]) - 2 * x for i, x in enumerate(s)]
    d = [d[0], *(sum(d[i - 1 : i + 2]) / 3 for i in range(1, len(d) - 1)), d[-1]]
    want = set()
    for i in range(1, len(d) - 1):
        if d[i] > 0 and d[i] >= d[i - 1] - 1e-12 and d[i] > d[i + 1] + 1e-12:
            total = 0
            for j, sentence in enumerate(sentences):
                total += len(sentence)
                if total >= (i + 1) * w:
                    want.add(j)
                    break
    assert S.texttiling(sentences) == sorted(b for b in want if 0 < b < 48)


def test_blocks_are_vectors_of_joined_text():
    words = [list("ab"), list("bcd"), ["e"], [], list("aab"), ["f", "g"]]
    x = registry.Input(np.eye(6), np.eye(6), 3, tokens=words)
    for w in (3, 5):
        for i in range(6):
            c = hashed_counts([sum(words[max(0, i - w // 2) : i + w // 2 + 1], [])])[0]
            assert np.allclose(x.blocks(w)[i], c / np.linalg.norm(c))
