import random

import numpy as np
import pytest

from strandline.llm import lpf_dedup as lpf


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - lpf.WIDTH + 1):
                s = t[p : p + lpf.WIDTH]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        gone = set()
        if i is not None:
            for p in range(len(t) - lpf.WIDTH + 1):
                if first[t[p : p + lpf.WIDTH]] < i:
                    gone.update(range(p, p + lpf.WIDTH))
        out.append((i, len(t), len(gone), bytes(b for p, b in enumerate(t) if p not in gone)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(8, 60)) for _ in range(8)] + ["a" * 150, "ab" * 80]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 40))]
        while rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(10, len(s))], text(rng.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(20)] + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[3][1]), (900, None), (901, ""), (902, "x" * 49), (903, "y" * 50), (904, "y" * 51)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4 << 20), (2, 3000), (3, 700)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(lpf, "BLOCK", block)
    monkeypatch.setattr(lpf, "PART", block // 2)
    monkeypatch.setattr(lpf, "PIECE", 1 << 17)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "s", t) for i, t in rows], "doc_id long, text string, block string, data string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in lpf.remove_repeats(docs, carry=("data",)).collect()]
    want = brute([(i, (t or "").encode()) for i, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_owners_agree_across_pieces(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    whole = lpf.Block([(1, text)])
    monkeypatch.setattr(lpf, "PIECE", 300)
    parts = lpf.Block([(1, text)])
    assert (whole.at == parts.at).all() and (whole.own == parts.own).all() and len(whole.at) == len(text) - 49


def test_empty_table(spark):
    assert lpf.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_previous_factors():
    rng = random.Random(3)
    for alphabet, n in ((b"ab", 400), (b"abcdefgh", 600), (b"a", 200)):
        docs = [bytes(rng.choice(alphabet) for _ in range(n // 4)) for _ in range(4)]
        docs[2] = docs[0][10:90] + docs[1][5:40]
        docs[3] = docs[2]
        text = np.frombuffer(b"".join(docs), np.uint8)
        ends = np.cumsum([len(d) for d in docs])
        at = np.arange(len(text))
        doc = np.searchsorted(ends, at, "right")
        rank = np.array([1, 0, 3, 2])[doc]
        got = lpf.longest_previous(text, at, rank)
        raw = text.tobytes() + b"\0" * 200
        for p in rng.sample(range(len(text) - 64), 60):
            best = 0
            for q in np.flatnonzero(rank < rank[p]):
                k = 0
                while k < 64 and raw[p + k] == raw[q + k]:
                    k += 1
                best = max(best, k)
            assert min(64, got[p]) == best


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 9, 300), np.arange(100), np.arange(100)[::-1], np.zeros(50, int)):
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert lpf.previous_smaller(x).tolist() == want
