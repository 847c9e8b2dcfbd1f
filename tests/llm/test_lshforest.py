import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import confirm, lshforest


def shingle_set(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plainly(rows, near=0.8, k=4):
    """The smallest id reachable, by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] and sets[i] and sets[j] or both and both >= near * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    smallest = {}
    for (i, _), c in zip(rows, least, strict=True):
        smallest[c] = min(smallest.get(c, i), i)
    return [(i, len(s), smallest[c]) for (i, _), s, c in zip(rows, sets, least, strict=True)]


def made(groups, copies, seed, low=10, high=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(low, high))]
        for _ in range(rng.randint(1, copies)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, len(words) // 20])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rng.shuffle(rows)
    return rows


def test_components_equal_those_of_all_pairs(spark):
    rows = made(60, 9, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, lshforest.near_groups(docs).collect())) == sorted(plainly(rows))


@pytest.mark.parametrize("part,crowd", [(6000, 64), (2000, 3)])
def test_large_groups_and_dense_regions(spark, monkeypatch, part, crowd):
    monkeypatch.setattr(confirm, "PART", part)
    monkeypatch.setattr(lshforest, "CROWD", crowd)
    rows = made(4, 60, 2, 40, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, lshforest.near_groups(docs).collect())) == sorted(plainly(rows))


def test_groups_of_several_parts_are_joined_across_parts(spark, monkeypatch):
    rng = random.Random(3)
    words, rows = [f"v{rng.randint(0, 999)}" for _ in range(60)], []
    for i in range(80):  # a chain: each text is near its neighbours alone, so the first set settles little
        rows.append((0, i, " ".join(words)))
        words = words[2:] + [f"v{rng.randint(0, 999)}" for _ in range(2)]
    rows += [(500, 500 + i, "lone text number " + " ".join(f"u{i}{j}" for j in range(9))) for i in range(5)]
    want = sorted(plainly([(i, t) for _, i, t in rows]))
    members = spark.createDataFrame(rows, "root long, id long, t string").repartition(4)
    for size in (4000, 900):
        monkeypatch.setattr(confirm, "PART", size)
        monkeypatch.setattr(confirm, "BROADCAST", 0 if size == 900 else 16 << 20)
        found = dict(tuple(r) for r in lshforest.components(confirm.confirmed(members, 4, 0.8)).collect())
        assert [found.get(i, i) for i, _, _ in want] == [c for _, _, c in want]


def test_linked_equals_all_pairs_whatever_is_joined_already():
    rng = np.random.default_rng(2)
    base = [rng.choice(1 << 40, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate((rng.choice(base[i % 6], 36, replace=False), rng.choice(1 << 40, rng.integers(0, 3))))).astype(np.uint64) for i in range(60)]
    for start in (np.arange(60), np.arange(60) // 12 * 12):
        want = start.tolist()
        for i in range(60):
            for j in range(i):
                if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                    a, b = sorted((want[i], want[j]))
                    want = [a if x == b else x for x in want]
        assert confirm.linked(sets, start, 0.8).tolist() == want


def test_regions_are_cut_where_they_are_crowded():
    shallow = np.repeat(np.array([1, 2, 3]), [2, 6, 3])
    deep = np.array([5, 9, 1 << 16, 1 << 16 | 1, 1 << 16 | 1, 2 << 16, 2 << 16, 3 << 16, 7, 8, 9])
    assert lshforest.regions(shallow, deep, 10).tolist() == [0, 2, 8]
    assert lshforest.regions(shallow, deep, 5).tolist() == [0, 2, 5, 7, 8]
    assert lshforest.regions(shallow, deep, 2).tolist() == [0, 2, 3, 5, 7, 8, 9, 10]


def test_signatures_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 50, 700, 3)]
    whole = lshforest.signatures(sets)
    monkeypatch.setattr(lshforest, "CHUNK", 60)
    assert (lshforest.signatures(sets) == whole).all() and (whole[2][0] == (sets[2] * lshforest.FUNCTIONS[0]).min())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x y z q r"), (4, "one two three"), (9, "ONE two\tthree"), (10, "one two"), (11, "x y z q r"), (11, "x y z q r"), (12, "É a b c"), (13, "é a b c"), (20, "long " + "text " * 90000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "digest", "shallow", "deep", "n", "m", "label", "root", "p", "q", "s", "t", "k", "component_id"):
        docs = docs.withColumn(name, F.lit("other"))
    got = sorted((tuple(r) for r in lshforest.near_groups(docs).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, 11), (4, 1, 4), (9, 1, 4), (10, 1, 10), (11, 2, 11), (11, 2, 11), (12, 1, 12), (13, 1, 13), (20, 2, 20)]
    assert got == sorted(want, key=str)
    assert lshforest.near_groups(docs.limit(0)).count() == 0
