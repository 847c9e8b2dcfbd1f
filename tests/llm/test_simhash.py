import numpy as np
import pytest

from strandline.llm import components, simhash


def brute(fps, t):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= t:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def planted(n=400, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n // 4, dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        flip = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        fps = np.where(rng.random(n) < 0.5, fps ^ flip, fps)
    return np.unique(fps)


def test_every_word_has_one_home():
    words = np.random.default_rng(0).integers(0, 2**23, 5000).astype(np.uint64)
    row, code, over = simhash.near_codewords(words, 2)
    assert (np.bincount(row[over == 0], minlength=5000) == 1).all()
    assert all(simhash.remainder(int(c)) == 0 for c in code[:200])


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_components_match_brute_force(spark, threshold):
    fps = planted()
    want = brute(fps, threshold)
    nodes = spark.createDataFrame([(i, int(np.int64(f)), 0, 0) for i, f in enumerate(fps.view(np.int64))], "id long, f0 long, f1 long, f2 long").repartition(5)
    got = {r["id"]: r["root"] for r in components.components(simhash.links_of(nodes, threshold)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_definition():
    import xxhash

    words = b"a b c d e f a b c".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(words, 3) == want
    assert simhash.simhash([b"a", b"b"], 3) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.simhash([], 3) == 0


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x y z", 0), (4, "one two three four", 1), (4, "one two three four", 1), (9, "ONE two\tthree\nfour", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 int")
    got = sorted((tuple(r) for r in simhash.near_groups(docs, [(3, 42)]).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == 6 and by[1][1] == "0" * 16 and by[2][2] == 1
    assert by[4][2] == by[9][2] == 4 and by[4][1] == by[9][1]
    assert simhash.near_groups(docs.limit(0), [(3, 42)]).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 99), (None, 5)], "a long, b long")
    got = dict(tuple(r) for r in components.components(links).collect())
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[99] == 99
