import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import confirm, shingledup

KINDS = ("scattered", "replaced", "appended", "cut")


def edited(words, kind, rng, low=0.8, high=0.85):
    """A copy whose five-word shingles have a similarity in [low, high) to the text's."""
    n = len(words)
    new = lambda k: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(k)]
    for _ in range(60):
        m = rng.randint(1, max(1, n // 4))
        at = rng.randint(0, n - m)
        if kind == "scattered":
            out = list(words)
            for i in rng.sample(range(n), max(1, m // 4)):
                out[i] = new(1)[0]
        else:
            out = {"replaced": words[:at] + new(m) + words[at + m :], "appended": words + new(m), "cut": words[: n - m]}[kind]
        if low <= similarity(words, out) < high:
            return out
    return None


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_of_edit_is_found(spark, kind):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    rows, near, far = [], [], []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        rows.append((i, " ".join(words)))
        if copy := edited(words, kind, rng):
            rows.append((1000 + i, " ".join(copy).upper()))
            near.append(i)
        if copy := edited(words, kind, rng, 0.6, 0.79):
            rows.append((2000 + i, " ".join(copy)))
            far.append(i)
    got = dict(tuple(r) for r in shingledup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert len(near) > 80 and all(got[1000 + i] == i for i in near)
    by = dict(rows)
    assert all(got[2000 + i] == 2000 + i for i in far if i not in near or similarity(by[1000 + i].lower().split(), by[2000 + i].split()) < 0.8)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (4, "one two three four"), (4, "one two three four"), (9, "ONE two\tthree\nfour"), (10, "one two three")], "doc_id long, text string")
    for name in ("id", "d0", "keys", "k", "t", "root", "p", "q", "label", "m", "n", "component_id"):
        docs = docs.withColumn(name, F.lit("other"))
    got = shingledup.near_groups(docs).collect()
    by = {r[0]: r[1] for r in got}
    assert len(got) == 7 and by == {1: 1, 2: 1, None: None, 4: 4, 9: 4, 10: 10}
    assert shingledup.near_groups(docs.limit(0)).count() == 0


def test_large_groups_are_cut_into_parts(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, ids = [], 0
    for g in range(3):  # chains: each text is near its neighbours alone
        words = [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(40):
            rows.append((ids, " ".join(words)))
            ids += 1
            words = words[3:] + [rng.choice(vocabulary) for _ in range(3)]
    want = list(range(ids))
    for i in range(ids):
        for j in range(i):
            if similarity(rows[i][1].split(), rows[j][1].split()) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for part in (9000, 800):
        monkeypatch.setattr(confirm, "PART", part)
        got = dict(tuple(r) for r in shingledup.near_groups(docs).collect())
        assert [got[i] for i in range(ids)] == want


def test_a_bucket_over_many_partitions(spark):
    rows = spark.createDataFrame([(i, [7, i]) for i in range(3000)], "id long, keys array<long>").repartition(4)
    links = [tuple(r) for r in shingledup.stars(rows).collect()]
    root = dict(tuple(r) for r in shingledup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {root[i] for i in range(3000)} == {0}
