import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandline.llm import filter_audit

FILTERS = {"A": "short", "B": "repetitive", "C": "capitals", "D": "symbols", "E": "copied"}


def failures(docs):
    out = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copied = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in docs)
        out.append((i, part or "", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copied]))
    return out


def audit(docs, labels):
    rows, good = {}, {k: max((q or 0 for j, q, _ in labels if j == k), default=0) for k, *_ in labels}
    toxic = {k: max((x or 0 for j, _, x in labels if j == k), default=0) for k, *_ in labels}
    failed = failures(docs)
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        for order in permutations("ABCDE"):
            for s, x in enumerate(order):
                at, before = "ABCDE".index(x), ["ABCDE".index(y) for y in order[:s]]
                out = [i for i, f in mine if f[at] and not any(f[b] for b in before)]
                rows[part, "".join(order), s + 1] = [
                    sum(not f[at] and not any(f[b] for b in before) for _, f in mine), len(out), sum(f[at] and any(f[b] for b in before) for _, f in mine),
                    sum(f[at] and sum(f) == 1 for _, f in mine), sum(good.get(i, 0) == 1 for i in out), sum(toxic.get(i, 0) == 1 for i in out),
                ]
    shapley = {}
    for (part, order, s), r in rows.items():
        shapley[part, order[s - 1]] = shapley.get((part, order[s - 1]), 0) + r[1]
    return sorted([p, o, s, *r, shapley[p, o[s - 1]]] for (p, o, s), r in rows.items())


def made(n=70):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "#", "É" * 3, "ABC def"]
    for _ in range(25):
        words = [rng.choice(["alpha", "beta", "É", "x1", "Gamma"]) + str(rng.randint(0, rng.choice([1, 500]))) for _ in range(rng.choice([3, 199, 200, 260]))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(words) + rng.choice(["", "", " $5", " THE END IS NEAR " * 5]))
    docs = [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice([None, "a", "b", "hot", "hot", "hot"])) for _ in range(n)]
    docs += docs[:6] + [(-1, texts[9], "a")] * 3
    labels = [(rng.choice([None, *range(n)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)]
    return docs, labels


def test_equals_plain_counts(spark):
    docs, labels = made()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    for name in ("key", "k", "salt", "place", "n", "word", "words", "digest", "short", "failed", "bit", "t"):  # names of the operator's own columns
        d = d.withColumn(name, F.lit("other"))
    names = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit("x")).withColumn("n", F.lit(0))
    got = filter_audit.interactions(filter_audit.flagged(d), FILTERS, names, {"good_lost": "quality", "toxic_lost": "toxic"})
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(list(r) for r in got.collect()) == audit(docs, labels)


def test_flags_of_each_row(spark):
    docs, _ = made(40)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = sorted((str((r["key"], r["part"], *(r[c] for c in FILTERS.values()))) for r in filter_audit.flagged(d).collect() for _ in range(r["n"])))
    assert got == sorted(str((i, p, *map(bool, f))) for i, p, f in failures(docs))


def test_empty_tables_and_fewer_filters(spark):
    d = spark.createDataFrame([(1, "a # b", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.flagged(d.limit(0)), FILTERS, labels, {"good_lost": "quality"}).count() == 0
    rows = filter_audit.interactions(filter_audit.flagged(d), {"x": "short", "y": "symbols"}, labels, {}).orderBy("filter_order", "step").collect()
    assert [tuple(r) for r in rows] == [("s", "xy", 1, 0, 1, 0, 0, 1), ("s", "xy", 2, 0, 0, 1, 0, 1), ("s", "yx", 1, 0, 1, 0, 0, 1), ("s", "yx", 2, 0, 0, 1, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.interactions(filter_audit.flagged(d), {}, labels, {})


def test_a_very_long_text(spark):
    d = spark.createDataFrame([(1, "word other " * 200000, "s"), (2, "x" * 2000000, "s")], "doc_id long, text string, source string")
    got = {r["key"]: (r["short"], r["repetitive"]) for r in filter_audit.flagged(d).collect()}
    assert got == {1: (False, True), 2: (True, False)}
