import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(key, text):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    text = text or ""
    u = TOKEN.findall(text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "B", "xyz", " ", "\n", "é", "ß", "語", "😀", "1", "<", ">", "<S", "P>", "\x00"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 14])
def test_cuts_equal_a_list_of_tokens_at_every_size_of_chunk(chunk):
    rng = random.Random(chunk)
    for t in [*texts(60), "a" * 50, "é" * 20, ""]:
        u = TOKEN.findall(t)
        draws = rng.randrange(1 << 32), rng.randrange(1 << 32)
        a, b = sorted(d % (len(u) + 1) for d in draws)
        assert fim.cut(np.frombuffer(t.encode(), np.uint8), draws, chunk) == (len(u), len("".join(u[:a])), len("".join(u[:b])))


def test_every_rank_has_its_place():
    t = "ab é c1" * 3
    u = TOKEN.findall(t)
    for r in range(len(u) + 1):
        assert fim.cut(np.frombuffer(t.encode(), np.uint8), (r, 0), 4)[1:] == (0, len("".join(u[:r])))


def test_rows_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(400))] + [(None, "no key"), (7, None), (8, ""), (9, "holds <M> already"), (7, "again"), (500, "word " * 60000), (-3, "x" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fim.transform(docs).withColumn("back", fim.restored()).collect()
    want = sorted(((k, t, *plainly(k, t)) for k, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str) == want
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_shares_are_parameters(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text to cut").alias("text"))
    forms = lambda **k: {r[0] for r in fim.transform(docs, **k).select("form").distinct().collect()}
    assert forms(plain=100) == {"plain"} and forms(plain=0, spm=100) == {"spm"} and forms(plain=0, spm=0) == {"psm"}
    a, b = (fim.transform(docs, seed=s).select("prefix_chars").collect() for s in (1, 2))
    assert a != b


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 5, "c"), (1, "one two", "x", 5, "c")], "doc_id long, text string, form string, n int, first string")
    got = fim.transform(docs)
    assert got.columns == ["doc_id", "text", "first", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["n"] for r in got.collect()} == {3} and got.count() == 2 and fim.transform(docs.limit(0)).count() == 0
