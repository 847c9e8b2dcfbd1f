"""The registered queries on the small tables: columns, rows, and what follows from the contract."""

import hashlib
import os
import zlib

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name,modulus,rest", [("op1_toxicity", 5, 0), ("op9_quality", 3, 1)])
def test_classifiers(spark, docs, name, modulus, rest):
    rows = queries.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_language(spark, docs):
    rows = queries.op10_langid(spark, SF).collect()
    known = {r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known | {"und"} and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]))


def test_neighbours(spark):
    rows = queries.op2_ann(spark, SF).collect()
    asked = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()]
    assert sorted((r["query_id"], r["rank"]) for r in rows) == sorted((q, k) for q in asked for k in range(1, 21))
    assert all(r["vec_id"] != r["query_id"] for r in rows)


@pytest.mark.parametrize("name", ["op3_urlfilter", "op11_filter_audit", "op13_fim"])
def test_queries_by_sql(spark, name):
    frame = queries.queries()[name](spark, SF)
    got = sorted(map(tuple, frame.collect()), key=str)
    con = duckdb.connect()
    for table in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    columns = ", ".join(frame.columns)
    assert got and got == sorted(con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)


def test_forest(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    least = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((least[i], least[j]))
                least = {k: a if x == b else x for k, x in least.items()}
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_lsh_forest(spark, SF).collect()}
    assert rows == {i: (len(sets[i]), least[i], least[i] == i) for i in docs}


def test_repeats(spark, docs):
    rows = queries.op4_suffix_dedup(spark, SF).collect()
    first = {}
    texts = {i: t.encode() for i, t in docs.items()}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(texts[i][p : p + 50], i)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        t, gone = texts[r["doc_id"]], bytearray(len(texts[r["doc_id"]]))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        kept = hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, kept)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op5_packing(spark, SF).collect()
    by, places = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == sorted(docs)
    for i, pieces in by.items():
        ids = [*exact.encode(docs[i], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(raw) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_fingerprints(spark, docs):
    rows = queries.op6_simhash(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    f = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    root = {i: i for i in f}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in f:
        for j in f:
            if j < i and (f[i] ^ f[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert all(r["component_id"] == top(r["doc_id"]) and len(r["fingerprint"]) == 16 for r in rows)


def test_items_and_counts(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hits = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    assert hits >= {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    rows = queries.op8_token_counts(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(r["n_chars"] == len(docs[r["doc_id"]]) for r in rows)
