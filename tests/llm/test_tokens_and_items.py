"""URL filter, packing, decontamination and token counts against plain versions."""

import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from strandline.llm import decontam, packing, queries, tokencount, urlfilter

URLS = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "ftp://b.example.com/de/", "x://example.com/de", "http://notexample.com/de/", "http://a.org/fr/1#2", "http://org/fr/", "http://net:80/", "https://a.net?/en/", "u://v.example.net://w/en/", "http://é.Ünet.net/\n/"]


def plain(url):
    i = (url or "").find("://")
    rest = url[i + 3 :] if i >= 0 else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, "http://net/")], "page_id long, url string").withColumn("host", F.lit("clash"))
    want = Counter((i, *plain(u)) for i, u in [*enumerate(URLS), (3, "http://net/")])
    assert Counter(map(tuple, urlfilter.filter_urls(pages, queries.RULES).collect())) == want
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    assert Counter(map(tuple, urlfilter.filter_urls_joined(pages, rules).collect())) == want
    monkeypatch.setattr(urlfilter, "MOST_LENGTHS", 1)
    assert Counter(map(tuple, urlfilter.filter_urls_joined(pages, rules).collect())) == want
    assert urlfilter.filter_urls(pages.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, []).collect()} == {"allow"}


def test_colliding_digests(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b))
    urlfilter.DigestArray.write([("ab", "/", "block"), ("cd", "/", "allow")], str(tmp_path))
    index = urlfilter.DigestArray(str(tmp_path))
    assert [r[2:] for r in urlfilter.judge(index, ["x://ab/", "x://cd/", "x://ef/"], "allow")] == [("ab/", "block"), ("cd/", "allow"), (None, "allow")]


def test_ids_are_the_tokenizers(spark):
    path = P.path("byte_bpe_50k.json")
    exact, ids = Tokenizer.from_file(path), packing.Ids(path)
    rng = random.Random(2)
    odd = "ab the  \n\t\x1c\x85 ñéß漢😀½Ⅷ'sll.,_<|endoftext|>"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b", "", " "]
    assert all(ids(t) == exact.encode(t, add_special_tokens=False).ids for t in texts)
    for t in (" " * 3_000_000 + "x", "a\n" + "\n" * 1_000_000, "a" * 1_000_000, "\u3000\t" * 600_000):
        assert ids(t) == exact.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [None, "", "x"] + ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 4000))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "x")], "doc_id long, text string").withColumn("length", F.lit("clash"))
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(packing.pieces(docs, path, size=256), 3, 256).collect()
    exact = Tokenizer.from_file(path)
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        if i != 2:
            raw = b"".join(b for _, b in sorted(by[i]))
            want = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
            assert raw == b"".join(x.to_bytes(4, "little") for x in want)
    assert len(by[2]) == 2  # repeated rows are packed each
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(packing.pieces(docs.limit(0), path), 1).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_is_first_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins, want = [], [0] * 300
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, room in enumerate(bins) if room >= lengths[i]), len(bins))
        if b == len(bins):
            bins.append(100)
        bins[b] -= lengths[i]
        want[i] = b
    assert packing.first_fit(lengths, 100) == want and packing.first_fit([], 100) == []


def test_digest_of_pieces(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.pieces(docs, P.path("byte_bpe_50k.json")).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(row["ids"])


def items(rng, n=60):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    return [(i, f"{say(rng.randint(10, 40))}. {say(rng.randint(3, 12))}.") for i in range(n)], say


def test_wand_is_exact():
    rng = random.Random(1)
    bench, _ = items(rng)
    index = decontam.Index(bench)
    for _ in range(300):
        words = set(rng.sample(list(index.terms), rng.randint(1, 60))) | set(decontam.words_of(rng.choice(bench)[1].encode())[: rng.randint(0, 40)])
        scores = Counter()
        for w in words & set(index.terms):
            for i, v in zip(index.terms[w].items, index.terms[w].weights):
                scores[i] += v
        for t in (0.05, 0.3, 0.6):
            assert sorted(i for i, _ in index.walk(words, t)) == sorted(i for i, v in scores.items() if v >= t)


def test_contaminated(spark):
    rng = random.Random(6)
    bench, say = items(rng)
    rows = [(i, say(rng.randint(0, 300))) for i in range(40)]
    want = set()
    for d in range(100, 130):
        i, t = rng.choice(bench)
        rows.append((d, f"{say(rng.randint(0, 200))} {t.upper() if d % 2 else t} {say(rng.randint(0, 200))}"))
        want.add((d, i))
    rows += [(200, None), (201, ""), (202, "... !"), (203, bench[0][1].split(".")[0]), (100, rows[40][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = decontam.indexes(spark.createDataFrame([*bench, (999, None), (998, "!")], "item_id long, text string"))
    got = decontam.contaminated(docs, found).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = {r["doc_id"] for r in decontam.clean(docs, found).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    none = decontam.indexes(spark.createDataFrame([], "item_id long, text string"))
    assert decontam.contaminated(docs, none).count() == 0 and decontam.clean(docs, none).count() == len(rows)


@pytest.mark.parametrize("n", [73, 95, 130, 200, 300])
def test_long_items_are_found_at_any_place(n):
    rng = random.Random(n)
    bench, say = items(rng)
    long = [(1000 + i, f"{say(n - n // 4)}. {say(n // 4)}.") for i in range(8)]
    index = decontam.Index(bench + long)
    for i, t in long:
        for at in rng.sample(range(200), 6):
            assert [x[0] for x in index.find(f"{say(at)} {t} {say(100)}".encode())] == [i]
        words = t.split()
        assert [x[0] for x in index.find(f"{say(50)} {' '.join(words[n // 3 :])} {say(100)}".encode())] == [i]  # all but a third
    assert index.find(say(2000).encode()) == []


def test_token_counts_are_the_tokenizers(spark):
    v = tokencount.sentencepiece_vocabulary(P.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram([*v, ("<unk>", 0.0)], len(v), False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(8)
    odd = "ab the▁  \n\tñéß漢字😀☃̀ xyz123"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["", " ", "▁", "☃☃ ☃a"]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, v).collect()}
    assert all(got[i] == len(exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)) and got[None] == 0


def test_ties_keep_the_earliest_start():
    v = [("▁", -1.0), ("a", -1.0), ("▁a", -2.0), ("aa", -2.0), ("▁aa", -3.0)]
    exact = Tokenizer(models.Unigram([*v, ("<unk>", 0.0)], len(v), False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = tokencount.Counter(v)
    for t in ("a", "aa", "aaa", "aaaa", "b", "ab", "bb ab"):
        assert count(t) == len(exact.encode(t, add_special_tokens=False).ids), t


def test_token_counts_of_empty_tables_and_very_long_words(spark):
    vocabulary = [("\u2581", -1.0), ("a", -2.0), ("aa", -2.5), ("\u2581a", -1.5)]
    docs = spark.createDataFrame([(1, "a" * 100_001, "x"), (2, "b" * 50_000, "y")], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, vocabulary).collect()}
    assert got == {1: 50_001, 2: 2} and tokencount.count_tokens(docs.limit(0), vocabulary).count() == 0
