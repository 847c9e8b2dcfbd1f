"""Language ID, quality and toxicity: held-out accuracy, whole texts, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, quality, toxicity

SYLLABLES = {"aa": "lo mi ra ne tu".split(), "bb": "sch ung keit ver ach".split(), "cc": "tion the ing and ou".split()}


def say(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(360):
        lang = "aa bb cc".split()[i % 3]
        text = say(lang, rng.randint(5, 60), rng)
        toxic = int(i % 7 == 0)
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(["zorgblat", "quixvomp"]))
            text = " ".join(words)
        good = int(i % 4 != 0)
        if not good:
            text = " ".join(w + rng.choice(["###", "&&&"]) for w in text.split())
        rows.append((i, text, lang, "s", len(text), good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int").repartition(3).cache()


ODD = [(1, None, 0), (2, "", 0), (3, "123 ... !!", 9), (None, "lo mi ra", 8), (4, "x" * 300_000, 300_000), (4, "x" * 300_000, 300_000)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_chars long").selectExpr("*", "'en' AS lang", "1 AS score", "2 AS k", "3 AS t")


def test_language(spark, docs):
    model = langid.fit(docs, where=docs.doc_id % 5 != 0)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect() if r["doc_id"] % 5 == 0}
    assert np.mean([got[k]["lang_pred"] == v for k, v in want.items()]) > 0.97
    rows = langid.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.keep(docs, model).count() >= 0.99 * docs.count()
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(3), empty).collect()} == {"und"}


def test_language_table_is_mean_times_layer():
    rng = np.random.default_rng(1)
    emb, w, b = rng.standard_normal((langid.BUCKETS, langid.DIM)), rng.standard_normal((langid.DIM, 3)), rng.standard_normal(3)
    model = langid.Model(["a", "b", "c"], emb @ w, b, 1.7, 0.0)
    text = "Some words, ünd 12 others."
    p = langid.softmax((emb[langid.subwords(text)].mean(0) @ w + b) * 1.7)
    assert model.score(text)[:2] == ("abc"[p.argmax()], pytest.approx(p.max()))


def test_junk_is_rejected():
    rng = random.Random(5)
    model = langid.train([(say(x, 40, random.Random(i)), x) for i in range(200) for x in SYLLABLES])
    assert model.catches > 0.9 and model.costs <= 2 * langid.COST
    junk = ["".join(rng.sample(t, len(t))) for t in (say("cc", 40, rng) for _ in range(50))]
    assert np.mean([model.score(t)[2] for t in junk]) > 0.9 and not any(model.score(say(x, 40, rng))[2] for x in SYLLABLES for _ in range(50))


def test_language_counts_whole_texts():
    model = langid.train([(say(x, 40, random.Random(i)), x) for i in range(90) for x in SYLLABLES])
    late = say("aa", 200, random.Random(0)) + " " + say("bb", 30_000, random.Random(2))
    assert len(late) > langid.CHUNK and model.score(late)[0] == "bb"


def test_quality(spark, docs):
    labels = docs.select("doc_id", "quality", "toxic")
    model = quality.fit(docs, labels, "quality", where=labels.doc_id % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    want = {r["doc_id"]: r["quality"] for r in docs.collect() if r["doc_id"] % 3 == 1}
    assert np.mean([(got[k] >= 0.5) == v for k, v in want.items()]) > 0.95
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0), "quality")
    assert {r["score"] for r in quality.score(docs.limit(3), none).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS), 0.3, rng.standard_normal(quality.BUCKETS + quality.STATS), rng.standard_normal((quality.BUCKETS + quality.STATS, quality.RANK)))
    ids, x = np.array([3, 9, 77, 1000]), rng.standard_normal(4)
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw(ids, x) == pytest.approx(0.3 + x @ m.w[ids] + pairs)


def test_toxicity(spark, docs):
    labels = docs.select("doc_id", "quality", "toxic")
    model = toxicity.fit(docs, labels, "toxic", where=labels.doc_id % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    want = {r["doc_id"]: r["toxic"] for r in docs.collect() if r["doc_id"] % 5 == 0}
    assert np.mean([(got[k] >= 0.5) == v for k, v in want.items()]) > 0.9
    assert b"zorgb" in model.toxic and b"zorgb" not in model.ordinary
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), "toxic")
    assert {r["score"] for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}


def test_toxicity_score_is_the_plain_one(spark, docs):
    labels = docs.select("doc_id", "quality", "toxic")
    model = toxicity.fit(docs, labels, "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    one, two = toxicity.packer(model.ordinary), toxicity.packer(model.toxic + model.ordinary)
    for r in docs.limit(40).collect():
        t = r["text"].encode()
        pieces = [t[i : i + 96] for i in range(0, max(1, len(t) - 32), 64)]
        d = sorted((len(one.compress(w)) - len(two.compress(w)) for w in pieces), reverse=True) + [-99]
        x = np.array([min(max(d[0], 0), 8), min(max(d[1], 0), 8), np.log1p(sum(v >= model.threshold for v in d))])
        z = model.weights[0] + (x - model.mean) / model.spread @ model.weights[1:]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_labels_are_never_read(spark, docs):
    labels = docs.select("doc_id", "toxic")
    where = labels.doc_id % 5 != 0
    a = toxicity.fit(docs, labels, "toxic", where=where)
    b = toxicity.fit(docs, labels.withColumn("toxic", F.when(where, F.col("toxic")).otherwise(1 - F.col("toxic"))), "toxic", where=where)
    assert (a.toxic, a.ordinary, a.threshold) == (b.toxic, b.ordinary, b.threshold) and (a.weights == b.weights).all()


def test_calibration_takes_no_text_with_its_own_dictionary(spark, docs, monkeypatch):
    seen = []
    plain = toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda rows, ratio: seen.append({t for t, _ in rows}) or plain(rows, ratio))
    labels = docs.select("doc_id", "toxic")
    toxicity.fit(docs, labels, "toxic")
    pairs, whole = seen[:-1], seen[-1]
    assert len(pairs) == 2 * len(toxicity.RATIOS) and all(a | b == whole for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    assert {toxicity.half(k) for k in range(100)} == {0, 1} and toxicity.half(None) in (0, 1)


def test_wrong_labels_do_not_empty_the_dictionary():
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        words = say("cc", 30, rng).split()
        bad = i % 3 == 0
        if bad:
            words.insert(rng.randint(0, len(words)), rng.choice(["zorgblat", "quixvomp"]))
        rows.append((" ".join(words).encode(), int(bad and i % 60 != 0)))  # one in twenty of the toxic texts is labelled ordinary
    assert b"zorgb" in toxicity.train_dictionaries(rows).toxic


def test_windows_cover_everything():
    for n in (0, 1, 95, 96, 97, 1000):
        text = bytes(range(256)) * 4
        text = text[:n]
        seen = set()
        for w, i in zip(toxicity.windows(text), range(0, 10_000, toxicity.STEP)):
            assert text[i : i + len(w)] == w
            seen.update(range(i, i + len(w)))
        assert seen == set(range(n))
