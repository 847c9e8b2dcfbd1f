"""Each stage of the pipeline on small tables: its decisions against a plain version."""

import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandline.llm import lpf_dedup

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(pipeline.__file__))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rng = random.Random(3)
    rows = [tuple(r) for r in base]
    long = next(r for r in base if 1500 < r["n_chars"] < 3000)
    words = long["text"].split(" ")
    for i in range(5):  # near copies: one word in two hundred changed
        w = list(words)
        for _ in range(max(1, len(w) // 200)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w), long["lang"], "near", 0))
    rows += [(20_000 + i, long["text"], long["lang"], "copy", 0) for i in range(5)]
    rows += [(30_000, f"Some words before. {item} and after.", "en", "leak", 0), (30_001, "12 34 !!", "en", "junk", 0), (30_002, None, None, None, None), (30_003, "", "en", "empty", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache(), long["doc_id"]


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_in_turn(spark, docs, tmp_path):
    first, long = docs
    steps, rows = {}, first
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, rows, SF).write.parquet(str(tmp_path / name))
        rows = steps[name] = spark.read.parquet(str(tmp_path / name))
        assert rows.columns == pipeline.COLUMNS
    assert ids(first) - ids(steps["language"]) == {30_001, 30_002, 30_003}
    kept = ids(steps["near_duplicates"])
    assert not kept & {*range(10_000, 10_005), *range(20_000, 20_005)} and long in kept
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in steps["near_duplicates"].collect()}
    got = {r["doc_id"]: r["text"].encode() for r in steps["repeats"].collect()}
    seen: dict[bytes, int] = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - lpf_dedup.WIDTH + 1):
            seen.setdefault(texts[i][p : p + lpf_dedup.WIDTH], i)
    for i, t in texts.items():
        covered = sum(any(seen[t[q : q + 50]] < i for q in range(max(0, p - 49), min(p, len(t) - 50) + 1)) for p in range(len(t))) if len(t) < 4000 else None
        if covered is not None and i in got:
            assert 0 <= len(got[i]) - (len(t) - covered) <= 8  # partial characters stay
    assert 30_000 not in ids(steps["decontamination"])
    last = pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert {r["doc_id"] for r in last} == ids(rows) and max(r["offset"] + r["length"] for r in last) <= 2048


def test_empty_table(spark, docs):
    rows = docs[0].limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, rows, SF).count() == 0


def test_clashing_columns_are_left_out(spark, docs):
    rows = docs[0].where("doc_id < 50 or doc_id >= 10000")
    for name in ("id", "t", "k", "root", "digest", "block", "part", "score", "spans", "kept"):
        rows = rows.withColumn(name, F.lit("other"))
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == pipeline.COLUMNS and rows.count() > 0


def test_the_rest_imports_without_these_folders(tmp_path):
    code = textwrap.dedent("""
        import sys
        class Block:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("strandline.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Block())
        import __spark_entry__ as e
        assert len(e.queries()) > 100 and not any(q.startswith("op1_") for q in e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
