"""The training-data pipeline: stages over the documents, each written and read again.

Every stage works on all its predecessor kept. All but the last return the columns of documents; the last returns packed token sequences.
Columns that documents don't have are left out by the first stage. Rows of null doc_id can't be named: the near-duplicate stage leaves them, as does suffix-array dedup, and they are packed like others.
SQL can express none of these models and codes, so ORACLE_SQL is None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, lpf_dedup, packing, shingledup
from strandline.llm.common import small_batches, table, written
from strandline.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification, fit on the documents' own language labels, doesn't reject. Null texts, empty ones and those without a letter have no language and go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return langid.keep(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates: texts whose five-word shingles have a similarity of 0.8 or more. SimHash anchors find the close
    copies, bands of MinHash values those that no SimHash threshold reaches, and the shingles themselves confirm all."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = shingledup.near_groups(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes and more that a document of smaller id holds. Those of which nothing is left go."""
    rows = lpf_dedup.remove_repeats(docs.select(*COLUMNS), carry=("lang", "source"), characters=True)
    text = F.col("kept").cast("string")
    rows = rows.where((F.size("spans") == 0) | (F.length(F.trim(text)) > 0))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    small_batches(spark)
    return decontam.clean(docs.select(*COLUMNS), decontam.indexes(table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in their places in sequences of at most 2048."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")), packing.groups_for(docs))


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
