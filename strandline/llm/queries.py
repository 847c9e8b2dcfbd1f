"""The registered queries of the training-data operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, filter_audit, fim, langid, lpf_dedup, lshforest, packing, quality, simhash, tokencount, toxicity, urlfilter
from .common import fold, small_batches, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def classified(scores: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", where=fold(F.col("doc_id"), 5) != 0)
    return classified(toxicity.score(docs, model), 5, 0)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    rows = packing.pieces(docs, tokenizer("byte_bpe_50k.json"), size=2048, end=1)
    rows = rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(rows, packing.groups_for(docs), size=2048)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_groups(table(spark, sf_dir, "documents"), [(3, 42)], threshold=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), decontam.indexes(table(spark, sf_dir, "benchmark")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.sentencepiece_vocabulary(tokenizer("piece_bpe_32k.model")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", where=fold(F.col("doc_id"), 3) != 1)
    return classified(quality.score(docs, model), 3, 1)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, where=fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"A": "short", "B": "repetitive", "C": "capitals", "D": "symbols", "E": "copied"}
    return filter_audit.interactions(filter_audit.flagged(table(spark, sf_dir, "documents")), filters, table(spark, sf_dir, "labels"), {"good_lost": "quality", "toxic_lost": "toxic"})


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = lshforest.near_groups(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_ann, op3_urlfilter, op4_suffix_dedup, op5_packing, op6_simhash, op7_decontamination, op8_token_counts, op9_quality, op10_langid, op11_filter_audit, op12_lsh_forest, op13_fim)
    return {f.__name__: f for f in every}


URL_SQL = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT page_id, max_by(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost || rpath)) AS best
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM split LEFT JOIN hits USING (page_id)
"""


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(words) < 200)::INT
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), letters(i, x) AS (
  VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a JOIN letters b ON b.i <> a.i JOIN letters c ON c.i NOT IN (a.i, b.i) JOIN letters d ON d.i NOT IN (a.i, b.i, c.i) JOIN letters e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), steps AS (
  SELECT filter_order, step, (1 << o[step])::BIGINT AS bit, coalesce(list_sum([1 << x FOR x IN o[1:step - 1]]), 0)::BIGINT AS before
  FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), cells AS (
  SELECT part, failed::BIGINT AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), each AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN failed & before = 0 AND failed & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM each
"""

FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), draws AS (
  SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS r FROM d
), cuts AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_urlfilter": URL_SQL, "op11_filter_audit": AUDIT_SQL, "op13_fim": FIM_SQL}
