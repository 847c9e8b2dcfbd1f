"""Queries of the segmenters, the method registry and the evaluation battery. Sequential algorithms have no SQL: tests hold them against brute force."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import gaps, grouped, metrics, select, text
from ..operators import segmenters as S
from ..sources import tables as T
from . import combinations, registry, sql_splits
from .battery import battery
from .common import fixed, rounded
from .q_gaps import frame_sql, mean_sql


def units(s, d):
    return T.two_models(s, d)


def wanted(s, d):
    """As many segments as the reference has."""
    v = T.vectors(s, d)
    n = T.references(v).groupBy("seq_id").agg((F.count("*") + 1).cast("int").alias("k"))
    return T.sizes(v).join(n, "seq_id", "left").select("seq_id", F.coalesce("k", F.lit(1)).alias("k"))


def method(*names):
    return lambda s, d: rounded(combinations.run_methods(units(s, d), wanted(s, d), list(names)))


def single(f):
    return lambda s, d: rounded(grouped.per_sequence(T.vectors(s, d), f))


def documents(s, d):
    """Text units with hashed vectors and tokens, for segmenters of the first model alone: a constant stands in for the second. Who doesn't look at tokens drops them, and they aren't made."""
    v = text.hashed_vectors(text.tokens(T.text_units(s, d)), along=("tokens",))
    return v.select("seq_id", "pos", F.col("vec").alias("vec1"), F.array(F.lit(1.0)).alias("vec2"), "tokens")


def by_root(n: int) -> int:
    """The segments that `heuristics` asks for, of a number of units."""
    return max(2, round(math.sqrt(n) / 3))


def worded(s, d):
    """The same for segmenters that look at tokens alone: vectors would be made for nothing, so a constant stands in."""
    t = text.tokens(T.text_units(s, d))
    return t.select("seq_id", "pos", *(F.array(F.lit(1.0)).alias(v) for v in ("vec1", "vec2")), "tokens")


def heuristics(s, d):
    n = T.text_units(s, d).groupBy("seq_id").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(2), F.bround(F.sqrt("n") / 3).cast("int"))
    return n.select("seq_id", k.alias("k"))


def segment_matches(s, d):
    v = T.vectors(s, d)
    z = T.sizes(v)
    hyp = select.top_k(fixed(gaps.gap_one_sided(v, 3)), 9).select("seq_id", "boundary")
    return rounded(grouped.segment_f1(metrics.segments(hyp, z), metrics.segments(T.references(v), z)))


def catalogue(s, d):
    """The registry as a table."""
    rows = [(n, m.family, m.window, m.frac, m.fewer, m.min_seg) for n in registry.names() for m in [registry.parse(n)]]
    return rounded(s.createDataFrame(rows, "method string, family string, window int, frac double, fewer int, min_seg int"))


GAP_SCORES = lambda s, d: fixed(gaps.gap_one_sided(T.vectors(s, d), 3))

QUERIES = {
    "divisive": method("divisive"),
    "divisive_constrained": single(lambda v: S.divisive(v, 8, 5)),
    "treeseg": method("treeseg"),
    "dp_optimal": method("dp"),
    "depth_embeddings": method("depth"),
    "cosine_seg": method("cosine"),
    "bert_style": method("bert_seg"),
    "cosine_drop": method("cosine_drop"),
    "ensemble": method("ensemble"),
    "recency": method("recency", "divisive_recency"),
    "kmeans_seg": method("kmeans"),
    "chunked": method("divisive_chunked", "two_stage_chunked"),
    "conservative_frac": method("divisive_conservative", "divisive_smooth9_frac70", "divisive_smooth9_consv3"),
    "k_selection": method("divisive_bic", "divisive_elbow", "cross_e5_gapvar"),
    "cross_model": method("cross_model_e5large", "cross_e5_frac75", "cross_e5_nms10", "cross_e5_thresh60"),
    "concat_space": method("concat_e5_frac70"),
    "triple_model": method("triple_model", "multi_res_cross_e5"),
    "combined_depth": method("cross_e5_combined_depth"),
    "iterative": method("iterative_cross_e5", "iterative_v2_frac75", "iterative_fw_e5base", "contrastive_e5base"),
    "constrained_vote": method("cross_e5_constrained_minlen10"),
    "method_registry": lambda s, d: rounded(combinations.run_methods(units(s, d), wanted(s, d), registry.names())),
    "method_catalogue": catalogue,
    "c99_lite": lambda s, d: rounded(grouped.run_methods(worded(s, d), heuristics(s, d), ["c99"])),
    "texttiling": lambda s, d: rounded(grouped.run_methods(worded(s, d), heuristics(s, d), ["texttiling"])),
    "document_divisive": lambda s, d: rounded(grouped.run_methods(documents(s, d).drop("tokens"), by_root, ["divisive_smooth9"])),
    "dp_select": lambda s, d: rounded(grouped.dp_select(select.top_k(GAP_SCORES(s, d), 24), T.sizes(T.vectors(s, d)), 6)),
    "segment_f1": segment_matches,
    "evaluation_battery": battery,
}

def halves_sql(a1: int, b1: int, a2: int, b2: int) -> str:
    """The first model's vectors, the means of two frames around each boundary, and the boundaries asked for."""
    return f"""WITH {T.SQL["vectors"]}, {T.SQL["refs"]}, kk AS (SELECT seq_id, count(*) AS k FROM refs GROUP BY seq_id),
v AS (SELECT seq_id, pos, vec[1:32] AS vec FROM vectors), f AS (SELECT seq_id, pos, {frame_sql(a1, b1)} AS l, {frame_sql(a2, b2)} AS r FROM v),
m AS (SELECT seq_id, pos, {mean_sql("l", 32)} AS a, {mean_sql("r", 32)} AS b FROM f WHERE pos > 0)"""


def depth_sql(name: str, w: int) -> str:
    return f"""{halves_sql(-1 - w, -1 + w, -w, w)}, s AS (SELECT seq_id, pos, list_cosine_similarity(a, b) AS s FROM m),
d AS (SELECT seq_id, pos, max(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + max(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * s AS d FROM s)
SELECT seq_id, '{name}' AS method, pos::BIGINT AS boundary FROM d JOIN kk USING (seq_id) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY d DESC, pos) <= k"""


SQL: dict[str, str] = {
    "cosine_seg": depth_sql("cosine", 3),
    "bert_style": depth_sql("bert_seg", 5),
    "cosine_drop": f"{halves_sql(-3, -1, 0, 2)} SELECT seq_id, 'cosine_drop' AS method, pos::BIGINT AS boundary FROM m JOIN kk USING (seq_id) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY list_dot_product(a, b), pos) <= k",
}
SQL |= sql_splits.SQL
