"""Queries of smoothing, gap scores and choice of boundaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import gaps, select
from ..sources import tables as T
from .common import fixed, rounded

W = 3


def mean_sql(rows: str, dim: int = 64) -> str:
    return f"list_transform(range(1, {dim + 1}), lambda d: list_avg(list_transform({rows}, lambda v: v[d])))"


def frame_sql(a: int, b: int, col: str = "vec") -> str:
    side = lambda x: f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING" if x else "CURRENT ROW"
    return f"list({col}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN {side(a)} AND {side(b)})"


def two_sided_sql(a1: int, b1: int, a2: int, b2: int, score: str, name: str = "score", more: str = "") -> str:
    return f"""{T.with_("vectors")}, f AS (SELECT seq_id, pos, {frame_sql(a1, b1)} AS l, {frame_sql(a2, b2)} AS r FROM vectors),
m AS (SELECT seq_id, pos, {mean_sql("l")} AS a, {mean_sql("r")} AS b FROM f WHERE pos > 0){more}
SELECT seq_id, pos::BIGINT AS boundary, round({score}, 6) + 0.0 AS {name} FROM m"""


def lengths_and_sum(df):
    """A smoothed vector as numbers to compare: its first components and its sum."""
    return rounded(df.select("seq_id", "pos", F.col("vec")[0].alias("v0"), F.col("vec")[63].alias("v63"), V.total(F.col("vec")).alias("total")))


def one_sided(s, d):
    return fixed(gaps.gap_one_sided(T.vectors(s, d), W))


def cross_block(s, d):
    return fixed(gaps.gap_cross_block(T.vectors(s, d), W), "similarity")


QUERIES = {
    "gap_adjacent": lambda s, d: rounded(gaps.gap_adjacent(T.vectors(s, d))),
    "gap_window_overlap": lambda s, d: rounded(gaps.gap_overlapping(T.vectors(s, d), W)),
    "gap_window_onesided": lambda s, d: rounded(gaps.gap_one_sided(T.vectors(s, d), W)),
    "gap_crossblock": lambda s, d: rounded(gaps.gap_cross_block(T.vectors(s, d), W)),
    "gap_recency": lambda s, d: rounded(gaps.gap_recency(T.vectors(s, d), 7)),
    "smooth_uniform": lambda s, d: lengths_and_sum(gaps.smooth(T.vectors(s, d), 8)),
    "smooth_gaussian": lambda s, d: lengths_and_sum(gaps.smooth_gaussian(T.vectors(s, d), 9, 2.0)),
    "chunk_mean": lambda s, d: lengths_and_sum(gaps.chunk_means(T.vectors(s, d), 5)),
    "chunk_to_units": lambda s, d: rounded(gaps.chunk_to_units(gaps.label_changes(gaps.chunk_means(T.vectors(s, d), 5).withColumn("label", F.col("pos") % 3)), T.sizes(T.vectors(s, d)), 5)),
    "block_text": lambda s, d: rounded(gaps.block_text(T.turns(s, d), 3).select("seq_id", "pos", "text")),
    "chunk_plan": lambda s, d: rounded(gaps.chunk_plan(T.text_units(s, d).groupBy("seq_id").agg(F.count("*").cast("int").alias("n")))),
    "label_changes": lambda s, d: rounded(gaps.label_changes(T.vectors(s, d))),
    "depth_global": lambda s, d: rounded(gaps.depth_global(cross_block(s, d))),
    "local_maxima": lambda s, d: rounded(gaps.local_maxima(one_sided(s, d))),
    "moving_average3": lambda s, d: rounded(gaps.moving_average(one_sided(s, d))),
    "kernel5_smooth": lambda s, d: rounded(gaps.kernel_smooth(one_sided(s, d))),
    "gaussian_filter": lambda s, d: rounded(gaps.gaussian_filter(one_sided(s, d))),
    "minmax_norm": lambda s, d: rounded(gaps.minmax(one_sided(s, d))),
    "select_topk": lambda s, d: rounded(select.top_k(one_sided(s, d), 9)),
    "select_bottomk": lambda s, d: rounded(select.top_k(cross_block(s, d), 9, "similarity", largest=False)),
    "select_meanstd": lambda s, d: rounded(select.mean_std(one_sided(s, d), 1.0)),
    "select_below": lambda s, d: rounded(select.below(one_sided(s, d), 0.9)),
    "select_relmax": lambda s, d: rounded(select.relative_to_max(one_sided(s, d), 0.9, 3, 12)),
    "adaptive_k": lambda s, d: rounded(select.adaptive_share(one_sided(s, d))),
    "oversample_rerank": lambda s, d: rounded(select.oversample(one_sided(s, d), 5, 3, fixed(gaps.gap_adjacent(T.vectors(s, d))))),
    "elbow_k": lambda s, d: rounded(select.elbow(one_sided(s, d))),
}

ONE = f"one AS ({two_sided_sql(-W, -1, 0, W - 1, '1 - list_cosine_similarity(a, b)').replace('WITH ', 'WITH ', 1)})"
CROSS = f"crossed AS ({two_sided_sql(-W, -1, 0, W - 1, 'list_dot_product(a, b)', 'similarity')})"
ADJ = f"adj AS ({T.with_('vectors')} SELECT seq_id, pos::BIGINT AS boundary, round(1 - list_cosine_similarity(lag(vec) OVER (PARTITION BY seq_id ORDER BY pos), vec), 6) + 0.0 AS score FROM vectors QUALIFY pos > 0)"
G = "PARTITION BY seq_id ORDER BY boundary"


def vec_sql(rows: str) -> str:
    return f"SELECT seq_id, pos::BIGINT AS pos, round(v[1], 6) + 0.0 AS v0, round(v[64], 6) + 0.0 AS v63, round(list_sum(v), 6) + 0.0 AS total FROM ({rows})"


UNIT = "list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))"
NEAR = [i for i in range(-6, 7)]

SQL = {
    "gap_adjacent": f"WITH {ADJ} SELECT * FROM adj",
    "gap_window_overlap": two_sided_sql(-1 - W, -1 + W, -W, W, "1 - list_cosine_similarity(a, b)"),
    "gap_window_onesided": f"WITH {ONE} SELECT * FROM one",
    "gap_crossblock": f"WITH {CROSS} SELECT * FROM crossed",
    "gap_recency": f"""{T.with_("vectors")}, f AS (SELECT seq_id, pos, {frame_sql(-4, -1)} AS l, {frame_sql(0, 3)} AS r FROM vectors),
m AS (SELECT seq_id, pos, list_transform(range(1, 65), lambda d: list_sum(list_transform(l, lambda v, i: v[d] * exp(-0.5 * (len(l) - i))))) AS a,
  list_transform(range(1, 65), lambda d: list_sum(list_transform(r, lambda v, i: v[d] * exp(-0.5 * (i - 1))))) AS b FROM f WHERE pos > 0)
SELECT seq_id, pos::BIGINT AS boundary, round(1 - list_cosine_similarity(a, b), 6) + 0.0 AS score FROM m""",
    "smooth_uniform": f"{T.with_('vectors')}, f AS (SELECT seq_id, pos, {mean_sql(frame_sql(-4, 4))} AS m FROM vectors) " + vec_sql(f"SELECT seq_id, pos, {UNIT} AS v FROM f"),
    "smooth_gaussian": f"""{T.with_("vectors")}, f AS (SELECT seq_id, pos, {frame_sql(-4, 4)} AS r, least(pos, 4) AS before FROM vectors),
g AS (SELECT seq_id, pos, list_transform(range(1, 65), lambda d: list_sum(list_transform(r, lambda v, i: v[d] * exp(-0.5 * pow((i - 1 - before) / 2.0, 2))))) AS m FROM f) """ + vec_sql(f"SELECT seq_id, pos, {UNIT} AS v FROM g"),
    "chunk_mean": f"{T.with_('vectors')}, f AS (SELECT seq_id, pos // 5 AS pos, list(vec ORDER BY pos) AS r FROM vectors GROUP BY seq_id, pos // 5) " + vec_sql(f"SELECT seq_id, pos, {mean_sql('r')} AS v FROM f"),
    "chunk_to_units": f"""{T.with_("vectors", "sizes")}, c AS (SELECT DISTINCT seq_id, pos // 5 AS chunk FROM vectors)
SELECT DISTINCT seq_id, greatest(1, least(chunk * 5, n - 1))::BIGINT AS boundary FROM c JOIN sizes USING (seq_id) WHERE chunk > 0""",
    "block_text": f"{T.with_('turns')} SELECT seq_id, pos::BIGINT AS pos, string_agg(text, ' ') OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS text FROM turns",
    "chunk_plan": f"""{T.with_("units")}, z AS (SELECT seq_id, count(*) AS n FROM units GROUP BY seq_id), c AS (SELECT seq_id, n, unnest(range(0, greatest(0, n - 16) + 1, 65)) AS start FROM z)
SELECT seq_id, start // 65 AS chunk, start, least(start + 80, n) AS "end" FROM c""",
    "label_changes": f"{T.with_('vectors')} SELECT seq_id, pos::BIGINT AS boundary FROM (SELECT *, lag(label) OVER (PARTITION BY seq_id ORDER BY pos) AS p FROM vectors) WHERE pos > 0 AND p <> label",
    "depth_global": f"WITH {CROSS} SELECT seq_id, boundary, round(max(similarity) OVER ({G} ROWS UNBOUNDED PRECEDING) + max(similarity) OVER ({G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * similarity, 6) + 0.0 AS score FROM crossed",
    "local_maxima": f"WITH {ONE} SELECT seq_id, boundary, score, score > 0 AND coalesce(score >= lag(score) OVER ({G}), false) AND coalesce(score > lead(score) OVER ({G}), false) AS is_peak FROM one",
    "moving_average3": f"WITH {ONE} SELECT seq_id, boundary, round(coalesce((lag(score) OVER ({G}) + score + lead(score) OVER ({G})) / 3, score), 6) + 0.0 AS score FROM one",
    "kernel5_smooth": f"WITH {ONE} SELECT seq_id, boundary, round(0.054 * coalesce(lag(score, 2) OVER ({G}), 0) + 0.242 * coalesce(lag(score, 1) OVER ({G}), 0) + 0.399 * score + 0.242 * coalesce(lead(score, 1) OVER ({G}), 0) + 0.054 * coalesce(lead(score, 2) OVER ({G}), 0), 6) + 0.0 AS score FROM one",
    "gaussian_filter": f"""WITH {ONE}, s AS (SELECT seq_id, list(score ORDER BY boundary) AS s, list(boundary ORDER BY boundary) AS b, count(*) AS n FROM one GROUP BY seq_id),
k AS (SELECT list(exp(-0.5 * pow(d / 1.5, 2)) ORDER BY d) AS k, sum(exp(-0.5 * pow(d / 1.5, 2))) AS t FROM range(-6, 7) r(d)),
e AS (SELECT seq_id, b[i] AS boundary, list_sum(list_transform(range(-6, 7), lambda d: k[d + 7] / t * s[CASE WHEN ((i - 1 + d) % (2 * n) + 2 * n) % (2 * n) < n THEN ((i - 1 + d) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((i - 1 + d) % (2 * n) + 2 * n) % (2 * n) END + 1])) AS score
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM s), k)
SELECT seq_id, boundary, round(score, 6) + 0.0 AS score FROM e""",
    "minmax_norm": f"WITH {ONE} SELECT seq_id, boundary, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0 END, 6) + 0.0 AS score FROM one WINDOW p AS (PARTITION BY seq_id)",
    "select_topk": f"WITH {ONE} SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 9",
    "select_bottomk": f"WITH {CROSS} SELECT * FROM crossed QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY similarity, boundary) <= 9",
    "select_meanstd": f"WITH {ONE} SELECT * FROM one QUALIFY score > avg(score) OVER (PARTITION BY seq_id) + stddev_pop(score) OVER (PARTITION BY seq_id)",
    "select_below": f"WITH {ONE} SELECT * FROM one WHERE score < 0.9",
    "select_relmax": f"WITH {ONE}, r AS (SELECT *, max(score) OVER (PARTITION BY seq_id) AS m, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS r FROM one) SELECT seq_id, boundary, score FROM r WHERE r <= 3 OR (score >= 0.9 * m AND r <= 12)",
    "adaptive_k": f"WITH {ONE}, c AS (SELECT seq_id, stddev_pop(score) / (avg(score) + 1e-8) AS cv FROM one GROUP BY seq_id) SELECT seq_id, round(cv, 6) + 0.0 AS cv, CASE WHEN cv < 0.4 THEN 0.6::DOUBLE WHEN cv > 0.65 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS share FROM c",
    "oversample_rerank": f"WITH {ONE}, {ADJ}, f AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 15) SELECT seq_id, boundary, score FROM f JOIN adj USING (seq_id, boundary) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 5",
    "elbow_k": f"WITH {ONE}, s AS (SELECT seq_id, row_number() OVER w AS i, lead(score) OVER w - 2 * score + lag(score) OVER w AS d FROM one WINDOW w AS (PARTITION BY seq_id ORDER BY score DESC, boundary)) SELECT seq_id, (arg_min(i, (d, i)) + 1)::BIGINT AS k FROM s WHERE d IS NOT NULL GROUP BY seq_id",
}
