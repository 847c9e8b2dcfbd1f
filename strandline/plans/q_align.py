"""Queries of alignment and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, fusion, gaps, metrics, select
from ..sources import tables as T
from .common import fixed, rounded
from .q_gaps import ADJ, ONE, two_sided_sql

HOUR = 3_600_000_000


def shots(s, d):
    return T.marks(s, d, "error")


def chapters(s, d):
    return T.marks(s, d, "signup")


def aligned(s, d):
    return align.aligned(T.timed_units(s, d), chapters(s, d))


def refs(s, d):
    units = T.vectors(s, d)
    return T.references(units), select.top_k(fixed(gaps.gap_one_sided(units, 3)), 9).select("seq_id", "boundary"), T.sizes(units)


def spans(s, d):
    c = chapters(s, d)
    return c.select("seq_id", F.col("event_id").alias("span"), F.col("us").alias("s"), (F.col("us") + 24 * HOUR).alias("e"))


def signals(s, d):
    """Three signals of one sequence: adjacent, one-sided and overlapping gaps."""
    units = T.vectors(s, d)
    parts = {"adjacent": gaps.gap_adjacent(units), "one_sided": gaps.gap_one_sided(units, 3), "overlap": gaps.gap_overlapping(units, 2)}
    out = None
    for name, p in parts.items():
        p = fixed(p).select("seq_id", "boundary", F.lit(name).alias("signal"), "score")
        out = p if out is None else out.union(p)
    return out


def fused(mode, weights=None):
    return lambda s, d: rounded(fusion.fuse(signals(s, d), mode, weights))


def text_gap(s, d):
    return fixed(gaps.gap_one_sided(T.vectors(s, d), 3))


def nested(s, d):
    r, h, z = refs(s, d)
    return rounded(align.nested(metrics.segments(r, z), metrics.segments(h, z)))


def maps(s, d):
    """Score maps of two models that lack some boundaries, as candidate lists do."""
    units = T.two_models(s, d)
    one = select.top_k(fixed(gaps.gap_one_sided(units.select("seq_id", "pos", F.col("vec1").alias("vec")), 3)), 20)
    two = select.top_k(fixed(gaps.gap_one_sided(units.select("seq_id", "pos", F.col("vec2").alias("vec")), 3)), 20)
    return one, two


def prosody(s, d):
    """Timed units with stand-ins for pitch: the pause in hours, and two values of the position."""
    u = align.pauses(T.timed_units(s, d))
    gap = F.lead("start").over(gaps.in_order()) - F.col("start")
    u = T.timed_units(s, d).withColumn("h", F.coalesce(gap, F.lit(0)) / HOUR)
    return u.select("seq_id", "pos", F.col("h").alias("pause_after"), ((F.col("pos") * 37) % 11).cast("double").alias("mean_pitch"), ((F.col("pos") * 53) % 7).cast("double").alias("pitch_std"))


QUERIES = {
    **{f"align_{m}": (lambda m: lambda s, d: rounded(aligned(s, d).where(F.col("mode") == m).drop("mode")))(m) for m in align.MODES},
    "align_nearest_shot": lambda s, d: rounded(align.nearest(T.timed_units(s, d), shots(s, d))),
    "asof_backward": lambda s, d: rounded(align.asof_backward(T.timed_units(s, d), shots(s, d))),
    "align_contains": lambda s, d: rounded(align.assign_contained(T.timed_units(s, d), shots(s, d))),
    "assign_mean_max": lambda s, d: rounded(align.assign_mean(T.timed_units(s, d), shots(s, d))),
    "chapter_overlap": lambda s, d: rounded(align.overlapping(T.timed_units(s, d), spans(s, d), 6 * HOUR)),
    "band_semi": lambda s, d: rounded(align.within_band(refs(s, d)[1], refs(s, d)[0], 2)),
    "band_nearest": lambda s, d: rounded(align.nearest_within(refs(s, d)[1], refs(s, d)[0], 3)),
    "span_nesting": nested,
    "pauses": lambda s, d: rounded(align.pauses(T.timed_units(s, d).withColumn("end", F.least(F.col("end"), F.col("start") + HOUR)), HOUR)),
    "fusion_entropy": fused("entropy"),
    "fusion_uniform": fused("uniform"),
    "fusion_fixed": fused("fixed", {"adjacent": 0.5, "one_sided": 0.3, "overlap": 0.2}),
    "reliability_report": lambda s, d: rounded(fusion.reliability(signals(s, d))),
    "two_stage": lambda s, d: rounded(fusion.two_stage(text_gap(s, d), fixed(fusion.fuse(signals(s, d))), 0.5, 0.8)),
    "hierarchical_tree": lambda s, d: rounded(fusion.hierarchy(fixed(fusion.fuse(signals(s, d))), text_gap(s, d), 10)),
    "cross_mean": lambda s, d: rounded(select.top_k(fixed(fusion.mean_of_maps(list(maps(s, d)))), 8)),
    "cross_weighted": lambda s, d: rounded(select.top_k(fixed(fusion.mean_of_maps(list(maps(s, d)), [0.6, 0.4])), 8)),
    "cross_threshold": lambda s, d: rounded(select.relative_to_max(fixed(fusion.mean_of_maps(list(maps(s, d)))), 0.6, 2, 12)),
    "cross_borda": lambda s, d: rounded(select.top_k(fusion.borda(list(maps(s, d))), 8)),
    "shot_spikes": lambda s, d: rounded(fusion.spikes(align.assign_contained(T.timed_units(s, d), shots(s, d)).join(shots(s, d), ["seq_id", "event_id"]).select("seq_id", F.col("pos").alias("boundary"), F.col("value").alias("score")).where("boundary > 0"))),
    "prosody_fuse": lambda s, d: rounded(fusion.prosody_gap(prosody(s, d))),
    "prosody_rerank": lambda s, d: rounded(fusion.rerank(gaps.minmax(text_gap(s, d)), gaps.minmax(fixed(gaps.gap_adjacent(T.vectors(s, d)))).where("boundary % 4 <> 0"), 0.7)),
}

EV = T.with_("ev", "timed") + ", marks AS (SELECT * FROM ev WHERE event_type = '{kind}'), n AS (SELECT seq_id, count(*) AS n FROM timed GROUP BY seq_id)"
MODE_SQL = {
    "start_left": "count(*) FILTER (t.start < m.us)",
    "start_right": "count(*) FILTER (t.start <= m.us)",
    "start_nearest": "arg_min(t.pos, (abs(t.start - m.us), t.pos))",
    "center_left": "count(*) FILTER (t.start + t.fin < 2 * m.us)",
    "center_nearest": "arg_min(t.pos, (abs(t.start + t.fin - 2 * m.us), t.pos))",
    "contains_before": "coalesce(min(t.pos) FILTER (t.start <= m.us AND m.us <= t.fin), count(*) FILTER (t.start < m.us))",
    "contains_after": "coalesce(min(t.pos) FILTER (t.start <= m.us AND m.us <= t.fin) + 1, count(*) FILTER (t.start < m.us))",
}
ERRORS, SIGNUPS = EV.format(kind="error"), EV.format(kind="signup")
REFS = f"WITH {ONE}, {T.SQL['vectors']}, {T.SQL['refs']}, {T.SQL['sizes']}, hyp AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 9)"
CONTAIN = "SELECT m.seq_id, m.event_id, coalesce(min(t.pos) FILTER (t.start <= m.us AND m.us < t.fin), arg_min(t.pos, (abs(t.start + t.fin - 2 * m.us), t.pos)))::BIGINT AS pos FROM marks m JOIN timed t USING (seq_id) GROUP BY m.seq_id, m.event_id"
OVER = f"over AS ({two_sided_sql(-3, 1, -2, 2, '1 - list_cosine_similarity(a, b)')})"
SIGNALS = f"{ONE}, {ADJ}, {OVER}, sig AS (SELECT *, 'adjacent' AS signal FROM adj UNION ALL SELECT *, 'one_sided' FROM one UNION ALL SELECT *, 'overlap' FROM over)"
REL = """x AS (SELECT *, score - min(score) OVER (PARTITION BY seq_id, signal) AS x FROM sig), p1 AS (SELECT *, sum(x) OVER (PARTITION BY seq_id, signal) AS t FROM x),
p2 AS (SELECT *, (x / t + 1e-9) AS q FROM p1), p3 AS (SELECT *, q / sum(q) OVER (PARTITION BY seq_id, signal) AS p FROM p2),
h AS (SELECT seq_id, signal, CASE WHEN max(t) < 1e-9 THEN 1 ELSE -sum(p * log2(p)) / log2(count(*)) END AS entropy FROM p3 GROUP BY seq_id, signal)"""
WEIGHTS = {"entropy": "exp(-entropy)", "uniform": "1.0::DOUBLE", "fixed": "CASE signal WHEN 'adjacent' THEN 0.5 WHEN 'one_sided' THEN 0.3 ELSE 0.2 END::DOUBLE"}


def fuse_sql(mode: str) -> str:
    return f"""{SIGNALS}, {REL}, w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY seq_id) AS weight FROM (SELECT *, {WEIGHTS[mode]} AS raw FROM h)),
z AS (SELECT *, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) AS s FROM sig WINDOW q AS (PARTITION BY seq_id, signal)),
y AS (SELECT seq_id, boundary, sum(weight * s) AS s FROM z JOIN w USING (seq_id, signal) GROUP BY seq_id, boundary),
fused AS (SELECT seq_id, boundary, round((s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q), 6) + 0.0 AS score FROM y WINDOW q AS (PARTITION BY seq_id))"""


HALVES = ", ".join(
    f"""h{i} AS (SELECT vec_id // 50 AS seq_id, (vec_id % 50)::INT AS pos, embedding[{a}:{b}]::DOUBLE[] AS vec FROM embeddings),
g{i} AS (SELECT seq_id, pos, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM h{i}),
q{i} AS (SELECT seq_id, pos::BIGINT AS boundary, round(1 - list_cosine_similarity(list_transform(range(1, 33), lambda d: list_avg(list_transform(l, lambda v: v[d]))), list_transform(range(1, 33), lambda d: list_avg(list_transform(r, lambda v: v[d])))), 6) + 0.0 AS score FROM g{i} WHERE pos > 0),
m{i} AS (SELECT * FROM q{i} QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 20)"""
    for i, a, b in ((1, 1, 32), (2, 33, 64))
)


def mean_sql(w1: float, w2: float) -> str:
    n = lambda i: f"SELECT seq_id, boundary, score / CASE WHEN max(score) OVER (PARTITION BY seq_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY seq_id) END AS s FROM m{i}"
    return f"WITH {HALVES}, c AS (SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.boundary, b.boundary) AS boundary, round({w1} * coalesce(a.s, 0) + {w2} * coalesce(b.s, 0), 6) + 0.0 AS score FROM ({n(1)}) a FULL JOIN ({n(2)}) b ON a.seq_id = b.seq_id AND a.boundary = b.boundary)"


TOP8 = " SELECT seq_id, boundary, score FROM c QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 8"
MM = "CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE 0 END"

SQL = {
    **{f"align_{m}": f"{SIGNUPS}, a AS (SELECT m.seq_id, m.event_id, {e} AS i FROM marks m JOIN timed t USING (seq_id) GROUP BY m.seq_id, m.event_id, m.us) SELECT DISTINCT seq_id, greatest(1, least(i, n - 1))::BIGINT AS boundary FROM a JOIN n USING (seq_id) WHERE n > 1" for m, e in MODE_SQL.items()},
    "align_nearest_shot": f"{ERRORS} SELECT m.seq_id, m.event_id, arg_min(t.pos, (abs(t.start - m.us), t.pos))::BIGINT AS pos FROM marks m JOIN timed t USING (seq_id) GROUP BY m.seq_id, m.event_id",
    "asof_backward": f"{ERRORS} SELECT m.seq_id, m.event_id, t.pos::BIGINT AS pos FROM marks m ASOF LEFT JOIN timed t ON m.seq_id = t.seq_id AND m.us >= t.start",
    "align_contains": f"{ERRORS} {CONTAIN}",
    "assign_mean_max": f"""{ERRORS}, a AS ({CONTAIN}), g AS (SELECT seq_id, pos, count(*) AS n, avg(value) AS m, max(value) AS x FROM a JOIN marks USING (seq_id, event_id) GROUP BY seq_id, pos)
SELECT seq_id, t.pos::BIGINT AS pos, coalesce(g.n, 0) AS n_marks, round(coalesce(m, 0), 6) + 0.0 AS mean_value, round(greatest(0, coalesce(x, 0)), 6) + 0.0 AS max_value FROM timed t LEFT JOIN g USING (seq_id, pos)""",
    "chapter_overlap": f"{SIGNUPS} SELECT m.seq_id, m.event_id AS span, count(*) AS n_units, min(t.pos)::BIGINT AS first_pos, max(t.pos)::BIGINT AS last_pos FROM marks m JOIN timed t ON m.seq_id = t.seq_id AND t.fin > m.us AND t.start < m.us + 24 * {HOUR} GROUP BY m.seq_id, m.event_id",
    "band_semi": f"{REFS} SELECT seq_id, boundary FROM hyp h WHERE EXISTS (SELECT 1 FROM refs r WHERE r.seq_id = h.seq_id AND abs(r.boundary - h.boundary) <= 2)",
    "band_nearest": f"{REFS} SELECT h.seq_id, h.boundary, arg_min(r.boundary, (abs(r.boundary - h.boundary), r.boundary))::BIGINT AS nearest FROM hyp h LEFT JOIN refs r ON r.seq_id = h.seq_id AND abs(r.boundary - h.boundary) <= 3 GROUP BY h.seq_id, h.boundary",
    "span_nesting": f"""{REFS}, a AS (SELECT seq_id, row_number() OVER w - 1 AS ord, b, coalesce(lead(b) OVER w, n) AS e FROM (SELECT seq_id, boundary AS b FROM refs UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY b)),
o AS (SELECT seq_id, row_number() OVER w - 1 AS ord, b, coalesce(lead(b) OVER w, n) AS e FROM (SELECT seq_id, boundary AS b FROM hyp UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY b))
SELECT a.seq_id, a.ord AS "inner", o.ord AS "outer" FROM a JOIN o ON a.seq_id = o.seq_id AND o.b <= a.b AND a.e <= o.e""",
    "pauses": f"{T.with_('ev', 'timed')}, c AS (SELECT seq_id, pos, start, least(fin, start + {HOUR}) AS fin FROM timed), p AS (SELECT seq_id, pos::BIGINT AS pos, greatest(0, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY pos) - fin, 0)) AS pause FROM c) SELECT * FROM p WHERE pause >= {HOUR}",
    **{f"fusion_{m}": f"WITH {fuse_sql(m)} SELECT * FROM fused" for m in WEIGHTS},
    "reliability_report": f"WITH {SIGNALS}, {REL} SELECT seq_id, signal, round(entropy, 6) + 0.0 AS entropy, round(exp(-entropy), 6) + 0.0 AS raw, round(exp(-entropy) / sum(exp(-entropy)) OVER (PARTITION BY seq_id), 6) + 0.0 AS weight FROM h",
    "two_stage": f"WITH {fuse_sql('entropy')}, f AS (SELECT * FROM fused QUALIFY score > avg(score) OVER (PARTITION BY seq_id) + 0.8 * stddev_pop(score) OVER (PARTITION BY seq_id)), g AS (SELECT * FROM one QUALIFY score > avg(score) OVER (PARTITION BY seq_id) + 0.5 * stddev_pop(score) OVER (PARTITION BY seq_id)) SELECT f.* FROM f SEMI JOIN g USING (seq_id, boundary)",
    "hierarchical_tree": f"""WITH {fuse_sql("entropy")}, s AS (SELECT seq_id, boundary FROM fused QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 9),
t AS (SELECT s.*, row_number() OVER (PARTITION BY seq_id ORDER BY o.score DESC, boundary) AS r, count(*) OVER (PARTITION BY seq_id) AS n FROM s JOIN one o USING (seq_id, boundary))
SELECT seq_id, boundary, CASE WHEN r <= least(greatest(2, round_even(0.3 * (n + 1), 0)), n + 1) - 1 THEN 'chapter' ELSE 'subtopic' END AS level FROM t""",
    "cross_mean": mean_sql(0.5, 0.5) + TOP8,
    "cross_weighted": mean_sql(0.6, 0.4) + TOP8,
    "cross_threshold": mean_sql(0.5, 0.5) + ", r AS (SELECT *, max(score) OVER (PARTITION BY seq_id) AS m, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS r FROM c) SELECT seq_id, boundary, score FROM r WHERE r <= 2 OR (score >= 0.6 * m AND r <= 12)",
    "cross_borda": f"""WITH {HALVES}, r1 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS r, count(*) OVER (PARTITION BY seq_id) + 1 AS l FROM m1), r2 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS r, count(*) OVER (PARTITION BY seq_id) + 1 AS l FROM m2),
ls AS (SELECT seq_id, max(l) AS l1, max(l) AS l2 FROM (SELECT seq_id, l FROM r1 UNION ALL SELECT seq_id, l FROM r2) GROUP BY seq_id),
c AS (SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.boundary, b.boundary) AS boundary, -(coalesce(a.r, l1) + coalesce(b.r, l2))::DOUBLE AS score FROM r1 a FULL JOIN r2 b ON a.seq_id = b.seq_id AND a.boundary = b.boundary JOIN ls ON ls.seq_id = coalesce(a.seq_id, b.seq_id))""" + TOP8,
    "shot_spikes": f"""{ERRORS}, a AS ({CONTAIN}), g AS (SELECT seq_id, pos AS boundary, max(value) AS score FROM a JOIN marks USING (seq_id, event_id) WHERE pos > 0 GROUP BY seq_id, pos),
k AS (SELECT seq_id, boundary, 0.054 * coalesce(lag(score, 2) OVER w, 0) + 0.242 * coalesce(lag(score, 1) OVER w, 0) + 0.399 * score + 0.242 * coalesce(lead(score, 1) OVER w, 0) + 0.054 * coalesce(lead(score, 2) OVER w, 0) AS score FROM g WINDOW w AS (PARTITION BY seq_id ORDER BY boundary))
SELECT seq_id, boundary, round({MM.format(c="score")}, 6) + 0.0 AS score FROM k WINDOW q AS (PARTITION BY seq_id)""",
    "prosody_fuse": f"""{T.with_("ev", "timed")}, u AS (SELECT seq_id, pos, coalesce(lead(start) OVER w - start, 0) / {HOUR} AS h, ((pos * 37) % 11)::DOUBLE AS mp, ((pos * 53) % 7)::DOUBLE AS ps FROM timed WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
r AS (SELECT seq_id, pos + 1 AS boundary, h AS a, CASE WHEN mp > 1e-3 THEN abs(lead(mp) OVER w - mp) / mp ELSE 1 END AS b, (ps + lead(ps) OVER w) / 2 AS c, lead(pos) OVER w AS nx FROM u WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
z AS (SELECT seq_id, boundary, {MM.format(c="a")} AS a, {MM.format(c="b")} AS b, {MM.format(c="c")} AS c FROM r WHERE nx IS NOT NULL WINDOW q AS (PARTITION BY seq_id))
SELECT seq_id, boundary::BIGINT AS boundary, round(0.5 * a + 0.3 * c + 0.2 * b, 6) + 0.0 AS score FROM z""",
    "prosody_rerank": f"""WITH {ONE}, {ADJ}, a AS (SELECT seq_id, boundary, {MM.format(c="score")} AS s FROM one WINDOW q AS (PARTITION BY seq_id)), b AS (SELECT seq_id, boundary, {MM.format(c="score")} AS s FROM adj WINDOW q AS (PARTITION BY seq_id))
SELECT a.seq_id, a.boundary, round(CASE WHEN b.s IS NULL THEN a.s ELSE 0.7 * a.s + 0.3 * b.s END, 6) + 0.0 AS score FROM a LEFT JOIN (SELECT * FROM b WHERE boundary % 4 <> 0) b USING (seq_id, boundary)""",
}
