"""Queries of segmentation metrics and greedy selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, gaps, metrics, select
from ..sources import tables as T
from .common import fixed, rounded
from .q_gaps import ADJ, ONE


def inputs(s, d):
    """Hypotheses are the nine best gaps, references the labelled units."""
    units = T.vectors(s, d)
    scores = fixed(gaps.gap_one_sided(units, 3))
    return select.top_k(scores, 9).select("seq_id", "boundary"), T.references(units), T.sizes(units)


def metric(f):
    return lambda s, d: rounded(f(*inputs(s, d)))


def scored(s, d):
    units = T.vectors(s, d)
    return fixed(gaps.gap_one_sided(units, 3)), T.sizes(units)


def hwd(hyp, ref, sizes):
    """Chapters are every other boundary, subtopics all."""
    even = lambda x: x.where("boundary % 2 = 0")
    return metrics.hierarchical_wd(metrics.pk_wd(even(hyp), even(ref), sizes), metrics.pk_wd(hyp, ref, sizes))


def shifted(s, d):
    units = T.vectors(s, d)
    similar = fixed(gaps.gap_adjacent(units)).select("seq_id", "boundary", F.round(1 - F.col("score"), 6).alias("similarity"))
    return rounded(folds.local_shift(inputs(s, d)[0], similar))


def dense(s, d):
    """Sixteen boundaries and their scores, close enough for the minimum length to matter."""
    scores, sizes = scored(s, d)
    return select.top_k(scores, 16), sizes


QUERIES = {
    "pk_wd": metric(metrics.pk_wd),
    "boundary_similarity": metric(metrics.boundary_similarity),
    "tolerance_f1": metric(metrics.tolerance_f1),
    "h_wd": metric(hwd),
    "error_taxonomy": metric(metrics.error_taxonomy),
    "error_summary": metric(lambda h, r, z: metrics.taxonomy_summary(metrics.error_taxonomy(h, r, z))),
    "kappa_asym": metric(metrics.kappa_asym),
    "tiou_best": metric(metrics.best_overlap),
    "length_audit": metric(lambda h, r, z: metrics.length_audit(h, z)),
    "evaluate_bundle": metric(metrics.evaluate),
    "nms": lambda s, d: rounded(folds.nms(scored(s, d)[0])),
    "min_segment_length": lambda s, d: rounded(folds.min_segment_length(*scored(s, d), 6)),
    "postprocess": lambda s, d: rounded(folds.postprocess(*scored(s, d), 4, 6)),
    "select_boundaries": lambda s, d: rounded(folds.select_boundaries(*scored(s, d), 6)),
    "spaced_top": lambda s, d: rounded(folds.spaced_top(scored(s, d)[0], 7, 4)),
    "pick_spaced": lambda s, d: rounded(folds.pick_spaced(*scored(s, d), 7, 4)),
    "min_segment_filter": lambda s, d: rounded(folds.min_segment_filter(dense(s, d)[0].select("seq_id", "boundary"), dense(s, d)[1], 4)),
    "score_aware_min_segment": lambda s, d: rounded(folds.min_segment_filter(dense(s, d)[0].select("seq_id", "boundary"), dense(s, d)[1], 4, dense(s, d)[0])),
    "local_shift": shifted,
    "sustained_changes": lambda s, d: rounded(folds.sustained(gaps.label_changes(T.vectors(s, d)))),
    "between_anchors": lambda s, d: rounded(folds.between_anchors(T.references(T.vectors(s, d)).where("boundary % 5 = 0"), scored(s, d)[0], 6, 3)),
}

BASE = f"""WITH {ONE}, {T.SQL["vectors"]}, {T.SQL["refs"]}, {T.SQL["sizes"]},
hyp AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 9)"""


def counted(hyp: str = "hyp", ref: str = "refs", name: str = "") -> str:
    return f"""k{name} AS (SELECT seq_id, n, greatest(1, round_even(n / (count(boundary) + 1) / 2.0, 0))::INT AS k FROM sizes LEFT JOIN {ref} USING (seq_id) GROUP BY seq_id, n),
c{name} AS (SELECT seq_id, k, n, p, (SELECT count(*) FROM {hyp} h WHERE h.seq_id = x.seq_id AND h.boundary <= p) AS ch, (SELECT count(*) FROM {ref} r WHERE r.seq_id = x.seq_id AND r.boundary <= p) AS cr
  FROM (SELECT seq_id, k, n, unnest(range(0, n)) AS p FROM k{name}) x),
m{name} AS (SELECT a.seq_id, any_value(a.k)::BIGINT AS k, coalesce(avg(CASE WHEN b.p IS NULL THEN NULL WHEN (b.ch > a.ch) <> (b.cr > a.cr) THEN 1.0 ELSE 0.0 END), 0) AS pk,
  coalesce(avg(CASE WHEN b.p IS NULL THEN NULL WHEN b.ch - a.ch <> b.cr - a.cr THEN 1.0 ELSE 0.0 END), 0) AS wd
  FROM c{name} a LEFT JOIN c{name} b ON a.seq_id = b.seq_id AND b.p = a.p + a.k GROUP BY a.seq_id)"""


LISTS = """l AS (SELECT seq_id, n, coalesce((SELECT list(boundary::INT ORDER BY boundary) FROM hyp h WHERE h.seq_id = z.seq_id), []::INT[]) AS h,
  coalesce((SELECT list(boundary::INT ORDER BY boundary) FROM refs r WHERE r.seq_id = z.seq_id), []::INT[]) AS r FROM sizes z)"""


def f1_sql(t: int, name: str) -> str:
    fold = f"list_reduce(list_transform(h, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(r, lambda y: abs(y - x[1]) <= {t} AND NOT list_contains(acc, y))) > 0 THEN list_append(acc, list_filter(r, lambda y: abs(y - x[1]) <= {t} AND NOT list_contains(acc, y))[1]) ELSE acc END, []::INT[])"
    return f"""t{name} AS (SELECT seq_id, len({fold}) AS tp, len(h) AS nh, len(r) AS nr FROM l),
f{name} AS (SELECT seq_id, tp, CASE WHEN nh = 0 AND nr = 0 THEN 1.0 WHEN nh = 0 OR nr = 0 THEN 0.0 ELSE tp::DOUBLE / nh END AS p, CASE WHEN nh = 0 AND nr = 0 THEN 1.0 WHEN nh = 0 OR nr = 0 THEN 0.0 ELSE tp::DOUBLE / nr END AS r FROM t{name})"""


BS = """d AS (SELECT seq_id, (SELECT avg(s) FROM (SELECT coalesce(max(1 - abs(r.boundary - h.boundary) / 3.0), 0) AS s FROM hyp h LEFT JOIN refs r ON r.seq_id = h.seq_id AND abs(r.boundary - h.boundary) <= 2 WHERE h.seq_id = z.seq_id GROUP BY h.boundary)) AS a,
  (SELECT avg(s) FROM (SELECT coalesce(max(1 - abs(r.boundary - h.boundary) / 3.0), 0) AS s FROM refs h LEFT JOIN hyp r ON r.seq_id = h.seq_id AND abs(r.boundary - h.boundary) <= 2 WHERE h.seq_id = z.seq_id GROUP BY h.boundary)) AS b FROM sizes z),
bs AS (SELECT seq_id, CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL OR b IS NULL THEN 0 ELSE (a + b) / 2 END::DOUBLE AS bs FROM d)"""

# Error taxonomy: the state is one list of triples' worth of integers: near misses, wrong ones, right ones, then the marked references.
ERR = f"""e AS (SELECT seq_id, len(h) AS nh, len(r) AS nr, list_reduce(list_transform(h, lambda x: [x]), lambda acc, x:
  CASE WHEN list_contains(r, x[1]) THEN list_concat([acc[1], acc[2], acc[3] + 1], CASE WHEN list_contains(acc[4:], x[1]) THEN acc[4:] ELSE list_append(acc[4:], x[1]) END)
       WHEN len(list_filter(r, lambda y: abs(y - x[1]) <= 2 AND NOT list_contains(acc[4:], y))) > 0
         THEN list_concat([acc[1] + 1, acc[2], acc[3] + 1], list_append(acc[4:], list_sort(list_transform(list_filter(r, lambda y: abs(y - x[1]) <= 2 AND NOT list_contains(acc[4:], y)), lambda y: abs(y - x[1]) * 1000000 + y))[1] % 1000000))
       ELSE list_concat([acc[1], acc[2] + 1, acc[3]], acc[4:]) END, [0, 0, 0]::INT[]) AS s FROM l),
errors AS (SELECT seq_id, s[3]::BIGINT AS tp, s[1]::BIGINT AS near, s[2]::BIGINT AS fp, (nr - (len(s) - 3))::BIGINT AS fn, nh > 1.5 * nr AS over, nh < 0.5 * nr AS under FROM e)"""


def ranked_sql(where: str = "") -> str:
    return f"WITH {ONE}, {T.SQL['vectors']}, {T.SQL['sizes']}, o AS (SELECT seq_id, list(boundary::INT ORDER BY score DESC, boundary) AS b FROM one JOIN sizes USING (seq_id) {where} GROUP BY seq_id)"


def fold_sql(ok: str, where: str = "") -> str:
    return f"""{ranked_sql(where)}, k AS (SELECT seq_id, n, list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN {ok} THEN list_append(acc, x[1]) ELSE acc END, []::INT[]) AS kept FROM o JOIN sizes USING (seq_id))
SELECT seq_id, unnest(kept)::BIGINT AS boundary FROM k"""


def far(window: int, inclusive: bool = True, acc: str = "acc") -> str:
    return f"len(list_filter({acc}, lambda y: abs(y - x[1]) <{'=' if inclusive else ''} {window})) = 0"


SQL = {
    "pk_wd": f"{BASE}, {counted()} SELECT seq_id, k, round(pk, 6) + 0.0 AS pk, round(wd, 6) + 0.0 AS wd FROM m",
    "h_wd": f"""{BASE}, h2 AS (SELECT * FROM hyp WHERE boundary % 2 = 0), r2 AS (SELECT * FROM refs WHERE boundary % 2 = 0), {counted()}, {counted("h2", "r2", "2")}
SELECT seq_id, round(0.5 * m2.wd + 0.5 * m.wd, 6) + 0.0 AS h_wd FROM m JOIN m2 USING (seq_id)""",
    "boundary_similarity": f"{BASE}, {BS} SELECT seq_id, round(bs, 6) + 0.0 AS bs FROM bs",
    "tolerance_f1": f"{BASE}, {LISTS}, {f1_sql(2, '2')} SELECT seq_id, tp::BIGINT AS tp, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1 FROM f2",
    "error_taxonomy": f"{BASE}, {LISTS}, {ERR} SELECT * FROM errors",
    "error_summary": f"""{BASE}, {LISTS}, {ERR}, q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM errors),
t AS (SELECT sum(tp) / (sum(tp) + sum(fp)) AS a, sum(tp) / (sum(tp) + sum(fn)) AS b, avg(p) AS c, avg(r) AS d, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS e, count(*) FILTER (over) AS o, count(*) FILTER (under) AS u FROM q)
SELECT round(a, 6) + 0.0 AS micro_precision, round(b, 6) + 0.0 AS micro_recall, round(c, 6) + 0.0 AS macro_precision, round(d, 6) + 0.0 AS macro_recall, round(e, 6) + 0.0 AS macro_f1, o::BIGINT AS n_over, u::BIGINT AS n_under, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) + 0.0 AS micro_f1 FROM t""",
    "kappa_asym": f"""{BASE}, u AS (SELECT seq_id, n, unnest(range(0, n)) AS p FROM sizes), x AS (SELECT seq_id, p, (EXISTS (SELECT 1 FROM hyp h WHERE h.seq_id = u.seq_id AND h.boundary = p))::INT AS a, (EXISTS (SELECT 1 FROM refs r WHERE r.seq_id = u.seq_id AND abs(r.boundary - p) <= 1))::INT AS b FROM u),
g AS (SELECT seq_id, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM x GROUP BY seq_id) SELECT seq_id, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) + 0.0 AS kappa FROM g""",
    "tiou_best": f"""{BASE}, p AS (SELECT seq_id, start, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY start), n) AS fin FROM (SELECT seq_id, boundary AS start FROM hyp UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id)),
q AS (SELECT seq_id, start, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY start), n) AS fin FROM (SELECT seq_id, boundary AS start FROM refs UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id)),
i AS (SELECT p.seq_id, p.start, max(greatest(0, least(p.fin, q.fin) - greatest(p.start, q.start)) / (greatest(p.fin, q.fin) - least(p.start, q.start))) AS best FROM p JOIN q USING (seq_id) GROUP BY p.seq_id, p.start)
SELECT seq_id, round(avg(best), 6) + 0.0 AS mean_iou FROM i GROUP BY seq_id""",
    "length_audit": f"""{BASE}, p AS (SELECT seq_id, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY start), n) - start AS len FROM (SELECT seq_id, boundary AS start FROM hyp UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id))
SELECT seq_id, count(*) AS n_segments, min(len)::BIGINT AS shortest, max(len)::BIGINT AS longest, round(avg(len), 6) + 0.0 AS mean_length, count(*) FILTER (len < 5) AS n_short FROM p GROUP BY seq_id""",
    "evaluate_bundle": f"{BASE}, {counted()}, {BS}, {LISTS}, {', '.join(f1_sql(t, str(t)) for t in (1, 2, 3, 5))} SELECT seq_id, m.k, round(pk, 6) + 0.0 AS pk, round(wd, 6) + 0.0 AS wd, round(bs, 6) + 0.0 AS bs, "
    + ", ".join(f"round(f{t}.p, 6) + 0.0 AS precision_t{t}, round(f{t}.r, 6) + 0.0 AS recall_t{t}, round(CASE WHEN f{t}.p + f{t}.r > 0 THEN 2 * f{t}.p * f{t}.r / (f{t}.p + f{t}.r) ELSE 0 END, 6) + 0.0 AS f1_t{t}" for t in (1, 2, 3, 5))
    + " FROM m JOIN bs USING (seq_id) JOIN f1 USING (seq_id) JOIN f2 USING (seq_id) JOIN f3 USING (seq_id) JOIN f5 USING (seq_id)",
    "nms": fold_sql(far(5)),
    "min_segment_length": fold_sql(f"{far(6, False)} AND x[1] >= 6 AND n - x[1] >= 6"),
    "select_boundaries": fold_sql(f"{far(3)} AND {far(5, False)} AND x[1] >= 5 AND n - x[1] >= 5 AND len(acc) < 6"),
    "spaced_top": fold_sql(f"{far(4, False)} AND len(acc) < 7"),
    "pick_spaced": fold_sql(f"{far(4)} AND len(acc) < 7", "WHERE boundary >= 4 AND boundary <= n - 4"),
    "postprocess": f"""{ranked_sql()}, k AS (SELECT seq_id, n, list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN {far(4)} THEN list_append(acc, x[1]) ELSE acc END, []::INT[]) AS b FROM o JOIN sizes USING (seq_id)),
q AS (SELECT seq_id, list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN {far(6, False)} AND x[1] >= 6 AND n - x[1] >= 6 THEN list_append(acc, x[1]) ELSE acc END, []::INT[]) AS kept FROM k) SELECT seq_id, unnest(kept)::BIGINT AS boundary FROM q""",
    "local_shift": f"WITH {ONE}, {ADJ}, hyp AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 9), j AS (SELECT h.seq_id, h.boundary, arg_min(a.boundary, (round(1 - a.score, 6), abs(a.boundary - h.boundary), a.boundary)) AS t FROM hyp h JOIN adj a ON a.seq_id = h.seq_id AND abs(a.boundary - h.boundary) <= 2 GROUP BY h.seq_id, h.boundary) SELECT DISTINCT seq_id, t::BIGINT AS boundary FROM j",
    "sustained_changes": f"""{T.with_("vectors")}, c AS (SELECT seq_id, list(pos ORDER BY pos) AS b FROM (SELECT *, lag(label) OVER (PARTITION BY seq_id ORDER BY pos) AS p FROM vectors) WHERE pos > 0 AND p <> label GROUP BY seq_id),
k AS (SELECT seq_id, list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] >= 5 THEN list_append(acc, x[1]) ELSE acc END, []::INT[]) AS kept FROM c) SELECT seq_id, unnest(kept)::BIGINT AS boundary FROM k""",
    "between_anchors": f"""WITH {ONE}, {T.SQL["vectors"]}, {T.SQL["refs"]}, a AS (SELECT * FROM refs WHERE boundary % 5 = 0), n AS (SELECT seq_id, count(*) AS m FROM a GROUP BY seq_id),
x AS (SELECT o.seq_id, o.boundary, row_number() OVER (PARTITION BY o.seq_id ORDER BY score DESC, o.boundary) AS r FROM one o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.seq_id = o.seq_id AND abs(a.boundary - o.boundary) <= 3))
SELECT seq_id, boundary::BIGINT AS boundary FROM a UNION SELECT x.seq_id, x.boundary FROM x LEFT JOIN n USING (seq_id) WHERE r <= 6 - coalesce(m, 0)""",
}
