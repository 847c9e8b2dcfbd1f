"""Queries of relaxed metrics, agreement, sweeps, operating points, checks and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import align, checks, fusion, gaps, metrics, portfolio, select, stats, text
from ..sources import readers
from ..sources import tables as T
from ..streaming import sessions
from .common import fixed, rounded
from .q_align import EV, MODE_SQL
from .q_metrics import BASE, BS, LISTS, counted, f1_sql, inputs
from .q_portfolio import CUBE, R, cube

SECONDS = 13  # a unit's length where units have no times


def relaxed(s, d):
    hyp, ref, z = inputs(s, d)
    starts = T.vectors(s, d).select("seq_id", "pos", (F.col("pos") * SECONDS).cast("double").alias("start"))
    return rounded(metrics.relaxed(hyp, ref, z.withColumn("duration", (F.col("n") * SECONDS).cast("double")), starts))


def annotators(s, d):
    hyp, ref, z = inputs(s, d)
    even = lambda x: x.where("boundary % 2 = 0")
    return metrics.agreement(even(hyp), even(ref), z), metrics.agreement(hyp, ref, z)


def sweep(s, d):
    """(mode, n, pk, wd): the six longest pauses of each sequence against marks that are aligned in each of the seven modes."""
    u = T.timed_units(s, d)
    z = T.sizes(u)
    w = Window.partitionBy("seq_id").orderBy("pos")
    pauses = u.withColumn("score", F.col("start") - F.lag("start").over(w)).where("score is not null").select("seq_id", F.col("pos").alias("boundary"), "score")
    refs = align.aligned(u, T.marks(s, d, "signup"))
    key = F.struct("seq_id", "mode").alias("seq_id")
    z = refs.select("seq_id", "mode").distinct().join(z, "seq_id").select(key, "n")
    hyp = refs.select("seq_id", "mode").distinct().join(select.top_k(pauses, 6), "seq_id").select(key, "boundary")
    m = metrics.pk_wd(hyp, refs.select(key, "boundary"), z)
    return rounded(m.groupBy(F.col("seq_id.mode").alias("mode")).agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd")))


def known_count(s, d):
    """(seq_id, k_reference, k_heuristic, pk_reference, pk_heuristic): the best gaps by the reference's count and by the root heuristic."""
    u = T.vectors(s, d)
    r, z, scores = T.references(u), T.sizes(u), fixed(gaps.gap_one_sided(u, 3))
    k = z.join(r.groupBy("seq_id").agg((F.count("*") + 1).cast("int").alias("a")), "seq_id").withColumn("b", F.greatest(F.lit(2), F.bround(F.sqrt("n") / 3).cast("int")))
    one = lambda c, name: metrics.pk_wd(select.top_k(scores.join(k.select("seq_id", F.col(c).alias("_k")), "seq_id"), F.col("_k") - 1).select("seq_id", "boundary"), r, z).select("seq_id", F.col("pk").alias(name))
    return rounded(k.join(one("a", "pk_reference"), "seq_id").join(one("b", "pk_heuristic"), "seq_id").select("seq_id", F.col("a").alias("k_reference"), F.col("b").alias("k_heuristic"), "pk_reference", "pk_heuristic"))


def points(s, d):
    m = portfolio.means(cube(s, d)).withColumn("role", F.when(F.col("method") == "dp", "oracle").otherwise("method"))
    return rounded(portfolio.operating_points(m))


def improvements(s, d):
    m = portfolio.means(cube(s, d))
    base = m.where("method = 'dp'").select(F.col("pk").alias("p0"))
    return rounded(m.join(F.broadcast(base)).select("method", stats.improvement(F.col("p0"), F.col("pk")).alias("percent")))


def best_and_worst(s, d, k=6):
    """(seq_id, side, pk): the sequences with the k smallest and the k largest values of one method."""
    rows = cube(s, d).where("method = 'divisive' and error is null").select("seq_id", "pk")
    side = lambda n, *o: rows.orderBy(*o).limit(k).select("seq_id", F.lit(n).alias("side"), "pk")
    return rounded(side("best", "pk", "seq_id").union(side("worst", F.desc("pk"), "seq_id")))


def dataset_checks(s, d):
    t = lambda n: T.read(s, d, n)
    docs, conv, e, b, labels = t("documents"), t("conversations"), t("embeddings"), t("benchmark"), t("labels")
    turns = conv.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    refs = T.references(T.vectors(s, d)).groupBy("seq_id").agg(F.array_sort(F.collect_list("boundary")).alias("b")).join(T.sizes(T.vectors(s, d)), "seq_id")
    return rounded(checks.every([
        checks.unique("document ids are unique", docs, "doc_id"), checks.present("documents have id and text", docs, "doc_id", "text"), checks.holds("n_chars is the length of the text", docs, "n_chars = length(text)"),
        checks.holds("languages are known", docs, "lang in ('en', 'de', 'fr', 'es')"), checks.unique("vector ids are unique", e, "vec_id"), checks.holds("vectors have 64 components", e, "size(embedding) = 64"),
        checks.refers("labels name documents", labels, "doc_id", docs, "doc_id"), checks.unique("items are unique", b, "item_id"), checks.holds("turns are consecutive", turns, "high - low + 1 = n"),
        checks.inside_and_rising("boundaries rise within a sequence", refs, "b", "n"),
    ]))


def scalar_texts(s, d):
    """LaTeX, titles, answers and numbers, over turns with markup, an answer and numbers put in front."""
    t = T.turns(s, d)
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("pos") % len(ANSWERS) + 1).cast("int"))
    t = t.withColumn("a", F.concat(answer, F.lit(" "), "text"))
    return rounded(t.select("seq_id", "pos", X.latex(F.col("a")).alias("latex"), X.inferred_title(F.col("a"), 4).alias("title"), X.yes_no(F.col("a")).alias("yes"), X.first_in_range(F.col("a"), F.lit(5), F.lit(40)).alias("number"), F.length(F.col("a")).alias("n_chars")))


ANSWERS = ["Yes, 3 or 12", "no: 50% of #7", "**YES** a_b & $9", "maybe 1 then 41 then 40", "{x} No"]


def frames(s, d):
    t = T.turns(s, d)
    return t.select("seq_id", "pos", "text", (((F.col("pos") * 7) % 10) / 8.0).alias("confidence"))


def confident(s, d):
    """Frames over a confidence, and the change scores of those that stay."""
    kept = frames(s, d).where("confidence > 0.5").withColumn("pos", (F.row_number().over(Window.partitionBy("seq_id").orderBy("pos")) - 1).cast("int"))
    return rounded(fusion.ocr_change(kept))


def pieces(s, d):
    """Times of pieces in proportion to their lengths; every fifth piece is dropped and takes no time."""
    u = T.text_units(s, d).where("pos % 5 <> 4").select("seq_id", F.expr("pos div 5").alias("seg"), F.col("pos").alias("ord"), "text", (F.expr("pos div 5") * 10.0).cast("double").alias("s"), (F.expr("pos div 5") * 10.0 + 10.0).cast("double").alias("e"))
    return rounded(text.proportional_times(u).select("seq_id", "seg", "ord", "start", "end"))


def transcripts(s, d):
    """Health of transcripts: users' events stand for segments, every seventh user has none and every fifth no text."""
    e = T.events(s, d)
    users = e.select("seq_id").distinct()
    rows = e.where("seq_id % 7 <> 0").select("seq_id", (F.col("value") * 3).alias("end"), F.when(F.col("seq_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("text"))
    return rounded(readers.health(users, rows, 250.0))


def oddities(s, d):
    """Flags of chapter lists: boundaries of a sequence of vectors stand for chapters, 20 seconds a unit."""
    v = T.vectors(s, d)
    b = T.references(v).groupBy("seq_id").agg(F.array_sort(F.collect_list((F.col("boundary") * 20.0).cast("double"))).alias("b")).join(T.sizes(v), "seq_id")
    return rounded(b.select("seq_id", F.array_join(readers.sanity(F.col("b"), F.col("n") * 20.0), ",").alias("flags")))


def auto_segments(s, d):
    """(seq_id, n_subtopics): gaps over mean + half a deviation, and one, but at most a third of the units."""
    from ..operators.fusion import auto_count

    u = T.vectors(s, d)
    return rounded(auto_count(fixed(gaps.gap_overlapping(u, 3)), T.sizes(u)))


QUERIES = {
    "relaxed_metrics": relaxed,
    "agreement_subtopics": lambda s, d: rounded(annotators(s, d)[1]),
    "agreement_summary": lambda s, d: rounded(metrics.agreement_summary(*annotators(s, d))),
    "align_sweep": sweep,
    "known_count": known_count,
    "operating_points": points,
    "improvement": improvements,
    "best_and_worst": best_and_worst,
    "dataset_checks": dataset_checks,
    "scalar_texts": scalar_texts,
    "ocr_change": confident,
    "proportional_times": pieces,
    "transcript_health": transcripts,
    "chapter_sanity": oddities,
    "segment_auto": auto_segments,
    "windowed_counts": lambda s, d: rounded(sessions.windowed_counts(T.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select("event_type", F.unix_micros("start").alias("start_us"), "n")),
}

KAPPA = """u{x} AS (SELECT seq_id, n, unnest(range(0, n)) AS p FROM sizes), x{x} AS (SELECT seq_id, p, (EXISTS (SELECT 1 FROM {h} h WHERE h.seq_id = u.seq_id AND h.boundary = p))::INT AS a, (EXISTS (SELECT 1 FROM {r} r WHERE r.seq_id = u.seq_id AND abs(r.boundary - p) <= 1))::INT AS b FROM u{x} u),
g{x} AS (SELECT seq_id, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM x{x} GROUP BY seq_id), kp{x} AS (SELECT seq_id, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM g{x})"""
F1 = "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1"


def lists_sql(h: str, r: str, name: str) -> str:
    return LISTS.replace("l AS (", f"{name} AS (", 1).replace("FROM hyp h", f"FROM {h} h").replace("FROM refs r", f"FROM {r} r")


EVEN = f"h2 AS (SELECT * FROM hyp WHERE boundary % 2 = 0), r2 AS (SELECT * FROM refs WHERE boundary % 2 = 0), {KAPPA.format(x='1', h='h2', r='r2')}, {KAPPA.format(x='2', h='hyp', r='refs')}, {lists_sql('h2', 'r2', 'l1')}, {LISTS}, {f1_sql(1, 'c').replace('FROM l)', 'FROM l1)')}, {f1_sql(1, 's')}"
IOU = """p AS (SELECT seq_id, start, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY start), n) AS fin FROM (SELECT seq_id, boundary AS start FROM hyp UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id)),
q AS (SELECT seq_id, start, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY start), n) AS fin FROM (SELECT seq_id, boundary AS start FROM refs UNION SELECT seq_id, 0 FROM sizes) JOIN sizes USING (seq_id)),
io AS (SELECT p.seq_id, p.start, max(greatest(0, least(p.fin, q.fin) - greatest(p.start, q.start)) / (greatest(p.fin, q.fin) - least(p.start, q.start))) AS best FROM p JOIN q USING (seq_id) GROUP BY p.seq_id, p.start),
iou AS (SELECT seq_id, avg(best) AS mean_best_tiou FROM io GROUP BY seq_id)"""
UT, TT = metrics.UNIT_TOLERANCES, metrics.TIME_TOLERANCES
ALIGNED = EV.format(kind="signup") + ", al AS (" + " UNION ALL ".join(f"SELECT m.seq_id, m.event_id, '{m}' AS mode, {x} AS i FROM marks m JOIN timed t USING (seq_id) GROUP BY m.seq_id, m.event_id, m.us" for m, x in MODE_SQL.items()) + "), ar AS (SELECT DISTINCT seq_id, mode, greatest(1, least(i, n - 1))::BIGINT AS boundary FROM al JOIN n USING (seq_id) WHERE n > 1)"
quote = lambda x: "'" + x.replace("'", "''") + "'"
ANSWER = f"x AS (SELECT seq_id, pos, [{', '.join(map(quote, ANSWERS))}][pos % {len(ANSWERS)} + 1] || ' ' || text AS a FROM turns)"
LATEX = "a"
for old, new in (("\\", "\\textbackslash{}"), *((c, "\\" + c) for c in "&%$#_")):
    LATEX = f"replace({LATEX}, '{old}', '{new}')"
SET = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z'']+)', 1), lambda w: len(w) > 2))"
CHECK = lambda name, sql: f"SELECT '{name}' AS \"check\", count(*) AS n_bad, count(*) = 0 AS ok FROM ({sql})"

SQL = {
    "relaxed_metrics": f"{BASE}, {counted()}, {BS}, {LISTS}, {', '.join(f1_sql(t, str(t)) for t in UT)}, ls AS (SELECT seq_id, n, list_transform(h, lambda x: greatest(1, least(x * {SECONDS}, n * {SECONDS} - 1))) AS h, list_transform(r, lambda x: greatest(1, least(x * {SECONDS}, n * {SECONDS} - 1))) AS r FROM l), {', '.join(f1_sql(t, f's{t}').replace('FROM l)', 'FROM ls)') for t in TT)}, {IOU} SELECT seq_id, round(pk, 6) + 0.0 AS pk, round(wd, 6) + 0.0 AS wd, round(bs, 6) + 0.0 AS bs, "
    + ", ".join(f"round(CASE WHEN {f}.p + {f}.r > 0 THEN 2 * {f}.p * {f}.r / ({f}.p + {f}.r) ELSE 0 END, 6) + 0.0 AS {n}" for f, n in [*((f"f{t}", f"f1_t{t}") for t in UT), *((f"fs{t}", f"time_f1_{t}s") for t in TT)])
    + ", len(l.r)::BIGINT AS n_reference, len(l.h)::BIGINT AS n_predicted, (len(l.h) - len(l.r))::BIGINT AS count_error, abs(len(l.h) - len(l.r))::BIGINT AS abs_count_error, round(len(l.h) / greatest(1, len(l.r)), 6) + 0.0 AS boundary_ratio, round(mean_best_tiou, 6) + 0.0 AS mean_best_tiou FROM m JOIN bs USING (seq_id) JOIN l USING (seq_id) JOIN iou USING (seq_id) "
    + " ".join(f"JOIN {f} USING (seq_id)" for f in [*(f"f{t}" for t in UT), *(f"fs{t}" for t in TT)]),
    "agreement_subtopics": f"{BASE}, {EVEN} SELECT seq_id, kappa, round(p, 4)::DOUBLE AS precision, round(r, 4)::DOUBLE AS recall, {F1} FROM kp2 JOIN fs USING (seq_id)",
    "agreement_summary": f"{BASE}, {EVEN}, c AS (SELECT seq_id, {F1} FROM fc), s AS (SELECT seq_id, {F1} FROM fs) SELECT count(*) AS n, round(avg(kp1.kappa), 4) AS kappa_chapter, round(avg(c.f1), 4) AS f1_chapter, round(avg(kp2.kappa), 4) AS kappa_subtopic, round(avg(s.f1), 4) AS f1_subtopic FROM kp1 JOIN kp2 USING (seq_id) JOIN c USING (seq_id) JOIN s USING (seq_id)",
    "align_sweep": f"""{ALIGNED}, key AS (SELECT DISTINCT seq_id, mode, seq_id::VARCHAR || ':' || mode AS id FROM ar), pz AS (SELECT seq_id, pos AS boundary, start - lag(start) OVER (PARTITION BY seq_id ORDER BY pos) AS score FROM timed),
tp AS (SELECT seq_id, boundary FROM pz WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 6),
h AS (SELECT id AS seq_id, boundary FROM tp JOIN key USING (seq_id)), rr AS (SELECT id AS seq_id, boundary FROM ar JOIN key USING (seq_id, mode)), zz AS (SELECT id AS seq_id, n FROM n JOIN key USING (seq_id)), {counted("h", "rr").replace("FROM sizes LEFT JOIN", "FROM zz LEFT JOIN")}
SELECT split_part(seq_id, ':', 2) AS mode, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd FROM m GROUP BY 1""",
    "known_count": f"""{BASE}, kk AS (SELECT seq_id, n, count(*) + 1 AS a, greatest(2, round_even(sqrt(n) / 3, 0))::INT AS b FROM sizes JOIN refs USING (seq_id) GROUP BY seq_id, n), rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS rn FROM one JOIN kk USING (seq_id)),
h1 AS (SELECT seq_id, boundary FROM rk WHERE rn <= a - 1), h2 AS (SELECT seq_id, boundary FROM rk WHERE rn <= b - 1), {counted("h1", "refs", "1")}, {counted("h2", "refs", "2")}
SELECT seq_id, a AS k_reference, b::BIGINT AS k_heuristic, round(m1.pk, 6) + 0.0 AS pk_reference, round(m2.pk, 6) + 0.0 AS pk_heuristic FROM kk JOIN m1 USING (seq_id) JOIN m2 USING (seq_id)""",
    "operating_points": f"""{CUBE}, dm AS (SELECT a.method, count(b.method) AS dominated_by FROM means a LEFT JOIN means b ON b.pk <= a.pk AND b.wd <= a.wd AND b.f1 >= a.f1 AND (b.pk < a.pk OR b.wd < a.wd OR b.f1 > a.f1) GROUP BY a.method),
r AS (SELECT method, row_number() OVER (ORDER BY pk, wd, method) AS a, row_number() OVER (ORDER BY wd, pk, method) AS b, row_number() OVER (ORDER BY (pk + wd) / 2, pk, method) AS c, row_number() OVER (ORDER BY f1 DESC, method) AS e, row_number() OVER (ORDER BY method = 'dp', (pk + wd) / 2, pk) AS f FROM means)
SELECT method, dominated_by, a = 1 AS is_best_pk, b = 1 AS is_best_wd, c = 1 AS is_best_balanced, e = 1 AS is_best_hits, f = 1 AS is_best_deployable FROM dm JOIN r USING (method)""",
    "improvement": f"{CUBE} SELECT m.method, round(CASE WHEN b.pk <> 0 THEN 100 * (b.pk - m.pk) / b.pk END, 6) + 0.0 AS percent FROM means m, (SELECT pk FROM means WHERE method = 'dp') b",
    "best_and_worst": f"{CUBE}, x AS (SELECT seq_id, pk, row_number() OVER (ORDER BY pk, seq_id) AS a, row_number() OVER (ORDER BY pk DESC, seq_id) AS b FROM cube WHERE method = 'divisive') SELECT seq_id, 'best' AS side, {R('pk')} FROM x WHERE a <= 6 UNION ALL SELECT seq_id, 'worst', {R('pk')} FROM x WHERE b <= 6",
    "dataset_checks": f"{T.with_('vectors', 'refs', 'sizes')} " + " UNION ALL ".join([
        CHECK("document ids are unique", "SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1"), CHECK("documents have id and text", "SELECT 1 FROM documents WHERE doc_id IS NULL OR text IS NULL"),
        CHECK("n_chars is the length of the text", "SELECT 1 FROM documents WHERE NOT coalesce(n_chars = length(text), false)"), CHECK("languages are known", "SELECT 1 FROM documents WHERE NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)"),
        CHECK("vector ids are unique", "SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1"), CHECK("vectors have 64 components", "SELECT 1 FROM embeddings WHERE NOT coalesce(len(embedding) = 64, false)"),
        CHECK("labels name documents", "SELECT 1 FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)"), CHECK("items are unique", "SELECT item_id FROM benchmark GROUP BY item_id HAVING count(*) > 1"),
        CHECK("turns are consecutive", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(*)"), CHECK("boundaries rise within a sequence", "SELECT seq_id FROM refs JOIN sizes USING (seq_id) WHERE boundary <= 0 OR boundary >= n OR (seq_id, boundary) IN (SELECT (seq_id, boundary) FROM refs GROUP BY seq_id, boundary HAVING count(*) > 1)"),
    ]),
    "scalar_texts": f"""{T.with_('turns')}, {ANSWER} SELECT seq_id, pos::BIGINT AS pos, {LATEX} AS latex, array_to_string(regexp_extract_all(a, '([A-Za-z0-9]+)', 1)[1:4], ' ') AS title,
CASE WHEN regexp_matches(lower(trim(a)), '^\\W*yes\\b') THEN 1.0 WHEN regexp_matches(lower(trim(a)), '^\\W*no\\b') THEN 0.0 END::DOUBLE AS yes, list_filter(list_transform(regexp_extract_all(a, '(\\d{{1,9}})', 1), lambda x: x::BIGINT), lambda x: x >= 5 AND x <= 40)[1] AS number, length(a)::BIGINT AS n_chars FROM x""",
    "ocr_change": f"""{T.with_('turns')}, f AS (SELECT seq_id, pos, text, ((pos * 7) % 10) / 8.0 AS c FROM turns), k AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos, text, c::DOUBLE AS c, {SET} AS s FROM f WHERE c > 0.5),
p AS (SELECT *, lag(text) OVER w AS pt, lag(s) OVER w AS ps, count(*) OVER (PARTITION BY seq_id) AS n FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
v AS (SELECT seq_id, pos, n, (0.7::DOUBLE * (1 - CASE WHEN len(s) + len(ps) - len(list_intersect(s, ps)) > 0 THEN len(list_intersect(s, ps)) / (len(s) + len(ps) - len(list_intersect(s, ps))) ELSE 0 END) + 0.3::DOUBLE * (pt <> text)::INT) * least(1, greatest(0.1::DOUBLE, c)) AS v FROM p WHERE pt IS NOT NULL),
e AS (SELECT seq_id, n, pos + d AS boundary, f * v AS s FROM v, (VALUES (-1, 0.5::DOUBLE), (0, 1.0::DOUBLE), (1, 0.5::DOUBLE)) x(d, f)) SELECT seq_id, boundary, round(max(s), 6) + 0.0 AS score FROM e WHERE boundary > 0 AND boundary < n GROUP BY seq_id, boundary""",
    "proportional_times": f"""{T.with_('units')}, u AS (SELECT seq_id, pos // 5 AS seg, pos AS ord, length(text) AS c FROM units WHERE pos % 5 <> 4), x AS (SELECT *, sum(c) OVER (PARTITION BY seq_id, seg) AS t, sum(c) OVER (PARTITION BY seq_id, seg ORDER BY ord) AS up FROM u)
SELECT seq_id, seg::BIGINT AS seg, ord::BIGINT AS ord, round(seg * 10.0::DOUBLE + 10.0::DOUBLE * (up - c) / t, 6) + 0.0 AS start, round(seg * 10.0::DOUBLE + 10.0::DOUBLE * up / t, 6) + 0.0 AS "end" FROM x""",
    "transcript_health": f"""{T.with_('ev')}, g AS (SELECT seq_id, max(value * 3) AS e, sum(CASE WHEN seq_id % 5 = 0 THEN 0 ELSE length(event_type) END) AS c FROM ev WHERE seq_id % 7 <> 0 GROUP BY seq_id)
SELECT u.seq_id, CASE WHEN e IS NULL THEN 'missing' WHEN c = 0 THEN 'empty' WHEN e < 250 THEN 'short' ELSE 'ok' END AS health FROM (SELECT DISTINCT seq_id FROM ev) u LEFT JOIN g USING (seq_id)""",
    "chapter_sanity": f"""{T.with_('vectors', 'refs', 'sizes')}, e AS (SELECT seq_id, (lead(b) OVER (PARTITION BY seq_id ORDER BY b) - b) * 20 AS len FROM (SELECT seq_id, boundary AS b FROM refs UNION SELECT seq_id, 0 FROM refs UNION SELECT seq_id, n FROM sizes WHERE seq_id IN (SELECT seq_id FROM refs)))
SELECT seq_id, array_to_string(list_filter([CASE WHEN count(len) < 3 THEN 'few' END, CASE WHEN min(len) < 30 THEN 'short' END, CASE WHEN max(len) > 1800 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS flags FROM e GROUP BY seq_id""",
    "windowed_counts": f"{T.with_('ev')} SELECT event_type, us // 86400000000 * 86400000000 AS start_us, count(*) AS n FROM ev GROUP BY 1, 2",
}
SQL["segment_auto"] = f"""WITH {T.SQL['vectors']}, {T.SQL['sizes']}, f AS (SELECT seq_id, pos, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING) AS l, list(vec) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS r FROM vectors),
m AS (SELECT seq_id, round(1 - list_cosine_similarity(list_transform(range(1, 65), lambda d: list_avg(list_transform(l, lambda v: v[d]))), list_transform(range(1, 65), lambda d: list_avg(list_transform(r, lambda v: v[d])))), 6) + 0.0 AS s FROM f WHERE pos > 0),
t AS (SELECT seq_id, avg(s) + 0.5::DOUBLE * stddev_pop(s) AS t FROM m GROUP BY seq_id) SELECT seq_id, least(greatest(2, count(*) FILTER (s > round(t, 9)) + 1), n // 3)::BIGINT AS n_subtopics FROM m JOIN t USING (seq_id) JOIN sizes USING (seq_id) GROUP BY seq_id, n"""
