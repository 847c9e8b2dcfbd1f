"""Queries of candidate tables, their scores and searches, pauses, late fusion and subtopics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import gaps, metrics, select
from ..sources import tables as T
from .common import fixed, rounded
from .q_gaps import ADJ, ONE, two_sided_sql
from .q_metrics import BASE, counted

SOURCES = [f"{m}_{n}" for m in ("m1", "m2") for n in ("adj", "win3", "win5", "win9")]
SPLITS = [f"{m}_div_w{w}" for m in ("m1", "m2") for w in C.SPLIT_WINDOWS]
POINTS = [(f, m, w) for f in (0.55, 0.7, 1.0) for m in (3, 5) for w in (2, 3)]


def model(s, d, i):
    return T.two_models(s, d).select("seq_id", "pos", F.col(f"vec{i}").alias("vec"))


def targets(s, d):
    return T.references(T.vectors(s, d)).groupBy("seq_id").agg(F.count("*").cast("int").alias("t"))


def signal(s, d, c):
    """A signal of boundaries made from positions, in place of prosody or shots."""
    return T.vectors(s, d).where("pos > 0").select("seq_id", F.col("pos").alias("boundary"), c.alias("score"))


def gap_table(s, d):
    t = targets(s, d)
    sources = C.gap_sources(model(s, d, 1), "m1", t).union(C.gap_sources(model(s, d, 2), "m2", t))
    return features(s, d, sources, SOURCES)


def features(s, d, sources, names):
    prosody, shots = signal(s, d, ((F.col("pos") * 37) % 11) / 10.0), signal(s, d, (F.col("pos") % 7 == 0).cast("double"))
    return C.features(sources, T.sizes(T.vectors(s, d)), targets(s, d), names, 2, prosody, shots)


def full_table(s, d):
    """The features with the sources of splits beside those of gaps."""
    t = targets(s, d)
    parts = [f(model(s, d, i), f"m{i}", t) for i in (1, 2) for f in (C.gap_sources, C.split_sources)]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return features(s, d, every, SOURCES + SPLITS)


def best_gaps(s, d, k=12):
    return select.top_k(fixed(gaps.gap_one_sided(T.vectors(s, d), 3)), k)


def cube(s, d):
    u = T.vectors(s, d)
    return C.search(fixed(C.vote_scores(gap_table(s, d))), T.references(u), T.sizes(u), POINTS)


def oracle_metrics(s, d):
    u = T.vectors(s, d)
    return rounded(metrics.pk_wd(C.oracle(best_gaps(s, d), T.references(u)), T.references(u), T.sizes(u)))


def parts(s, d):
    p = T.vectors(s, d).where("pos > 0")
    return p.select("seq_id", F.col("pos").alias("boundary"), ((F.col("pos") * 37) % 11).cast("double").alias("pause"), ((F.col("pos") * 53) % 7).cast("double").alias("reset"), ((F.col("pos") * 29) % 13).cast("double").alias("spread"))


def pause_only(s, d):
    """(signal, n, pk, wd): as many picks as the reference has, for each signal."""
    from ..operators.folds import apart, fold, ranked

    u = T.vectors(s, d)
    key = F.struct("seq_id", "signal").alias("seq_id")
    rows = fixed(C.pause_signals(parts(s, d))).join(T.sizes(u), "seq_id").where("boundary > 5 and boundary <= n - 5 and score > 0").select(key, "boundary", "score")
    every = lambda df, *c: df.select("*", F.explode(F.array(*map(F.lit, C.PAUSE_SIGNALS))).alias("signal")).select(key, *c)
    picked = fold(ranked(rows).join(every(targets(s, d), "t"), "seq_id"), lambda acc, b: apart(acc, b, 5), F.col("t")).select("seq_id", F.explode("kept").alias("boundary"))
    m = metrics.pk_wd(picked, every(T.references(u), "boundary"), every(T.sizes(u).join(targets(s, d), "seq_id"), "n"))
    return rounded(m.groupBy(F.col("seq_id.signal").alias("signal")).agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd")))


QUERIES = {
    "candidate_features": lambda s, d: rounded(gap_table(s, d)),
    "candidate_table": lambda s, d: rounded(full_table(s, d)),
    "vote_scores": lambda s, d: rounded(C.vote_scores(gap_table(s, d))),
    "score_families": lambda s, d: rounded(C.score_families(gap_table(s, d))),
    "blended_shortlist": lambda s, d: rounded(C.blended(C.vote_scores(gap_table(s, d)), signal(s, d, ((F.col("pos") * 31) % 17) / 16.0), 0.25, 10)),
    "candidate_oracle": oracle_metrics,
    "candidate_search": lambda s, d: rounded(cube(s, d).groupBy("method").agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd"))),
    "candidate_search_left_out": lambda s, d: rounded(C.search_left_out(cube(s, d))),
    "max_spread": lambda s, d: rounded(C.max_spread(best_gaps(s, d, 15), 6)),
    "subtopic_peaks": lambda s, d: rounded(C.subtopic_peaks(T.vectors(s, d), T.references(T.vectors(s, d)).where("boundary % 3 = 0"))),
    "late_fusion": lambda s, d: rounded(C.late_fusion(fixed(gaps.gap_one_sided(T.vectors(s, d), 3)), fixed(gaps.gap_adjacent(T.vectors(s, d))), 0.7, 0.5)),
    "pause_signals": lambda s, d: rounded(C.pause_signals(parts(s, d))),
    "pause_only": pause_only,
}

MM = "CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE 0 END"
TARGETS = "t AS (SELECT seq_id, count(*) AS t FROM refs GROUP BY seq_id)"


def gap_sql(name: str, a1: int, b1: int, a2: int, b2: int, half: int) -> str:
    """The rounded and min-maxed gap scores of one half of the vectors."""
    from .q_gaps import frame_sql, mean_sql

    part = f"vec[{32 * half + 1}:{32 * half + 32}]"
    f = f"SELECT seq_id, pos, {frame_sql(a1, b1, part)} AS l, {frame_sql(a2, b2, part)} AS r FROM vectors"
    m = f"SELECT seq_id, pos, {mean_sql('l', 32)} AS a, {mean_sql('r', 32)} AS b FROM ({f}) WHERE pos > 0"
    g = f"SELECT seq_id, pos AS boundary, round(1 - list_cosine_similarity(a, b), 6) + 0.0 AS s FROM ({m})"
    return f"g_{name} AS (SELECT seq_id, boundary, '{name}' AS source, {MM.format(c='s')} AS score FROM ({g}) WINDOW q AS (PARTITION BY seq_id))"


FRAMES = {"adj": (-1, -1, 0, 0), "win3": (-3, -1, 0, 2), "win5": (-5, -1, 0, 4), "win9": (-9, -1, 0, 8)}
EVERY = "[" + ", ".join(SOURCES) + "]"
TABLE = f"""WITH {T.SQL["vectors"]}, {T.SQL["refs"]}, {T.SQL["sizes"]}, {TARGETS}, {", ".join(gap_sql(x, *FRAMES[x[3:]], int(x[1]) - 1) for x in SOURCES)},
src AS ({" UNION ALL ".join(f"SELECT g.seq_id, boundary, source, score, row_number() OVER (PARTITION BY g.seq_id ORDER BY score DESC, boundary) AS r, t FROM g_{x} g JOIN t USING (seq_id)" for x in SOURCES)}),
c AS (SELECT seq_id, boundary, count(*) AS votes, count(DISTINCT source[1:2]) AS models, {", ".join(f"coalesce(max(score) FILTER (source = '{x}'), 0) AS {x}" for x in SOURCES)} FROM src WHERE r <= greatest(8 * t, 50) GROUP BY seq_id, boundary),
e AS (SELECT *, list_filter({EVERY}, lambda x: x > 0) AS nz FROM c JOIN sizes USING (seq_id) JOIN t USING (seq_id)),
feat AS (SELECT seq_id, boundary, boundary / n AS place, least(boundary, n - boundary) / n AS edge, ln(1 + n) AS log_n, t / n AS target, votes / max(votes) OVER p AS vote, models / 2 AS agreement,
  coalesce(list_avg(nz), 0) AS mean_source, coalesce(list_max(nz), 0) AS max_source, coalesce(least(boundary - lag(boundary) OVER o, lead(boundary) OVER o - boundary) / n, 1) AS isolation,
  ((boundary * 37) % 11) / 10 AS prosody, (boundary % 7 = 0)::INT::DOUBLE AS shots, len(nz) / {len(SOURCES)} AS density, list_stddev_pop({EVERY}) AS source_std, {", ".join(SOURCES)}
  FROM e WINDOW p AS (PARTITION BY seq_id), o AS (PARTITION BY seq_id ORDER BY boundary))"""
PLAIN = ["place", "edge", "log_n", "target", "vote", "agreement", "mean_source", "max_source", "isolation", "prosody", "shots", "density", "source_std", *SOURCES]
EXTRA = {"centre": "sqrt(least(1, greatest(0, 2 * edge)))", "early": "(CASE WHEN place < 0.04 THEN 0.15 ELSE 0 END)", "late": "(CASE WHEN place > 0.96 THEN 0.10 ELSE 0 END)"}


def weighted_sql(weights: dict[str, float]) -> str:
    total = " + ".join(f"{w!r}::DOUBLE * {EXTRA.get(c, c)}" for c, w in weights.items())
    return f"SELECT seq_id, boundary, {MM.format(c='s')} AS score FROM (SELECT seq_id, boundary, round({total}, 9) AS s FROM feat) WINDOW q AS (PARTITION BY seq_id)"


CHAPTERS = f"""WITH {T.SQL["vectors"]}, {T.SQL["refs"]}, u AS (SELECT v.seq_id, v.pos, vec, coalesce(sum(CASE WHEN r.boundary IS NULL THEN NULL ELSE 1 END) OVER (PARTITION BY v.seq_id ORDER BY v.pos ROWS UNBOUNDED PRECEDING), 0) AS chapter
  FROM vectors v LEFT JOIN (SELECT * FROM refs WHERE boundary % 3 = 0) r ON r.seq_id = v.seq_id AND r.boundary = v.pos),
w AS (SELECT *, count(*) OVER c AS n, min(pos) OVER c AS first, list(vec) OVER (PARTITION BY seq_id, chapter ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, list(vec) OVER (PARTITION BY seq_id, chapter ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS r FROM u WINDOW c AS (PARTITION BY seq_id, chapter)),
g AS (SELECT seq_id, chapter, n, pos, round(1 - list_cosine_similarity(list_transform(range(1, 65), lambda d: list_avg(list_transform(l, lambda v: v[d]))), list_transform(range(1, 65), lambda d: list_avg(list_transform(r, lambda v: v[d])))), 6) + 0.0 AS s FROM w WHERE n >= 8 AND pos > first),
p AS (SELECT *, s > round(avg(s) OVER c + 0.3::DOUBLE * stddev_pop(s) OVER c, 9) AND s > lag(s) OVER o AND s > lead(s) OVER o AS peak FROM g WINDOW c AS (PARTITION BY seq_id, chapter), o AS (PARTITION BY seq_id, chapter ORDER BY pos))"""

SQL = {
    "candidate_features": f"{TABLE} SELECT seq_id, boundary::BIGINT AS boundary, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in PLAIN)} FROM feat",
    "vote_scores": f"{TABLE}, x AS ({weighted_sql(C.VOTE)}) SELECT seq_id, boundary::BIGINT AS boundary, round(score, 6) + 0.0 AS score FROM x",
    "score_families": f"{TABLE} " + " UNION ALL ".join(f"SELECT seq_id, boundary::BIGINT AS boundary, '{n}' AS family, round(score, 6) + 0.0 AS score FROM ({weighted_sql(w)})" for n, w in C.FAMILIES.items()),
    "blended_shortlist": f"""{TABLE}, x AS ({weighted_sql(C.VOTE)}), y AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) AS r, round(0.75::DOUBLE * score + 0.25::DOUBLE * (((boundary * 31) % 17) / 16), 9) AS s FROM x),
z AS (SELECT seq_id, boundary, r, {MM.format(c="s")} AS score FROM y WINDOW q AS (PARTITION BY seq_id)) SELECT seq_id, boundary::BIGINT AS boundary, CASE WHEN r <= 10 THEN round(score, 6) + 0.0 ELSE 0 END::DOUBLE AS score FROM z""",
    "candidate_oracle": f"""{BASE.replace("hyp AS", "cand AS").replace("<= 9", "<= 12")}, hyp AS (SELECT DISTINCT seq_id, b AS boundary FROM (SELECT r.seq_id, r.boundary, arg_min(c.boundary, (abs(c.boundary - r.boundary), c.boundary)) AS b FROM refs r JOIN cand c ON c.seq_id = r.seq_id AND abs(c.boundary - r.boundary) <= 2 GROUP BY r.seq_id, r.boundary)), {counted()}
SELECT seq_id, k, round(pk, 6) + 0.0 AS pk, round(wd, 6) + 0.0 AS wd FROM m""",
    "max_spread": f"""WITH RECURSIVE {ONE}, c AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 15), l AS (SELECT seq_id, list(boundary::BIGINT ORDER BY boundary) AS b FROM c GROUP BY seq_id),
r AS (SELECT seq_id, b, CASE WHEN len(b) <= 6 THEN b ELSE [b[len(b) // 2 + 1]] END AS sel FROM l
  UNION ALL SELECT seq_id, b, list_append(sel, list_sort(list_transform(list_filter(b, lambda x: NOT list_contains(sel, x)), lambda x: struct_pack(d := -list_min(list_transform(sel, lambda y: abs(x - y))), x := x)))[1].x) FROM r WHERE len(sel) < 6 AND len(b) > 6)
SELECT seq_id, unnest(sel) AS boundary FROM r WHERE len(sel) = least(6, len(b))""",
    "subtopic_peaks": f"{CHAPTERS} SELECT seq_id, chapter::BIGINT AS chapter, (pos - 1)::BIGINT AS boundary FROM p WHERE peak QUALIFY row_number() OVER (PARTITION BY seq_id, chapter ORDER BY s DESC, pos) <= least(3, greatest(1, n // 20))",
    "late_fusion": f"""WITH {ONE}, {ADJ}, a AS (SELECT seq_id, boundary, {MM.format(c="score")} AS a FROM one WINDOW q AS (PARTITION BY seq_id)), b AS (SELECT seq_id, boundary, {MM.format(c="score")} AS b FROM adj WINDOW q AS (PARTITION BY seq_id))
SELECT seq_id, boundary, round(0.7::DOUBLE / 1.2 * a + 0.5::DOUBLE / 1.2 * b, 6) + 0.0 AS score FROM a JOIN b USING (seq_id, boundary)""",
}
PARTS = f"""{T.with_("vectors")}, z AS (SELECT seq_id, pos AS boundary, ((pos * 37) % 11)::DOUBLE AS a, ((pos * 53) % 7)::DOUBLE AS b, ((pos * 29) % 13)::DOUBLE AS c FROM vectors WHERE pos > 0),
y AS (SELECT seq_id, boundary, {MM.format(c="a")} AS a, {MM.format(c="b")} AS b, {MM.format(c="c")} AS c FROM z WINDOW q AS (PARTITION BY seq_id)),
sg AS ({" UNION ALL ".join(f"SELECT seq_id, boundary, '{n}' AS signal, round({w[0]}::DOUBLE * a + {w[1]}::DOUBLE * b + {w[2]}::DOUBLE * c, 6) + 0.0 AS score FROM y" for n, w in C.PAUSE_SIGNALS.items())})"""
SQL["pause_signals"] = f"{PARTS} SELECT seq_id, boundary::BIGINT AS boundary, signal, score FROM sg"
PICK = "CASE WHEN len(acc) < t AND len(list_filter(acc, lambda y: abs(y - x[1]) <= 5)) = 0 THEN list_append(acc, x[1]) ELSE acc END"
SQL["pause_only"] = f"""{PARTS}, {T.SQL["refs"]}, {T.SQL["sizes"]}, {TARGETS}, ss AS (SELECT DISTINCT signal FROM sg), key AS (SELECT seq_id, n, t, signal, seq_id::VARCHAR || ':' || signal AS id FROM sizes JOIN t USING (seq_id) CROSS JOIN ss),
o AS (SELECT id, list(boundary::INT ORDER BY score DESC, boundary) AS b, any_value(t) AS t FROM sg JOIN key USING (seq_id, signal) WHERE boundary > 5 AND boundary <= n - 5 AND score > 0 GROUP BY id),
h AS (SELECT id AS seq_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: {PICK}, []::INT[])) AS boundary FROM o),
rr AS (SELECT id AS seq_id, boundary FROM refs JOIN key USING (seq_id)), zz AS (SELECT id AS seq_id, n FROM key), {counted("h", "rr").replace("FROM sizes LEFT JOIN", "FROM zz LEFT JOIN")}
SELECT split_part(seq_id, ':', 2) AS signal, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd FROM m GROUP BY 1"""


def search_sql() -> str:
    """The cube of candidate_search: a hypothesis for each point and sequence, and its metrics."""
    ok = "len(acc) < c AND len(list_filter(acc, lambda y: abs(y - x[1]) <= w OR abs(y - x[1]) < m)) = 0 AND x[1] >= m AND n - x[1] >= m"
    points = ", ".join(f"('frac{round(100 * f)}_min{m}_nms{w}', {f}::DOUBLE, {m}, {w})" for f, m, w in POINTS)
    return f"""{TABLE}, vs AS ({weighted_sql(C.VOTE)}), pt(method, f, m, w) AS (VALUES {points}), key AS (SELECT seq_id, n, t, method, greatest(1, round_even(t * f, 0)) AS c, m, w, seq_id::VARCHAR || ':' || method AS id FROM sizes JOIN t USING (seq_id), pt),
o AS (SELECT id, n, c, m, w, list(boundary::INT ORDER BY round(score, 6) DESC, boundary) AS b FROM vs JOIN key USING (seq_id) GROUP BY ALL),
h AS (SELECT id AS seq_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN {ok} THEN list_append(acc, x[1]) ELSE acc END, []::INT[])) AS boundary FROM o),
rr AS (SELECT id AS seq_id, boundary FROM refs JOIN key USING (seq_id)), zz AS (SELECT id AS seq_id, n FROM key), {counted("h", "rr", "x").replace("FROM sizes LEFT JOIN", "FROM zz LEFT JOIN")},
qb AS (SELECT split_part(seq_id, ':', 1)::BIGINT AS seq_id, split_part(seq_id, ':', 2) AS method, pk, wd FROM mx)"""


SQL["candidate_search"] = f"{search_sql()} SELECT method, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd FROM qb GROUP BY method"
SQL["candidate_search_left_out"] = f"""{search_sql()}, lo AS (SELECT *, round((sum(pk) OVER q - pk) / (count(*) OVER q - 1), 9) AS p2, round((sum(wd) OVER q - wd) / (count(*) OVER q - 1), 9) AS w2 FROM qb WINDOW q AS (PARTITION BY method))
SELECT seq_id, method, round(pk, 6) + 0.0 AS pk, round(wd, 6) + 0.0 AS wd FROM lo QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY p2, w2, method) = 1"""
