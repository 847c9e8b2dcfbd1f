"""Queries of candidate classifiers, peaks, aligned vectors, searches over grids and weights, and the table function, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, folds, gaps, learning, maps, metrics, search
from ..operators import candidates as C
from ..sources import tables as T
from ..sources.stored import stored
from . import q_candidates as Q
from . import table_functions
from .common import fixed, rounded
from .q_gaps import ONE

#: Units of time of a vector, of a window of units, and windows of a sequence; the last holds no vector.
STEP, SPAN, WINDOWS = 10, 60, 10
#: Feature columns of the candidate classifiers before the sources.
COLUMNS = ["place", "edge", "log_n", "target", "vote", "agreement", "mean_source", "max_source", "isolation", "prosody", "shots"]


def labelled(s, d, tolerance=2):
    """The candidate table with label 1 for candidates within the tolerance of a reference boundary."""
    table = Q.full_table(s, d)
    hit = align.within_band(table.select("seq_id", "boundary"), T.references(T.vectors(s, d)), tolerance).withColumn("hit", F.lit(1))
    return table.join(hit, ["seq_id", "boundary"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def ranker(s, d):
    got = learning.logistic_left_out(labelled(s, d), COLUMNS + Q.SOURCES + Q.SPLITS, "hit")
    return got.select("seq_id", "boundary", F.col("hit").cast("long").alias("hit"), "probability")


def ranker_search(s, d):
    """(method, n, pk, wd): greedy choices by the classifiers' probabilities for each point."""
    u = T.vectors(s, d)
    cube = C.search(ranker(s, d).select("seq_id", "boundary", F.round("probability", 6).alias("score")), T.references(u), T.sizes(u), Q.POINTS)
    return rounded(cube.groupBy("method").agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd")))


def windows(s, d):
    """Windows of time over each sequence; between some of them there is a gap."""
    w = T.vectors(s, d).select("seq_id").distinct().select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("pos"))
    return w.select("seq_id", "pos", (F.col("pos") * SPAN + (F.col("pos") % 3) * 7).cast("long").alias("start"), ((F.col("pos") + 1) * SPAN - (F.col("pos") % 2) * 9).cast("long").alias("end"))


def vectors_of_windows(s, d):
    marks = T.vectors(s, d).select("seq_id", F.col("pos").cast("long").alias("event_id"), (F.col("pos") * STEP + 3).cast("long").alias("us"), "vec")
    rows = align.assign_vectors(windows(s, d), marks, 64)
    return rows.select("seq_id", "pos", "n_marks", F.posexplode("mean").alias("i", "mean"), "max").select("seq_id", "pos", "n_marks", "i", "mean", F.element_at("max", F.col("i") + 1).alias("max"))


def segment_function(s, d):
    from .q_segment import wanted

    table_functions.register(s)
    T.two_models(s, d).join(wanted(s, d), "seq_id").createOrReplaceTempView("strandline_units")
    return s.sql("SELECT * FROM segment(TABLE(strandline_units) PARTITION BY (seq_id) ORDER BY (pos), 'divisive')")


WEIGHTS = search.weight_points(200, anchors=False)
GRID = {"windows": [9, 11], "shares": [0.65, 0.75], "overs": [4, 6], "weights": {"ocr": [0.0, 0.3], "pros": [0.0, 0.1], "shot": [0.0, 0.1]}, "lengths": [3, 5], "suppressions": [1, 5]}


def weights(s, d):
    """(point, n, pk, wd): means of each point of weights over the sequences."""
    u = T.vectors(s, d)
    t = Q.targets(s, d)
    hyp = search.weight_search(Q.gap_table(s, d), T.sizes(u).join(t.select("seq_id"), "seq_id"), t, WEIGHTS).withColumn("method", F.col("point").cast("string"))
    points = s.range(len(WEIGHTS)).select(F.col("id").cast("string").alias("method"))
    known = t.select("seq_id")
    m = maps.measured(hyp, points, T.references(u).join(known, "seq_id"), T.sizes(u).join(known, "seq_id"))
    return rounded(m.groupBy(F.col("method").cast("long").alias("point")).agg(F.count("*").alias("n"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd")))


def fusion(s, d):
    """(method, n, pk, wd) of every point of the grid."""
    from .q_segment import wanted

    u, two = T.vectors(s, d), T.two_models(s, d)
    facts = stored(metrics.expected(T.references(u), T.sizes(u)).join(wanted(s, d), "seq_id"), "facts")
    most = facts.select("seq_id", F.least(F.col("n") - 1, F.greatest(F.lit(2), "k") * max(GRID["overs"]) + 2).alias("m"))
    table = maps.split_maps(two, most, GRID["windows"])
    signal = lambda a, b: Q.signal(s, d, ((F.col("pos") * a) % b) / float(b))
    kept = maps.grid_choices(table, facts, {"ocr": signal(31, 17), "pros": signal(37, 11), "shot": signal(53, 7)}, **GRID)
    m = kept.select("method", metrics.missed(F.col("kept"), F.col("width"), F.col("met")).alias("m"))
    return rounded(m.groupBy("method").agg(F.count("*").alias("n"), F.avg("m.pk").alias("pk"), F.avg("m.wd").alias("wd")))


def counts(s, d):
    """Segments of each document without a reference; a word lasts half a second."""
    u = T.text_units(s, d).withColumn("_w", F.size(F.split("text", r"\s+")))
    g = u.groupBy("seq_id").agg(F.count("*").alias("n"), (F.sum("_w") / 2).alias("seconds"))
    return g.select("seq_id", "n", scalars.chapters_for(F.col("n")).alias("chapters"), scalars.subtopics_for(F.col("n")).alias("subtopics"), *(scalars.estimated_segments(F.col("n"), F.col("seconds"), x).alias(x) for x in scalars.LENGTHS))


def titles(s, d):
    """(seq_id, number, title, domain): each ten units of a document are a section."""
    u = T.text_units(s, d).withColumn("number", F.floor(F.col("pos") / 10) + 1)
    g = u.groupBy("seq_id", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("t"))
    return g.select("seq_id", "number", scalars.section_title(F.col("t"), F.col("number")).alias("title"), scalars.voted_domain(F.array_join(F.slice("t", 1, 6), " ")).alias("domain"))


def seven(s, d):
    """The gap features with a pause and a shot score beside them."""
    from .q_more import gap_features

    both = ["seq_id", "boundary"]
    pause, shot = Q.signal(s, d, ((F.col("pos") * 37) % 11) / 10.0), Q.signal(s, d, (F.col("pos") % 7 == 0).cast("double"))
    return gap_features(s, d).join(pause.withColumnRenamed("score", "pause"), both).join(shot.withColumnRenamed("score", "shot"), both)


def subtopics(s, d):
    """(method, n, pk, wd, f1_t1, f1_t2, f1_t3, f1_t5): methods asked for as many segments as there are subtopics, against these; means to four digits, best first."""
    from . import combinations

    u = T.two_models(s, d)
    refs = T.references(T.vectors(s, d))
    k = refs.groupBy("seq_id").agg(F.greatest(F.lit(2), F.count("*").cast("int")).alias("k"))
    z, methods = T.sizes(u).join(k, "seq_id").select("seq_id", "n"), ["cross_e5_frac70_minlen11", "cross_e5_frac70_minlen10", "divisive", "two_stage", "hierarchical"]
    key = F.struct("seq_id", "method").alias("seq_id")
    every = lambda df, c: df.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method")).select(key, c)
    hyp = combinations.run_methods(u, k, methods).select(key, "boundary")
    m = metrics.evaluate(hyp, every(refs, "boundary"), every(z, "n"), (1, 2, 3, 5))
    means = m.groupBy(F.col("seq_id.method").alias("method")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("pk", "wd", "f1_t1", "f1_t2", "f1_t3", "f1_t5")))
    return rounded(means)


QUERIES = {
    "count_heuristics": lambda s, d: rounded(counts(s, d)),
    "section_titles": lambda s, d: rounded(titles(s, d)),
    "gap_features_seven": lambda s, d: rounded(seven(s, d)),
    "subtopic_evaluation": subtopics,
    "weight_search": weights,
    "fusion_grid": fusion,
    "candidate_ranker": lambda s, d: rounded(ranker(s, d)),
    "candidate_ranker_search": ranker_search,
    "score_peaks": lambda s, d: rounded(folds.peaks(fixed(gaps.gap_one_sided(T.vectors(s, d), 3)).withColumn("score", F.round("score", 1)), 4, 7)),
    "assign_vectors": lambda s, d: rounded(vectors_of_windows(s, d)),
    "segment_function": lambda s, d: rounded(segment_function(s, d)),
}

WINDOWS_SQL = f"win AS (SELECT seq_id, p AS pos, p * {SPAN} + p % 3 * 7 AS s, (p + 1) * {SPAN} - p % 2 * 9 AS e FROM (SELECT DISTINCT seq_id FROM vectors), range({WINDOWS}) t(p))"
SQL = {
    "score_peaks": f"""WITH {ONE}, s AS (SELECT seq_id, boundary, round(score, 1) + 0.0 AS score FROM one),
c AS (SELECT *, CASE WHEN score = lag(score) OVER q THEN 0 ELSE 1 END AS new, row_number() OVER q AS ix FROM s WINDOW q AS (PARTITION BY seq_id ORDER BY boundary)),
g AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY boundary) AS run FROM c), t AS (SELECT seq_id, run, any_value(score) AS score, min(ix) AS a, max(ix) AS z FROM g GROUP BY seq_id, run),
m AS (SELECT *, score > lag(score) OVER q AND score > lead(score) OVER q AS top FROM t WINDOW q AS (PARTITION BY seq_id ORDER BY run)),
p AS (SELECT m.seq_id, g.boundary, m.score FROM m JOIN g ON g.seq_id = m.seq_id AND g.ix = (m.a + m.z) // 2 WHERE top),
o AS (SELECT seq_id, list(boundary::INT ORDER BY score DESC, boundary DESC) AS b FROM p GROUP BY seq_id),
k AS (SELECT seq_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 4)) = 0 THEN list_append(acc, x[1]) ELSE acc END, []::INT[])) AS boundary FROM o)
SELECT seq_id, boundary::BIGINT AS boundary, score FROM k JOIN p USING (seq_id, boundary) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary DESC) <= 7""",
    "assign_vectors": f"""{T.with_("vectors")}, {WINDOWS_SQL}, f AS (SELECT seq_id, pos AS id, pos * {STEP} + 3 AS us, vec FROM vectors),
near AS (SELECT f.seq_id, f.id, arg_min(w.pos, (CASE WHEN s <= us AND us < e THEN 0 ELSE 1 END, CASE WHEN s <= us AND us < e THEN 0 ELSE abs(s + e - 2 * us) END, w.pos)) AS pos FROM f JOIN win w USING (seq_id) GROUP BY f.seq_id, f.id),
x AS (SELECT near.seq_id, near.pos, i - 1 AS i, count(*) AS n, avg(vec[i]) AS mean, max(vec[i]) AS most FROM near JOIN f USING (seq_id, id), range(1, 65) t(i) GROUP BY ALL)
SELECT win.seq_id, win.pos::BIGINT AS pos, coalesce(n, 0) AS n_marks, r.i::BIGINT AS i, round(coalesce(mean, 0), 6) + 0.0 AS mean, round(greatest(0, coalesce(most, 0)), 6) + 0.0 AS max
FROM win JOIN range(64) r(i) ON true LEFT JOIN x ON x.seq_id = win.seq_id AND x.pos = win.pos AND x.i = r.i""",
}

from . import q_segment  # noqa: E402
from .q_metrics import counted  # noqa: E402


def weights_sql() -> str:
    """The points as values, their scores, greedy choices and metrics."""
    ok = "len(acc) < c AND len(list_filter(acc, lambda y: abs(y - x[1]) <= w OR abs(y - x[1]) < m)) = 0 AND x[1] >= m AND n - x[1] >= m"
    points = ", ".join(f"({p}, [{', '.join(f'{x!r}::DOUBLE' for x in w)}], {f}::DOUBLE, {m}, {near})" for p, w, f, m, near in WEIGHTS)
    total = " + ".join(f"wt[{i}] * x_{c}" for i, c in enumerate(search.SIGNALS, 1))
    return f"""{Q.TABLE}, sg AS (SELECT seq_id, boundary, {", ".join(f"{Q.MM.format(c=c)} AS x_{c}" for c in search.SIGNALS)} FROM feat WINDOW q AS (PARTITION BY seq_id)),
pt(point, wt, f, m, w) AS (VALUES {points}), key AS (SELECT seq_id, n, t, point, wt, greatest(1, round_even(t * f, 0)) AS c, m, w, seq_id::VARCHAR || ':' || point AS id FROM sizes JOIN t USING (seq_id), pt),
o AS (SELECT id, n, c, m, w, list(boundary::INT ORDER BY round({total}, 9) DESC, boundary) AS b FROM sg JOIN key USING (seq_id) GROUP BY ALL),
h AS (SELECT id AS seq_id, unnest(list_reduce(list_transform(b, lambda x: [x]), lambda acc, x: CASE WHEN {ok} THEN list_append(acc, x[1]) ELSE acc END, []::INT[])) AS boundary FROM o),
rr AS (SELECT id AS seq_id, boundary FROM refs JOIN key USING (seq_id)), zz AS (SELECT id AS seq_id, n FROM key), {counted("h", "rr", "x").replace("FROM sizes LEFT JOIN", "FROM zz LEFT JOIN")}
SELECT split_part(seq_id, ':', 2)::BIGINT AS point, count(*) AS n, round(avg(pk), 6) + 0.0 AS pk, round(avg(wd), 6) + 0.0 AS wd FROM mx GROUP BY 1"""


SQL["weight_search"] = weights_sql()

SQL["segment_function"] = q_segment.SQL["divisive"]

WORDS = r"list_filter(string_split_regex(trim({t}), '\s+'), lambda w: w <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in scalars.STOP_WORDS) + "]"
SQL["count_heuristics"] = rf"""{T.with_("units")}, g AS (SELECT seq_id, count(*) AS n, sum(len(string_split_regex(text, '\s+'))) / 2 AS seconds FROM units GROUP BY seq_id)
SELECT seq_id, n, greatest(2, n // 40)::BIGINT AS chapters, greatest(3, n // 20)::BIGINT AS subtopics, """ + ", ".join(
    f"least(25, greatest(2, round_even(round(0.65::DOUBLE * greatest(2, round_even(greatest(seconds, 1) / {a}, 0) + 1) + 0.35::DOUBLE * greatest(2, round_even(greatest(n, 1) / {b}, 0) + 1), 9), 0)))::BIGINT AS {x}" for x, (a, b) in scalars.LENGTHS.items()
) + " FROM g"
SQL["section_titles"] = rf"""{T.with_("units")}, w AS (SELECT seq_id, pos // 10 + 1 AS number, pos, text FROM units), g AS (SELECT seq_id, number, list(text ORDER BY pos)[1:6] AS t FROM w GROUP BY seq_id, number),
k AS (SELECT seq_id, number, t, list_transform(t, lambda x: struct_pack(n := len({WORDS.format(t="x")}), w := list_filter({WORDS.format(t="string_split_regex(trim(x), '[,;.!?]')[1]")}, lambda w: NOT list_contains({STOP}, lower(w)) AND length(w) > 2))) AS c FROM g),
j AS (SELECT seq_id, number, t, list_filter(list_transform(c, lambda x: CASE WHEN x.n >= 4 AND len(x.w) >= 3 THEN upper(left(array_to_string(x.w[1:6], ' '), 1)) || lower(substr(array_to_string(x.w[1:6], ' '), 2)) END), lambda x: x IS NOT NULL AND length(x) >= 15) AS f FROM k),
b AS (SELECT seq_id, number, lower(array_to_string(t, ' ')) AS low, list_filter(f, lambda x: least(length(x), 50) = list_max(list_transform(f, lambda y: least(length(y), 50))))[1] AS best FROM j),
v AS (SELECT *, [{", ".join("(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")" for words in scalars.DOMAIN_WORDS.values())}] AS votes FROM b)
SELECT seq_id, number::BIGINT AS number, CASE WHEN best IS NULL THEN 'Section ' || number ELSE left(best, 52) || CASE WHEN length(best) > 52 THEN '…' ELSE '' END END AS title,
CASE WHEN list_max(votes) > 0 THEN [{", ".join(f"'{x}'" for x in scalars.DOMAIN_WORDS)}][list_position(votes, list_max(votes))] ELSE 'General' END AS domain FROM v"""

from .q_more import SQL as MORE  # noqa: E402

SQL["gap_features_seven"] = f"SELECT g.*, ((boundary * 37) % 11) / 10.0::DOUBLE AS pause, (boundary % 7 = 0)::INT::DOUBLE AS shot FROM ({MORE['gap_features']}) g"
