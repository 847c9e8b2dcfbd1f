"""Queries of text, time and page operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import folds, gaps, text
from ..sources import tables as T
from .common import fixed, rounded
from .q_metrics import far, fold_sql


def tokens(s, d):
    t = T.turns(s, d)
    return rounded(t.select("seq_id", "pos", F.size(X.words(F.col("text"))).alias("n_words"), F.size(X.token_set(F.col("text"))).alias("n_set"), F.array_join(F.slice(X.words(F.col("text")), 1, 5), " ").alias("head")))


def time_text(s, d):
    e = T.events(s, d).withColumn("sec", (F.col("us") / 1_000_000).cast("long") % 90_000)
    stamp = X.stamp_of(F.col("sec"))
    return rounded(e.select("event_id", stamp.alias("stamp"), X.seconds_of(stamp).alias("back")))


def page_parts(s, d):
    p = T.read(s, d, "pages")
    return rounded(p.select("page_id", F.length(text.tagless(F.col("html"))).alias("n_chars"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), X.with_param(F.col("url"), "t", F.lit("9")).alias("url_t")))


def arrays(s, d):
    v = T.vectors(s, d)
    b = v.where("pos > 0 and label in (0, 1)").groupBy("seq_id").agg(F.collect_list("pos").alias("b"))
    rows = T.sizes(v).join(b, "seq_id").withColumn("b", X.clean_boundaries(F.col("b"), F.col("n")))
    mass = X.masses(F.col("b"), F.col("n"))
    return rounded(rows.select("seq_id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("bounds"), F.array_join(F.transform(mass, lambda x: x.cast("string")), ",").alias("masses"), F.aggregate(X.indicator(F.col("b"), F.col("n")), F.lit(0), lambda a, x: a + x).alias("n_marks"), F.size(X.spans(F.col("b"), F.col("n"))).alias("n_spans")))


def speech(s, d):
    """Turns with a phrase of the fixed patterns in front of every ninth, as the invented texts have none."""
    said = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("pos") % len(PHRASES) + 1).cast("int"))
    return T.turns(s, d).withColumn("text", F.when((F.col("seq_id") + F.col("pos")) % 9 == 0, F.concat(said, F.lit(" "), "text")).otherwise(F.col("text")))


def discourse(s, d):
    return rounded(text.discourse(speech(s, d)))


def boosted(s, d):
    u = T.vectors(s, d)
    marked = u.where("pos % 9 = 0 and pos > 0").select("seq_id", "pos")
    scores = fixed(text.discourse_boosted(fixed(gaps.gap_one_sided(u, 3)), marked, T.sizes(u)))
    return rounded(folds.pick_spaced(scores, T.sizes(u), 7, 4))


PHRASES = ["Now let's look at", "The next topic is", "Moving on to", "To summarize,", "We've seen", "Okay, today", "Part two:", "Let me explain", "Nothing here"]
QUERIES = {
    "discourse_boosted": boosted,
    "transition_features_turns": lambda s, d: rounded(text.transition_features(speech(s, d))),
    "word_tokens": tokens,
    "tf_cosine": lambda s, d: rounded(text.tf_cosine(T.text_units(s, d))),
    "jaccard_novelty": lambda s, d: rounded(text.jaccard_novelty(T.text_units(s, d))),
    "transition_features": lambda s, d: rounded(text.transition_features(T.text_units(s, d))),
    "discourse_markers": discourse,
    "accumulate_words": lambda s, d: rounded(text.accumulate(T.text_units(s, d)).select("seq_id", "piece", "first", "last", "n_words")),
    "time_text": time_text,
    "page_parts": page_parts,
    "boundary_arrays": arrays,
    "text_units": lambda s, d: rounded(T.text_units(s, d).select("seq_id", "pos", F.length("text").alias("n_chars"))),
}

WORDS = "regexp_extract_all(lower({}), '([a-z'']+)', 1)"
SET = "list_distinct(list_filter(" + WORDS + ", lambda w: len(w) > 2))"
PAIR = f"""{T.with_("units")}, t AS (SELECT seq_id, pos, text, {WORDS.format("text")} AS w, {SET.format("text")} AS s FROM units),
p AS (SELECT *, lag(w) OVER q AS pw, lag(s) OVER q AS ps, count(*) OVER (PARTITION BY seq_id) AS n FROM t WINDOW q AS (PARTITION BY seq_id ORDER BY pos)),
j AS (SELECT *, len(list_intersect(s, ps)) AS i, len(s) + len(ps) - len(list_intersect(s, ps)) AS u FROM p WHERE pos > 0)"""
quote = lambda x: "'" + x.replace("'", "''") + "'"
SPEECH = f"SELECT seq_id, pos, CASE WHEN (seq_id + pos) % 9 = 0 THEN [{', '.join(quote(x) for x in PHRASES)}][pos % {len(PHRASES)} + 1] || ' ' || text ELSE text END AS text FROM turns"


def transitions(relations: str) -> str:
    """The ten features over units of a WITH list."""
    tokens = r"list_distinct(list_filter(list_transform(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_''-]*)', 1), lambda w: lower(w)), lambda w: len(w) > 2))"
    many = lambda t, words: "(" + " + ".join(f"contains({t}, {quote(w)})::INT" for w in words) + ")"
    return f"""{relations}, t AS (SELECT seq_id, pos, text, {tokens} AS s, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS c FROM units),
w AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n, lag(text) OVER o AS pt, lag(c) OVER o AS pc, list_distinct(flatten(list(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))) AS l,
  list_distinct(flatten(list(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))) AS r FROM t WINDOW o AS (PARTITION BY seq_id ORDER BY pos)),
x AS (SELECT *, len(list_intersect(l, r)) AS i, lower(left(text, 160)) AS h, lower(right(pt, 220) || ' ' || left(text, 220)) AS a, lower(left(text, 220)) AS h2 FROM w WHERE pos > 0)
SELECT seq_id, pos::BIGINT AS boundary, ({" OR ".join(f"starts_with(lower(trim(text)), {quote(o)})" for o in text.OPENERS)})::INT::DOUBLE AS opener, round({many("h", text.OPENERS)} / 3, 6) + 0.0 AS openers,
round({many("a", text.RECAPS)} / 2, 6) + 0.0 AS recaps, round({many("h2", text.TITLES)} / 2, 6) + 0.0 AS titles, round(1 - i / greatest(1, len(l) + len(r) - i), 6) + 0.0 AS novelty, round((len(r) - i) / greatest(1, len(r)), 6) + 0.0 AS new_right,
round((len(l) - i) / greatest(1, len(l)), 6) + 0.0 AS left_only, round(abs(c - pc) / greatest(1, c + pc), 6) + 0.0 AS length_ratio, round(ln(1 + pos), 6) + 0.0 AS log_before, round(ln(1 + n - pos), 6) + 0.0 AS log_after FROM x"""


SQL = {
    "word_tokens": f"{T.with_('turns')} SELECT seq_id, pos::BIGINT AS pos, len({WORDS.format('text')})::BIGINT AS n_words, len({SET.format('text')})::BIGINT AS n_set, array_to_string({WORDS.format('text')}[1:5], ' ') AS head FROM turns",
    "tf_cosine": f"""{T.with_("units")}, t AS (SELECT seq_id, pos, term, count(*) AS c FROM (SELECT seq_id, pos, unnest({WORDS.format("text")}) AS term FROM units) GROUP BY seq_id, pos, term),
n AS (SELECT seq_id, pos, sqrt(sum(c * c)) AS norm FROM t GROUP BY seq_id, pos), d AS (SELECT a.seq_id, a.pos, sum(a.c * b.c) AS dot FROM t a JOIN t b ON a.seq_id = b.seq_id AND a.pos = b.pos + 1 AND a.term = b.term GROUP BY a.seq_id, a.pos)
SELECT u.seq_id, u.pos::BIGINT AS boundary, round(coalesce(dot / (n1.norm * n2.norm), 0), 6) + 0.0 AS similarity FROM units u LEFT JOIN d USING (seq_id, pos) LEFT JOIN n n1 USING (seq_id, pos) LEFT JOIN n n2 ON n2.seq_id = u.seq_id AND n2.pos = u.pos - 1 WHERE u.pos > 0""",
    "jaccard_novelty": f"{PAIR} SELECT seq_id, pos::BIGINT AS boundary, round(1 - CASE WHEN u > 0 THEN i::DOUBLE / u ELSE 0 END, 6) + 0.0 AS novelty FROM j",
    "transition_features": transitions(T.with_("units")),
    "transition_features_turns": transitions(f"{T.with_('turns')}, units AS ({SPEECH})"),
    "discourse_markers": f"{T.with_('turns')}, u AS ({SPEECH}) SELECT * FROM (SELECT seq_id, pos::BIGINT AS pos, CASE "
    + " ".join(f"WHEN regexp_matches(trim(text), {quote('(?i)' + r)}) THEN {i}" for i, r in enumerate(text.PATTERNS))
    + " END::BIGINT AS pattern FROM u) WHERE pattern IS NOT NULL",
    "discourse_boosted": fold_sql(f"{far(4)} AND len(acc) < 7", "WHERE boundary >= 4 AND boundary <= n - 4").replace("FROM one JOIN", "FROM (SELECT seq_id, boundary, round(score + CASE WHEN boundary % 9 = 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM one) JOIN"),
    "accumulate_words": f"""WITH RECURSIVE {T.SQL["units"]}, n AS (SELECT seq_id, pos, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM units),
r AS (SELECT seq_id, pos, 0 AS piece, n AS total FROM n WHERE pos = 0
  UNION ALL SELECT n.seq_id, n.pos, CASE WHEN r.total >= 25 THEN r.piece + 1 ELSE r.piece END, CASE WHEN r.total >= 25 THEN n.n ELSE r.total + n.n END FROM r JOIN n ON n.seq_id = r.seq_id AND n.pos = r.pos + 1)
SELECT seq_id, piece::BIGINT AS piece, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, max(total)::BIGINT AS n_words FROM r GROUP BY seq_id, piece""",
    "time_text": f"""{T.with_("ev")}, t AS (SELECT event_id, (us // 1000000) % 90000 AS s FROM ev)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp, s::DOUBLE AS back FROM t""",
    "page_parts": r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars,
regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN regexp_matches(url, '[?&]t=') THEN regexp_replace(url, '([?&])t=[^&#]*', '\1t=9', 'g') ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=9' END AS url_t FROM pages""",
    "boundary_arrays": f"""{T.with_("vectors", "refs", "sizes")}, b AS (SELECT seq_id, list(boundary ORDER BY boundary) AS b FROM refs GROUP BY seq_id), x AS (SELECT seq_id, n, b, list_concat([0], b) AS lo, list_append(b, n) AS hi FROM b JOIN sizes USING (seq_id))
SELECT seq_id, array_to_string(b, ',') AS bounds, array_to_string(list_transform(list_zip(lo, hi), lambda z: z[2] - z[1]), ',') AS masses, len(b)::BIGINT AS n_marks, (len(b) + 1)::BIGINT AS n_spans FROM x""",
    "text_units": f"{T.with_('units')} SELECT seq_id, pos::BIGINT AS pos, length(text) AS n_chars FROM units",
}
