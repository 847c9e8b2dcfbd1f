"""Queries of learning, roll-ups over the star schema and sessions, with SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps, learning, text
from ..sources import tables as T
from ..streaming import sessions
from .common import fixed, rounded
from .q_portfolio import cube

FEATURES = ["gap1", "gap3", "gap5", "drop", "place"]


def gap_features(s, d):
    """(seq_id, boundary, gap1, gap3, gap5, drop, place, y): features of each gap and whether a reference boundary is there."""
    u = T.vectors(s, d)
    one = lambda df, n: fixed(df).withColumnRenamed("score", n)
    rows = one(gaps.gap_adjacent(u), "gap1").join(one(gaps.gap_one_sided(u, 3), "gap3"), ["seq_id", "boundary"]).join(one(gaps.gap_one_sided(u, 5), "gap5"), ["seq_id", "boundary"])
    rows = rows.join(T.sizes(u), "seq_id").withColumn("place", F.col("boundary") / F.col("n"))
    rows = rows.withColumn("drop", F.col("gap1") - F.avg("gap1").over(gaps.along().rowsBetween(-2, 2)))
    marks = T.references(u).withColumn("y", F.lit(1.0))
    return rows.join(marks, ["seq_id", "boundary"], "left").withColumn("y", F.coalesce("y", F.lit(0.0))).drop("n")


def classifier(kind):
    def run(s, d):
        rows = learning.balanced_weights(gap_features(s, d), "y")
        got = learning.by_fold(rows, FEATURES, "y", kind, 3, weight="weight")
        return rounded(got.select("seq_id", "boundary", "y", "prediction"))

    return run


COLUMNS = ["n", "spread", "kinds"]


def sequence_features(s, d):
    f = T.events(s, d).groupBy("seq_id").agg(F.count("*").cast("double").alias("n"), F.stddev_pop("value").alias("spread"), F.countDistinct("event_type").cast("double").alias("kinds"))
    return f.withColumn("domain", F.col("seq_id") % 5)


def good(s, d):
    return cube(s, d).where("error is null")


def forest(s, d):
    return rounded(learning.select_methods(sequence_features(s, d), COLUMNS, good(s, d), "forest", folds=3))


def revenue(s, d):
    """Domain dimension over the star schema: broadcast joins of the small dimensions, one aggregation with its roll-up."""
    t = lambda n: T.read(s, d, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(o.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total")), 2)


QUERIES = {
    "gap_features": lambda s, d: rounded(gap_features(s, d)),
    "gap_classifier": classifier("logistic"),
    "gap_classifier_boosted": classifier("boosted"),
    "method_selector_forest": forest,
    "region_rollup": revenue,
    "pause_sessions": lambda s, d: rounded(sessions.sessions(T.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")),
    "hashed_vectors": lambda s, d: rounded(text.hashed_vectors(T.turns(s, d), 8).select("seq_id", "pos", F.col("vec")[0].alias("v0"), F.col("vec")[7].alias("v7"))),
    "similarity_variance": lambda s, d: rounded(fixed(gaps.gap_adjacent(T.vectors(s, d))).groupBy((F.col("seq_id") % 5).alias("domain")).agg(F.avg(1 - F.col("score")).alias("mean"), F.var_pop("score").alias("variance"))),
    "method_pivot": lambda s, d: rounded(cube(s, d).groupBy("seq_id").pivot("method", ["dp", "divisive", "iterative"]).agg(F.first("pk"))),
    "vote_counts": lambda s, d: rounded(votes(s, d)),
}


def votes(s, d):
    """(seq_id, boundary, votes, models): two votes for a top gap of the first model, one for the second, and how many models agree."""
    u = T.two_models(s, d)
    from ..operators.select import top_k

    a = top_k(fixed(gaps.gap_one_sided(u.select("seq_id", "pos", F.col("vec1").alias("vec")), 3)), 20)
    b = top_k(fixed(gaps.gap_one_sided(u.select("seq_id", "pos", F.col("vec2").alias("vec")), 3)), 20)
    rows = a.select("seq_id", "boundary", F.lit(2).alias("w"), F.lit(1).alias("m")).union(b.select("seq_id", "boundary", F.lit(1), F.lit(2)))
    return rows.groupBy("seq_id", "boundary").agg(F.sum("w").alias("votes"), F.count_distinct("m").alias("models"))


from .q_align import HALVES  # noqa: E402
from .q_gaps import ADJ, ONE, two_sided_sql  # noqa: E402
from .q_portfolio import CUBE  # noqa: E402

FIVE = f"five AS ({two_sided_sql(-5, -1, 0, 4, '1 - list_cosine_similarity(a, b)')})"
SQL = {
    "gap_features": f"""WITH {ONE}, {ADJ}, {FIVE}, {T.SQL["vectors"]}, {T.SQL["refs"]}, {T.SQL["sizes"]},
r AS (SELECT a.seq_id, a.boundary, a.score AS gap1, o.score AS gap3, f.score AS gap5, a.boundary / n AS place, a.score - avg(a.score) OVER (PARTITION BY a.seq_id ORDER BY a.boundary ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d
  FROM adj a JOIN one o USING (seq_id, boundary) JOIN five f USING (seq_id, boundary) JOIN sizes USING (seq_id))
SELECT r.seq_id, r.boundary, gap1, gap3, gap5, round(place, 6) + 0.0 AS place, round(d, 6) + 0.0 AS "drop", CASE WHEN refs.boundary IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS y FROM r LEFT JOIN refs USING (seq_id, boundary)""",
    "region_rollup": "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice::DOUBLE), 2) + 0.0 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "pause_sessions": "WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, s",
    "similarity_variance": f"WITH {ADJ} SELECT seq_id % 5 AS domain, round(avg(1 - score), 6) + 0.0 AS mean, round(var_pop(score), 6) + 0.0 AS variance FROM adj GROUP BY 1",
    "method_pivot": f"{CUBE} SELECT seq_id, " + ", ".join(f"max(pk) FILTER (method = '{m}') AS {m}" for m in ("dp", "divisive", "iterative")) + " FROM raw GROUP BY seq_id",
    "vote_counts": f"WITH {HALVES} SELECT seq_id, boundary, sum(w)::BIGINT AS votes, count(DISTINCT m) AS models FROM (SELECT seq_id, boundary, 2 AS w, 1 AS m FROM m1 UNION ALL SELECT seq_id, boundary, 1, 2 FROM m2) GROUP BY 1, 2",
}
