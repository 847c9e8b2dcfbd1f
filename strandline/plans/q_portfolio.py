"""Queries of statistics, portfolios and learning, with their SQL. The result cube is made from events: a type stands for a method, a user for a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio, stats
from ..sources import tables as T
from .common import rounded

TYPES = {"click": "cross_rank", "error": "cross_mean", "purchase": "divisive", "signup": "iterative", "view": "dp"}


def cube(s, d):
    """(method, seq_id, pk, wd, f1, error). Every eleventh sequence fails in one method."""
    name = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    e = T.events(s, d).groupBy(F.element_at(name, F.col("event_type")).alias("method"), "seq_id").agg(F.avg("value").alias("pk"), F.max("value").alias("wd"), F.min("value").alias("f1"))
    r = lambda c: F.round(c, 6)
    return e.select("method", "seq_id", r("pk").alias("pk"), r("wd").alias("wd"), r("f1").alias("f1"), F.when((F.col("seq_id") % 11 == 0) & (F.col("method") == "dp"), "timeout").alias("error"))


def domains(s, d):
    return T.events(s, d).select("seq_id", (F.col("seq_id") % 5).alias("domain")).distinct()


def paired(s, d):
    c = cube(s, d).where("error is null")
    a, b = c.where("method = 'dp'").select("seq_id", F.col("pk").alias("a")), c.where("method = 'divisive'").select("seq_id", F.col("pk").alias("b"))
    return a.join(b, "seq_id").join(domains(s, d), "seq_id")


def families(s, d):
    c = cube(s, d).select("method").distinct()
    return rounded(c.select("method", portfolio.family(F.col("method")).alias("family")))


def audit(s, d):
    c = cube(s, d)
    return rounded(portfolio.choice_audit(portfolio.leave_one_out(c), c.where("method = 'dp' and error is null").select("seq_id", "method", "pk")))


QUERIES = {
    "method_means": lambda s, d: rounded(portfolio.means(cube(s, d))),
    "method_means_zero": lambda s, d: rounded(portfolio.means_missing_zero(cube(s, d), T.events(s, d))),
    "portfolio_best": lambda s, d: rounded(portfolio.best_global(cube(s, d))),
    "portfolio_balanced": lambda s, d: rounded(portfolio.balanced(cube(s, d))),
    "portfolio_oracle": lambda s, d: rounded(portfolio.oracle(cube(s, d))),
    "portfolio_loo": lambda s, d: rounded(portfolio.leave_one_out(cube(s, d))),
    "shortlist": lambda s, d: rounded(portfolio.shortlist(cube(s, d))),
    "pareto": lambda s, d: rounded(portfolio.pareto(portfolio.means(cube(s, d)))),
    "domain_rollup": lambda s, d: rounded(portfolio.domain_rollup(cube(s, d), domains(s, d))),
    "leave_domain_out": lambda s, d: rounded(portfolio.leave_domain_out(cube(s, d), domains(s, d))),
    "method_family": families,
    "choice_audit": audit,
    "registry_rank": lambda s, d: rounded(portfolio.registry_rank(cube(s, d))),
    "union_renamed": lambda s, d: rounded(portfolio.union_renamed([("first", cube(s, d).where("method in ('dp', 'divisive')")), ("second", cube(s, d))]).select("method", "seq_id", "pk")),
    "video_features": lambda s, d: rounded(portfolio.video_features(T.text_units(s, d))),
    "training_pairs": lambda s, d: rounded(portfolio.training_pairs(T.vectors(s, d), T.references(T.vectors(s, d)))),
    "wilcoxon": lambda s, d: rounded(stats.wilcoxon(paired(s, d), ["domain"])),
    "bootstrap_ci": lambda s, d: rounded(stats.bootstrap(cube(s, d).where("error is null"), ["method"], "seq_id", "pk")),
    "win_loss": lambda s, d: rounded(stats.compare_methods(cube(s, d), "dp", "divisive", "pk")),
    "value_summary": lambda s, d: rounded(stats.summary(T.events(s, d), ["event_type"], "value")),
}

CUBE = f"""{T.with_("ev")}, raw AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())} END AS method, seq_id, round(avg(value), 6) AS pk, round(max(value), 6) AS wd, round(min(value), 6) AS f1 FROM ev GROUP BY 1, 2),
cube AS (SELECT * FROM raw WHERE NOT (seq_id % 11 = 0 AND method = 'dp')), means AS (SELECT method, count(*) AS n, avg(pk) AS pk, avg(wd) AS wd, avg(f1) AS f1 FROM cube GROUP BY method)"""
R = lambda *c: ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in c)
LOO = """o AS (SELECT *, count(*) OVER w AS n, round((sum(pk) OVER w - pk) / (count(*) OVER w - 1), 9) AS p2, round((sum(wd) OVER w - wd) / (count(*) OVER w - 1), 9) AS w2 FROM cube WINDOW w AS (PARTITION BY method)),
loo AS (SELECT seq_id, method, pk, wd FROM o WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY p2, w2, method) = 1)"""
PHI = "(1 - exp(-0.5 * z * z) / sqrt(2 * 3.141592653589793) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))))"


def wilcoxon_sql(by: str) -> str:
    return f"""d AS (SELECT *, round(b - a, 9) AS d, abs(round(b - a, 9)) AS m FROM pairs WHERE round(b - a, 9) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY m) + (count(*) OVER (PARTITION BY {by}, m) - 1) / 2.0 AS r FROM d),
g AS (SELECT {by}, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY {by}),
z AS (SELECT *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) AS z FROM g), q AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
wx AS (SELECT {by}, n, w::DOUBLE AS w, z, round(2 * (1 - {PHI}), 4) AS p FROM q)"""


PAIRS = "pairs AS (SELECT a.seq_id, a.pk AS a, b.pk AS b, a.seq_id % 5 AS domain, 1 AS one FROM cube a JOIN cube b USING (seq_id) WHERE a.method = 'dp' AND b.method = 'divisive')"

SQL = {
    "method_means": f"{CUBE} SELECT method, n, {R('pk', 'wd', 'f1')} FROM means",
    "method_means_zero": f"{CUBE}, n AS (SELECT count(DISTINCT seq_id) AS n FROM ev), s AS (SELECT method, sum(pk) / n AS pk, sum(wd) / n AS wd, sum(f1) / n AS f1 FROM cube, n GROUP BY method, n) SELECT method, {R('pk', 'wd', 'f1')} FROM s",
    "portfolio_best": f"{CUBE} SELECT method, n, {R('pk', 'wd', 'f1')} FROM means ORDER BY means.pk, means.wd, method LIMIT 1",
    "portfolio_balanced": f"{CUBE}, b AS (SELECT *, (pk + wd) / 2 AS balance FROM means) SELECT method, n, {R('pk', 'wd', 'f1', 'balance')} FROM b ORDER BY b.balance, b.pk, method LIMIT 1",
    "portfolio_oracle": f"{CUBE} SELECT seq_id, method, {R('pk', 'wd')} FROM (SELECT * FROM cube QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY pk, wd, method) = 1)",
    "portfolio_loo": f"{CUBE}, {LOO} SELECT seq_id, method, {R('pk', 'wd')} FROM loo",
    "shortlist": f"{CUBE}, l AS (SELECT greatest(3, round_even(0.8 * count(DISTINCT seq_id), 0)) AS least FROM cube) SELECT method, n, {R('pk', 'wd')} FROM means, l WHERE n >= least ORDER BY means.pk, means.wd, method LIMIT 25",
    "pareto": f"{CUBE} SELECT a.method, count(b.method) AS dominated_by FROM means a LEFT JOIN means b ON b.pk <= a.pk AND b.wd <= a.wd AND b.f1 >= a.f1 AND (b.pk < a.pk OR b.wd < a.wd OR b.f1 > a.f1) GROUP BY a.method",
    "domain_rollup": f"{CUBE}, x AS (SELECT seq_id % 5 AS domain, * FROM cube), g AS (SELECT domain, method, count(*) AS n, avg(pk) AS pk, avg(wd) AS wd FROM x GROUP BY ROLLUP (domain, method)) SELECT domain, method, n, {R('pk', 'wd')} FROM g",
    "leave_domain_out": f"""{CUBE}, x AS (SELECT seq_id % 5 AS domain, method, sum(pk) AS s, sum(wd) AS s2, count(*) AS n FROM cube GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER w - n AS r, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 9) AS p2, round((sum(s2) OVER w - s2) / (sum(n) OVER w - n), 9) AS w2 FROM x WINDOW w AS (PARTITION BY method)),
b AS (SELECT domain, method, s / n AS pk FROM y WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY p2, w2, method) = 1) SELECT domain, method, {R("pk")} FROM b""",
    "method_family": f"{CUBE} SELECT DISTINCT method, CASE WHEN starts_with(method, 'cross_rank') THEN 'rank vote' WHEN starts_with(method, 'cross') THEN 'cross-model' WHEN starts_with(method, 'iterative') THEN 'iterative' WHEN starts_with(method, 'triple') THEN 'ensemble' WHEN starts_with(method, 'divisive') THEN 'divisive' WHEN starts_with(method, 'depth') THEN 'depth' WHEN starts_with(method, 'dp') THEN 'optimal' ELSE 'other' END AS family FROM raw",
    "choice_audit": f"{CUBE}, {LOO} SELECT l.method, count(*) AS n, count(*) FILTER (l.method <> 'dp') AS n_switched, round(avg(l.pk - c.pk), 6) + 0.0 AS mean_delta FROM loo l JOIN cube c ON c.seq_id = l.seq_id AND c.method = 'dp' GROUP BY l.method",
    "registry_rank": f"{CUBE} SELECT method, rank() OVER (ORDER BY pk) AS rank, round(pk, 6) + 0.0 AS pk, round(pk - min(pk) OVER (), 6) + 0.0 AS gap FROM means",
    "union_renamed": f"{CUBE}, f AS (SELECT * FROM raw WHERE method IN ('dp', 'divisive')) SELECT method, seq_id, {R('pk')} FROM f UNION ALL SELECT CASE WHEN method IN (SELECT method FROM f) THEN 'second::' || method ELSE method END, seq_id, {R('pk')} FROM raw",
    "video_features": f"""{T.with_("units")}, u AS (SELECT seq_id, text, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM units), g AS (SELECT seq_id, count(*) AS n_units, ln(1 + count(*)) AS log_units, sum(n)::BIGINT AS n_words, avg(n) AS mean_words, stddev_pop(n) AS std_words, sum(n) / sum(length(text)) AS density FROM u GROUP BY seq_id)
SELECT seq_id, n_units, n_words, {R("log_units", "mean_words", "std_words", "density")} FROM g""",
    "training_pairs": f"""{T.with_("vectors", "refs")}, u AS (SELECT v.seq_id, v.pos, (r.boundary IS NOT NULL)::INT AS b FROM vectors v LEFT JOIN refs r ON r.seq_id = v.seq_id AND r.boundary = v.pos),
s AS (SELECT *, sum(b) OVER w AS seg, lag(pos) OVER w AS prev FROM u WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT seq_id, prev::BIGINT AS a, pos::BIGINT AS b, (1 - s.b)::BIGINT AS label FROM s WHERE prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id, seg, s.b ORDER BY pos) <= 3""",
    "wilcoxon": f"{CUBE}, {PAIRS}, {wilcoxon_sql('domain')} SELECT domain, n, {R('w', 'z', 'p')} FROM wx",
    "bootstrap_ci": f"""{CUBE}, x AS (SELECT method, pk, row_number() OVER (PARTITION BY method ORDER BY seq_id) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM cube),
dr AS (SELECT method, r, ((((r * 7919 + i * 104729 + 12345) * 48271) % 2147483647) % n) AS i FROM x, range(200) t(r)), ms AS (SELECT method, r, round(avg(pk), 9) AS m FROM dr JOIN x USING (method, i) GROUP BY method, r),
e AS (SELECT method, list(m ORDER BY m) AS s FROM ms GROUP BY method) SELECT method, round(means.pk, 4) AS mean, round(s[6], 4) AS low, round(s[196], 4) AS high FROM e JOIN means USING (method)""",
    "win_loss": f"""{CUBE}, {PAIRS}, {wilcoxon_sql("one")}, s AS (SELECT count(*) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b, avg(b) - avg(a) AS delta, count(*) FILTER (b < a) AS wins, count(*) FILTER (b > a) AS losses, count(*) FILTER (b = a) AS ties FROM pairs)
SELECT n_pairs, {R("mean_a", "mean_b", "delta")}, wins, losses, ties, p, p < 0.05 AS significant FROM s, wx""",
    "value_summary": f"{T.with_('ev')}, g AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, min(value) AS low, max(value) AS high FROM ev GROUP BY event_type) SELECT event_type, n, {R('mean', 'std', 'median', 'low', 'high')} FROM g",
}
