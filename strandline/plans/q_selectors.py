"""Queries of learned selection over the results of registry methods on each sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps, portfolio, selectors
from ..sources import tables as T
from ..sources.stored import stored
from . import battery
from .common import fixed, rounded

#: Fixed value: domains that a sequence may have, one column each.
DOMAINS = range(5)
COLUMNS = ["n_units", "log_units", "n_refs", "density", "mean_gap", "std_gap", "domain", *(f"domain_is_{x}" for x in DOMAINS)]


def sequence_features(s, d):
    """(seq_id, n_units, log_units, n_refs, density, mean_gap, std_gap, domain, domain_is_0 to domain_is_4)."""
    u = T.vectors(s, d)
    refs = T.references(u).groupBy("seq_id").agg(F.count("*").alias("n_refs"))
    gap = fixed(gaps.gap_adjacent(u)).groupBy("seq_id").agg(F.avg("score").alias("mean_gap"), F.stddev_pop("score").alias("std_gap"))
    rows = T.sizes(u).select("seq_id", F.col("n").alias("n_units"), F.log1p("n").alias("log_units")).join(refs, "seq_id", "left").join(gap, "seq_id", "left")
    rows = rows.withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).withColumn("density", F.col("n_refs") / F.greatest(F.col("n_units"), F.lit(1))).withColumn("domain", F.col("seq_id") % len(DOMAINS))
    return rows.select("seq_id", *COLUMNS[:6], "domain", *((F.col("domain") == x).cast("int").alias(f"domain_is_{x}") for x in DOMAINS))


def plainly(s, d):
    return rounded(selectors.chosen(selectors.predictions(sequence_features(s, d), COLUMNS, battery.results(s, d))))


def by_trees(s, d):
    return rounded(selectors.chosen(selectors.tree_predictions(sequence_features(s, d), COLUMNS, battery.results(s, d))))


def guarded(s, d):
    return rounded(selectors.guarded(sequence_features(s, d), COLUMNS, battery.results(s, d), "divisive"))


def domain_out(s, d):
    return rounded(selectors.chosen(selectors.predictions(sequence_features(s, d), COLUMNS, battery.results(s, d), "balanced", by="domain")))


def domain_out_by_trees(s, d):
    return rounded(selectors.chosen(selectors.tree_predictions(sequence_features(s, d), COLUMNS, battery.results(s, d), "balanced", by="domain")))


def robust(s, d):
    """Choices from pools of the best 3, 5 and 8 methods and of all."""
    features, cube = stored(sequence_features(s, d), "features"), stored(battery.results(s, d), "results")
    pools = [(f"top_{top}", selectors.chosen(selectors.predictions(features, COLUMNS, cube, "balanced", top))) for top in (3, 5, 8, 80)]
    return rounded(portfolio.robustness(pools))


QUERIES = {
    "selector_robustness": robust,
    "sequence_features": lambda s, d: rounded(sequence_features(s, d)),
    "method_selector": plainly,
    "method_selector_trees": by_trees,
    "guarded_selector": guarded,
    "selector_domain_out": domain_out,
    "selector_domain_out_trees": domain_out_by_trees,
}

from .q_gaps import ADJ  # noqa: E402

FEATURES = f"""{ADJ}, {T.SQL["vectors"]}, {T.SQL["refs"]}, {T.SQL["sizes"]}, r AS (SELECT seq_id, count(*) AS n_refs FROM refs GROUP BY seq_id), g AS (SELECT seq_id, avg(score) AS mean_gap, stddev_pop(score) AS std_gap FROM adj GROUP BY seq_id),
f AS (SELECT seq_id, n::BIGINT AS n_units, ln(1 + n) AS log_units, coalesce(n_refs, 0) AS n_refs, coalesce(n_refs, 0) / greatest(n, 1) AS density, mean_gap, std_gap, seq_id % 5 AS domain FROM sizes LEFT JOIN r USING (seq_id) LEFT JOIN g USING (seq_id))"""
SQL = {
    "sequence_features": f"WITH {FEATURES} SELECT seq_id, n_units, n_refs, domain, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("log_units", "density", "mean_gap", "std_gap")) + ", " + ", ".join(f"(domain = {x})::BIGINT AS domain_is_{x}" for x in DOMAINS) + " FROM f",
}
