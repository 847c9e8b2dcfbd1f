"""Queries of candidate recall and parameter search."""

from __future__ import annotations

from ..operators import gaps, search, select
from ..sources import tables as T
from .common import fixed, rounded
from .q_gaps import ONE


def recall(s, d):
    u = T.vectors(s, d)
    return rounded(search.candidate_recall(select.top_k(fixed(gaps.gap_one_sided(u, 3)), 12), T.references(u), 1))


def grid(s, d):
    u = T.vectors(s, d)
    return rounded(search.search_top_k(fixed(gaps.gap_one_sided(u, 3)), T.references(u), T.sizes(u), search.grid(s, k=[3, 6, 9, 12])))


QUERIES = {"candidate_recall": recall, "grid_search": grid}
SQL = {
    "candidate_recall": f"""WITH {ONE}, {T.SQL["vectors"]}, {T.SQL["refs"]}, c AS (SELECT seq_id, boundary FROM one QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, boundary) <= 12),
x AS (SELECT r.seq_id, r.boundary, (EXISTS (SELECT 1 FROM c WHERE c.seq_id = r.seq_id AND abs(c.boundary - r.boundary) <= 1))::INT AS hit FROM refs r)
SELECT seq_id, count(*) AS n_refs, sum(hit)::BIGINT AS n_found, round(avg(hit), 6) + 0.0 AS recall FROM x GROUP BY seq_id""",
}
