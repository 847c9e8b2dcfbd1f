"""All registered queries of the sequence operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import q_align, q_candidates, q_extra, q_gaps, q_metrics, q_more, q_portfolio, q_ranking, q_search, q_segment, q_selectors, q_text
from .plans.battery import flagship

MODULES = [q_gaps, q_metrics, q_align, q_segment, q_text, q_portfolio, q_more, q_search, q_candidates, q_extra, q_selectors, q_ranking]
__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
