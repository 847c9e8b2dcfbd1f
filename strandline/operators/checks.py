"""Invariants of a data set as rows: what is checked and how many rows break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad", (F.col("n_bad") == 0).alias("ok"))


def unique(name: str, rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in more than one row."""
    return broken(name, rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"))


def present(name: str, rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in one of the columns."""
    return broken(name, rows.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])))


def holds(name: str, rows: DataFrame, condition: str) -> DataFrame:
    """Rows that don't meet a condition; null counts as broken."""
    return broken(name, rows.where(~F.coalesce(F.expr(condition), F.lit(False))))


def refers(name: str, rows: DataFrame, key: str, to: DataFrame, to_key: str) -> DataFrame:
    """Rows whose key is not in the other table."""
    return broken(name, rows.select(F.col(key).alias("_k")).join(to.select(F.col(to_key).alias("_k")).distinct(), "_k", "left_anti"))


def inside_and_rising(name: str, rows: DataFrame, boundaries: str, duration: str) -> DataFrame:
    """Rows whose boundaries don't rise strictly within 0 and the duration."""
    b = F.col(boundaries)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(b) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(b, i) < F.try_element_at(b, i + 1), F.lit(True)))
    return broken(name, rows.where(~(rising & F.forall(b, lambda x: (x > 0) & (x < F.col(duration))))))


def every(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, checks)
