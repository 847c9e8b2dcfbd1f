"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zeros; integers as longs: the form in which results are compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def fixed(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores rounded to six digits, so that ties are ties in any engine."""
    return scores.withColumn(column, F.round(column, 6) + F.lit(0.0))
