"""Vector arithmetic on array<double> columns, kept in Catalyst by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once. Higher-order functions are not shared between uses of an expression, so vectors that are used twice are bound."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    ratio = lambda p: F.when(p["n"] > 0, p["d"] / p["n"]).otherwise(F.lit(0.0))
    return let(a, lambda x: let(b, lambda y: let(F.struct(dot(x, y).alias("d"), (norm(x) * norm(y)).alias("n")), ratio)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def sum_of(rows: Column) -> Column:
    """Sum of an array of vectors; null for an empty one."""
    return let(rows, lambda r: F.when(F.size(r) > 0, F.aggregate(F.slice(r, 2, F.size(r)), F.element_at(r, 1), add)))


def mean_of(rows: Column) -> Column:
    return let(rows, lambda r: scale(sum_of(r), F.try_divide(F.lit(1.0), F.size(r))))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    return let(a, lambda x: let(norm(x), lambda n: F.when(n > 0, scale(x, F.lit(1.0) / n)).otherwise(x)))


def concat_unit(a: Column, b: Column) -> Column:
    return unit(F.concat(a, b))
