"""Element-wise and reducing helpers over array columns (pure Catalyst)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    An expression indexed inside a lambda is otherwise evaluated again for every
    element; a lambda variable holds it instead.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def as_double(arr: Column) -> Column:
    return arr.cast("array<double>")


def zeros_like(arr: Column) -> Column:
    return F.transform(arr, lambda _: F.lit(0.0).cast("float"))


def total(arr: Column) -> Column:
    """Sum of the elements in double precision."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def average(arr: Column) -> Column:
    """Mean of the elements; null for an empty array."""
    return bind(arr, lambda a: F.when(F.size(a) > 0, total(a) / F.size(a)))


def pairwise(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: fn(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: x * y))
