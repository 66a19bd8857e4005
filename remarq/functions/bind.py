"""Evaluating an expression once where it is used many times.

Catalyst copies an expression wherever it is referred to: into every call of a lambda, and into filters that it pushes
below a projection. Binding keeps one evaluation per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated once, as the variable of a lambda over a one-element array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns added through a generator of one row, which filters are not pushed through."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
