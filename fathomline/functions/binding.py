"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Spark does not share repeated sub-expressions inside lambdas, so an array that a lambda
    refers to would be rebuilt for every element. A one-element transform binds it instead.
    """
    return F.transform(F.array(value), use)[0]
