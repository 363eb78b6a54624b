"""Evaluating an expensive expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a higher-order function is otherwise re-evaluated for
    every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)
