"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Inside lambdas an expression is otherwise computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
