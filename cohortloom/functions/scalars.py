"""Column expressions; all of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.constants import LOG2_OFFSET, MISSING_TOKENS

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def nan_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def number_of(text: Column) -> Column:
    """Decimal text to double, NULL if it is none. A cast alone would also read 1d or 12F."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def parse_measure(text: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Text to double, any missing token to NULL."""
    return F.when(F.trim(text).isin(*tokens), None).otherwise(nan_to_null(number_of(text)))


def log2_offset(value: Column, offset: float = LOG2_OFFSET) -> Column:
    """``log2(value + offset)``; NULL where the argument is not positive."""
    return F.log2(value + F.lit(offset))


def gaussian_kernel(distance: Column, sigma: Column) -> Column:
    return F.exp(-(distance * distance) / (F.lit(2.0) * sigma * sigma))


def above_median(value: Column, median: Column) -> Column:
    return (value > median).cast("int")


def order_key(seed: int | str, key: Column) -> Column:
    """Seeded pseudo-random sort key of a row, independent of its position."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
