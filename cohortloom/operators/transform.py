"""Transforms of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortloom.constants import LOG2_OFFSET
from cohortloom.functions.text import literal, name, zscore
from cohortloom.operators.profile import COLUMNS_PER_BATCH


def replace_columns(df: DataFrame, changed: dict[str, str]) -> DataFrame:
    """Projection with some columns replaced by SQL expressions."""
    if not changed:
        return df
    return df.selectExpr(*[f"{changed[c]} AS {name(c)}" if c in changed else name(c) for c in df.columns])


def log2_columns(df: DataFrame, columns: Sequence[str], offset: float = LOG2_OFFSET) -> DataFrame:
    """``log2(value + offset)``; missing where the argument is not positive."""
    return replace_columns(df, {c: f"log2({name(c)} + {literal(offset)})" for c in columns})


def row_count_and_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, tuple]]:
    """Number of rows and ``{column: (n, mean, population deviation)}`` over the values present."""
    moments, n_rows = {}, 0
    for start in range(0, max(len(columns), 1), COLUMNS_PER_BATCH):
        batch = list(columns[start:start + COLUMNS_PER_BATCH])
        row = df.selectExpr("count(1) AS n_rows", *[
            f"{f}({name(c)}) AS {f}{i}" for i, c in enumerate(batch) for f in ("count", "avg", "stddev_pop")
        ]).first()
        n_rows = row["n_rows"]
        for i, c in enumerate(batch):
            moments[c] = (row[f"count{i}"], row[f"avg{i}"], row[f"stddev_pop{i}"])
    return n_rows, moments


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    return row_count_and_moments(df, columns)[1]


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population z-scores; missing stays missing, constant columns become zero.

    One small aggregate gives the moments, which enter the projection as literals: the
    table itself is not shuffled.
    """
    if not columns:
        return df
    moments = column_moments(df, columns)
    return replace_columns(df, {c: zscore(name(c), *moments[c][1:]) for c in columns})


def exposure_index(df: DataFrame, columns: Sequence[str], index: str = "exposure_index") -> DataFrame:
    """Sum over the columns present in a row; missing if all of them are."""
    present = f"coalesce({', '.join(f'CAST({name(c)} AS DOUBLE)' for c in columns)})"
    total = " + ".join(f"coalesce(CAST({name(c)} AS DOUBLE), 0D)" for c in columns)
    return df.selectExpr("*", f"CASE WHEN {present} IS NOT NULL THEN {total} END AS {name(index)}")
