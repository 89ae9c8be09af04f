"""Column profiles: one aggregate for many columns and all waves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.constants import MAX_LEVELS, WAVE_COLUMNS
from cohortloom.functions.text import literal, name
from cohortloom.staging import stage

# Columns per aggregate. Each batch reads only its own columns from Parquet, so several
# batches read no more than one. Beyond 100 fields Spark gives up whole-stage code.
COLUMNS_PER_BATCH = 96


def wave_column(df: DataFrame) -> str | None:
    return next((c for c in WAVE_COLUMNS if c in df.columns), None)


def level_registers(max_levels: int) -> int:
    """Registers of the estimate: a power of two, 512 or more, at least four times ``max_levels``.

    So many keep the estimate of ``max_levels`` values in the range that is counted by empty registers.
    """
    return max(512, 1 << ceil(log2(4 * max(max_levels, 1))))


def most_estimated(max_levels: int) -> int:
    """Largest estimate that a column with fewer than ``max_levels`` values can have.

    So many values fill as many registers at most, and the estimate m * ln(m / empty) grows with the filled ones.
    """
    registers, values = level_registers(max_levels), max(max_levels - 1, 0)
    return ceil(registers * log(registers / (registers - values)))


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group: str | None = None,
    levels: bool = False,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Long profile ``(group, column_name, n_rows, n_valid, n_zero, about_levels)``.

    ``n_zero`` and ``about_levels`` are counted with ``levels=True`` only. The latter is a HyperLogLog estimate. It serves as a filter
    without false negatives, see ``most_estimated``; its registers follow ``max_levels``.
    """
    spread = f"{1.106 / 2 ** ((log2(level_registers(max_levels)) - 0.5) / 2):.12f}D"
    columns = list(df.columns if columns is None else columns)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    keys = [group] if group else []
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_BATCH):
        batch = columns[start:start + COLUMNS_PER_BATCH]
        rows = ", ".join(
            f"struct({literal(c)} AS column_name, count(1) AS n_rows, count({name(c)}) AS n_valid, "
            + (f"count_if({name(c)} = 0)" if levels and c in numeric else "0L") + " AS n_zero, "
            + (f"approx_count_distinct({name(c)}, {spread})" if levels else "CAST(NULL AS BIGINT)") + " AS about_levels)"
            for c in batch
        )
        source = df.select(*[name(c) for c in dict.fromkeys([*keys, *batch])])
        if group:
            counted = source.groupBy(F.col(name(group)).alias("wave")).agg(F.expr(f"array({rows}) AS profile"))
            parts.append(counted.selectExpr("wave", "inline(profile)"))
        else:
            parts.append(source.selectExpr(f"array({rows}) AS profile").selectExpr("inline(profile)"))
    return reduce(DataFrame.unionByName, parts)


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many they have."""
    return (
        column_profile(df)
        .select("column_name", (F.col("n_rows") - F.col("n_valid")).alias("n_missing"))
        .where(F.col("n_missing") > 0)
    )


def _percent_missing():
    return (F.lit(100.0) * (F.col("n_rows") - F.col("n_valid"))) / F.col("n_rows")


def missing_percentage(df: DataFrame, group: str | None = None) -> DataFrame:
    """Share of missing values in percent, per column, and per wave in wide form if there is one."""
    group = group or wave_column(df)
    if group is None:
        return (
            column_profile(df)
            .select("column_name", F.try_divide(F.lit(100.0) * (F.col("n_rows") - F.col("n_valid")),
                                                F.col("n_rows")).alias("percentage_missing"))
            .orderBy(F.desc("percentage_missing"), "column_name")
        )
    # A row per column and wave: small whatever the size of the cohort.
    profile = stage(column_profile(df, group=group).where(F.col("wave").isNotNull()), "profile")
    waves = [r["wave"] for r in profile.select("wave").distinct().orderBy("wave").collect()]
    label = WAVE_COLUMNS.get(group, group.lower())
    names = {w: f"{label}_{w}_missing_pct" for w in waves}
    # A conditional maximum per wave keeps one grouping for all of them.
    wide = profile.groupBy("column_name").agg(*[
        F.max(F.when(F.col("wave") == F.lit(w), _percent_missing())).alias(names[w]) for w in waves
    ])
    return wide.orderBy(F.desc(names[waves[0]]), "column_name") if waves else wide


def covered_columns(df: DataFrame, group: str | None = None) -> list[str]:
    """Columns, in table order, with at least one value in every wave."""
    group = group or wave_column(df)
    if group is None:
        raise KeyError("no wave column")
    worst = (
        column_profile(df, group=group)
        .where(F.col("wave").isNotNull())
        .groupBy("column_name").agg(F.min("n_valid").alias("worst"))
    )
    kept = {r["column_name"] for r in worst.where(F.col("worst") > 0).collect()}
    return [c for c in df.columns if c in kept]


def wave_coverage(df: DataFrame, group: str | None = None) -> DataFrame:
    return df.select(*covered_columns(df, group))


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value ``(column_name, value, n)`` of columns that have few values.

    The values meet on the map side first, so that the shuffle carries a row per column,
    value and task.
    """
    types = {f.name: f.dataType for f in df.schema}
    rows = ", ".join(
        # Adding zero makes the two zeros of floating point one value.
        f"struct({literal(c)} AS column_name, CAST({name(c)}"
        + (" + 0D" if isinstance(types[c], (T.DoubleType, T.FloatType)) else "") + " AS STRING) AS value)"
        for c in columns
    )
    return (
        df.selectExpr(f"inline(array({rows}))")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def variable_types(df: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """``(column_name, variable_type)``; columns without any value are left out.

    Exact: the estimate only picks the columns whose values are then counted.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    found = column_profile(df, levels=True, max_levels=max_levels).where(F.col("n_valid") > 0).collect()
    candidates = [r["column_name"] for r in found
                  if r["column_name"] in numeric and r["about_levels"] <= most_estimated(max_levels)]
    few = set()
    if candidates:
        counted = level_counts(df, candidates).groupBy("column_name").agg(F.count(F.lit(1)).alias("levels"))
        few = {r["column_name"] for r in counted.where(F.col("levels") < max_levels).collect()}
    present = {r["column_name"] for r in found}
    verdicts = [
        (c, "categorical" if c not in numeric or c in few else "continuous")
        for c in df.columns if c in present
    ]
    return df.sparkSession.createDataFrame(verdicts, "column_name string, variable_type string")
