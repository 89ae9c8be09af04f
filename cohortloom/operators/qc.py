"""Quality rules on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.constants import ID_COLUMN, MAX_LEVELS, MAX_ZERO_SHARE, MIN_LEVEL_ROWS, MIN_VALID
from cohortloom.operators.profile import column_profile, level_counts, most_estimated, wave_column
from cohortloom.operators.select import exposures, keep_first
from cohortloom.operators.transform import log2_columns, standardize
from cohortloom.staging import stage


def qc_profile(
    df: DataFrame, columns: Sequence[str], group: str | None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Everything the rules need, a row per column.

    ``(column_name, n_valid, n_zero, worst_wave, levels, smallest_level)``. One pass counts
    values, zeros and waves. A second one counts the values of those columns only that can
    have fewer than ``max_levels``; for the others ``levels`` is missing.
    """
    types = {f.name: f.dataType for f in df.schema}
    by_wave = stage(column_profile(df, columns, group, levels=True, max_levels=max_levels), "profile")
    named = F.col("wave").isNotNull() if group else F.lit(True)
    # Without a wave the worst wave is the whole table.
    overall = by_wave.groupBy("column_name").agg(
        F.sum("n_valid").alias("n_valid"),
        F.sum("n_zero").alias("n_zero"),
        F.min(F.when(named, F.col("n_valid"))).alias("worst_wave"),
        F.max("about_levels").alias("about_levels"),
    )
    few = overall.where(F.col("about_levels") <= most_estimated(max_levels))
    candidates = [r["column_name"] for r in few.collect()]
    if candidates:
        counted = stage(
            level_counts(df, candidates).groupBy("column_name").agg(
                F.count(F.lit(1)).alias("levels"), F.min("n").alias("smallest_level")),
            "levels",
        )
    else:
        counted = df.sparkSession.createDataFrame([], T.StructType([
            T.StructField("column_name", T.StringType()),
            T.StructField("levels", T.LongType()),
            T.StructField("smallest_level", T.LongType()),
        ]))
    return overall.drop("about_levels").join(counted, "column_name", "left")


def failed_rule(
    min_valid: int = MIN_VALID,
    max_levels: int = MAX_LEVELS,
    min_level_rows: int = MIN_LEVEL_ROWS,
    max_zero_share: float = MAX_ZERO_SHARE,
):
    """Number of the first rule that a profile row fails, NULL when it passes all.

    1: too few values. 2: few levels and one of them rare. 3: mostly zeros. 4: a wave without values.
    """
    return (
        F.when(F.col("n_valid") < min_valid, 1)
        .when((F.col("levels") < max_levels) & (F.col("smallest_level") < min_level_rows), 2)
        .when((F.col("n_valid") > 0) & (F.try_divide(F.col("n_zero"), F.col("n_valid")) >= max_zero_share), 3)
        .when(F.col("worst_wave") == 0, 4)
    )


def checked_columns(
    df: DataFrame, outcomes: Sequence[str], covariates: Sequence[str], id_column: str = ID_COLUMN
) -> list[str]:
    return exposures(df.columns, [id_column], outcomes, covariates)


def qc_verdicts(
    df: DataFrame,
    outcomes: Sequence[str],
    covariates: Sequence[str],
    id_column: str = ID_COLUMN,
    group: str | None = None,
    **thresholds,
) -> DataFrame:
    """``(column_name, failed_rule)`` of the columns that the rules look at."""
    group = group or wave_column(df)
    columns = checked_columns(df, outcomes, covariates, id_column)
    profile = qc_profile(df, columns, group, thresholds.get("max_levels", MAX_LEVELS))
    return profile.select("column_name", failed_rule(**thresholds).alias("failed_rule"))


def removal_counts(verdicts: DataFrame) -> DataFrame:
    """Removed columns per rule."""
    return (
        verdicts.where(F.col("failed_rule").isNotNull())
        .groupBy("failed_rule").agg(F.count(F.lit(1)).alias("n_removed"))
    )


def apply_qc_rules(
    df: DataFrame,
    outcomes: Sequence[str],
    covariates: Sequence[str],
    standardize_values: bool = False,
    log2_values: bool = False,
    id_column: str = ID_COLUMN,
    group: str | None = None,
    **thresholds,
) -> DataFrame:
    """Table with the columns that pass, after id, covariates and outcomes.

    The table is written once, as the profile, the level counts, the moments and the result all read it.
    The rules look at raw values; ``log2(x + offset)`` and then the z-score follow on the
    surviving columns, if asked for.
    """
    df = stage(df, "checked")
    verdicts = qc_verdicts(df, outcomes, covariates, id_column, group, **thresholds)
    passed = {r["column_name"] for r in verdicts.where(F.col("failed_rule").isNull()).collect()}
    survivors = [c for c in checked_columns(df, outcomes, covariates, id_column) if c in passed]
    result = keep_first(df, survivors, [id_column, *covariates, *outcomes])
    if log2_values:
        result = log2_columns(result, survivors)
    if standardize_values:
        result = standardize(result, survivors)
    return result
