"""Equi-join of two sides whose rows may pile up on a few key values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.staging import broadcast_if_small, stage

ROWS_PER_KEY = 500_000


def crowded_counts(counted: DataFrame, on: Sequence[str], rows_per_key: int = ROWS_PER_KEY) -> DataFrame | None:
    """Keys whose count ``n`` exceeds the bound and how often to divide them; None without any."""
    over = counted.where(F.col("n") > rows_per_key)
    crowded = stage(over.select(*on, F.ceil(F.col("n") / rows_per_key).cast("int").alias("__parts")), "crowded")
    return None if crowded.isEmpty() else broadcast_if_small(crowded)


def crowded_keys(left: DataFrame, on: Sequence[str], rows_per_key: int = ROWS_PER_KEY) -> DataFrame | None:
    """The same for the rows of a table, which should be staged."""
    if left.count() <= rows_per_key:
        return None
    return crowded_counts(left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, rows_per_key)


def divided_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: str, crowded: DataFrame | None
) -> DataFrame:
    """Inner join that divides the left rows of a crowded key by a hash of ``spread_by``.

    The right rows of a crowded key are repeated once per division; all others stay single.
    """
    on = list(on)
    if crowded is None:
        return left.join(right, on)
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    spread = left.join(crowded, on, "left").withColumn("__part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    repeated = right.join(crowded, on, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("__parts").join(repeated.drop("__parts"), [*on, "__part"]).drop("__part")


def hub_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], spread_by: str, rows_per_key: int = ROWS_PER_KEY
) -> DataFrame:
    """``divided_join`` by the keys at which many rows meet, counted on both sides.

    A key gives (left rows x right rows) results; it is divided so often that a part gives
    ``rows_per_key`` of them or one left row is left in it. Both sides should be staged.
    """
    on = [on] if isinstance(on, str) else list(on)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("l")).join(
        right.groupBy(*on).agg(F.count(F.lit(1)).alias("r")), on)
    parts = F.least(F.col("l"), F.ceil(F.col("l").cast("double") * F.col("r") / rows_per_key).cast("long"))
    over = counts.where(F.col("l").cast("double") * F.col("r") > rows_per_key)
    crowded = stage(over.select(*on, parts.cast("int").alias("__parts")), "crowded")
    return divided_join(left, right, on, spread_by, None if crowded.isEmpty() else broadcast_if_small(crowded))
