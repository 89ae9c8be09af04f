"""Joining cohort tables on the participant id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import ID_COLUMN


def harmonise_names(
    left: DataFrame, right: DataFrame, pair: tuple[str, str] = ("CFDDS", "CFDRIGHT")
) -> tuple[DataFrame, dict[str, str]]:
    """Rename the right table's column of the pair to the name that the left table uses.

    Returns the right table and the renames done. The first name of the pair has precedence;
    a rename that would repeat a column name is not done.
    """
    first, second = pair
    for here, there in ((first, second), (second, first)):
        if here in left.columns and there in right.columns:
            if here in right.columns:
                return right, {}
            return right.withColumnRenamed(there, here), {there: here}
    return right, {}


def outer_merge(left: DataFrame, right: DataFrame, on: str = ID_COLUMN, sort: bool = False) -> DataFrame:
    """Full outer join; shared columns take the left value, the right one where it is missing.

    Columns of one side keep their place, shared ones follow at the end. One shuffle on the id.
    """
    shared = [c for c in left.columns if c in right.columns and c != on]
    only_left = [c for c in left.columns if c not in shared and c != on]
    only_right = [c for c in right.columns if c not in shared and c != on]
    a, b = left.alias("a"), right.alias("b")
    merged = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"), "full_outer").select(
        F.coalesce(F.col(f"a.`{on}`"), F.col(f"b.`{on}`")).alias(on),
        *[F.col(f"a.`{c}`") for c in only_left],
        *[F.col(f"b.`{c}`") for c in only_right],
        *[F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in shared],
    )
    return merged.orderBy(on) if sort else merged


def inner_merge(outcomes: DataFrame, measures: DataFrame, on: str = ID_COLUMN) -> DataFrame:
    """Participants that are in both tables."""
    return outcomes.join(measures, on, "inner")


def reattach(df: DataFrame, identity: DataFrame, columns: list[str], on: str = ID_COLUMN) -> DataFrame:
    """Put id columns (such as the wave) of ``identity`` back, right after the key."""
    rest = [c for c in df.columns if c != on and c not in columns]
    return df.select(on, *rest).join(identity.select(on, *columns), on, "inner").select(on, *columns, *rest)


def repeated_ids(df: DataFrame, on: str = ID_COLUMN) -> DataFrame:
    """Ids that occur more than once; an empty result proves the merge to be one to one."""
    return df.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
