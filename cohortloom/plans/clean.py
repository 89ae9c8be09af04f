"""From raw cohort tables to one cleaned table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortloom.constants import COVARIATES, DROPPED_COLUMNS, ID_COLUMN, OUTCOMES
from cohortloom.operators.histogram import histogram
from cohortloom.operators.merge import harmonise_names, outer_merge
from cohortloom.operators.moments import correlation
from cohortloom.operators.profile import missing_percentage, wave_coverage
from cohortloom.operators.qc import apply_qc_rules
from cohortloom.operators.select import drop_incomplete_present, exposures
from cohortloom.staging import stage


@dataclass
class Cleaned:
    """Cleaned tables by key, their combination, and the names of the outcomes in it."""

    tables: dict[str, DataFrame]
    combined: DataFrame
    outcomes: list[str]
    covariates: list[str]
    id_column: str = ID_COLUMN

    def exposures(self, table: DataFrame) -> list[str]:
        return exposures(table.columns, [self.id_column], self.outcomes, self.covariates)

    def missing(self, key: str | None = None) -> DataFrame:
        return missing_percentage(self.combined if key is None else self.tables[key])

    def exposure_correlation(self, key: str | None = None) -> DataFrame:
        """Correlations of the exposures; they are z-scores already, so no centring pass."""
        table = self.combined if key is None else self.tables[key]
        return correlation(table, self.exposures(table), centre=False)

    def outcome_histogram(self) -> DataFrame:
        return histogram(self.combined, [c for c in self.outcomes if c in self.combined.columns])


def clean_table(
    df: DataFrame,
    outcomes: Sequence[str] = OUTCOMES,
    covariates: Sequence[str] = COVARIATES,
    drop: Sequence[str] = DROPPED_COLUMNS,
    id_column: str = ID_COLUMN,
    **thresholds,
) -> DataFrame:
    """Complete rows, quality rules, log2, z-scores."""
    complete = drop_incomplete_present(df, [*outcomes, *covariates]).drop(*drop)
    return apply_qc_rules(complete, outcomes, covariates, standardize_values=True, log2_values=True,
                          id_column=id_column, **thresholds)


def clean_cohort(
    tables: Mapping[str, DataFrame],
    outcomes: Sequence[str] = OUTCOMES,
    covariates: Sequence[str] = COVARIATES,
    drop: Sequence[str] = DROPPED_COLUMNS,
    id_column: str = ID_COLUMN,
    **thresholds,
) -> Cleaned:
    """Clean each table on its own, then merge them and keep the columns seen in every wave.

    Each cleaned table is written once, because profile, correlation and merge all read it.
    """
    cleaned = {
        key: stage(clean_table(table, outcomes, covariates, drop, id_column, **thresholds), f"cleaned-{key}")
        for key, table in tables.items()
    }
    names = list(outcomes)
    keys = list(cleaned)
    combined = cleaned[keys[0]]
    for key in keys[1:]:
        right = cleaned[key]
        if len(names) == 2:
            right, renamed = harmonise_names(combined, right, (names[1], names[0]))
            names = list(dict.fromkeys(renamed.get(c, c) for c in names))
        combined = outer_merge(combined, right, on=id_column)
    combined = stage(combined, "combined")
    return Cleaned(cleaned, wave_coverage(combined), names, list(covariates), id_column)
