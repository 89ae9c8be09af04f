"""From a cleaned table to completed datasets on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortloom.constants import DEMOGRAPHICS, ID_COLUMN
from cohortloom.operators.impute import Imputation, impute, imputed_variables
from cohortloom.operators.moments import correlation
from cohortloom.sources import read_results, write_datasets, write_results


@dataclass
class ImputedCohort:
    result: Imputation
    datasets: DataFrame
    correlations: DataFrame


def impute_cohort(
    cleaned: DataFrame,
    path: str | None = None,
    n_imputations: int = 5,
    n_iterations: int = 5,
    random_state: int = 42,
    n_random_vars: int | None = None,
    tune_parameters: bool = True,
    id_column: str = ID_COLUMN,
    mode: str = "errorifexists",
    method: str = "linear",
) -> ImputedCohort:
    """Complete the table, write one folder per dataset, and correlate each dataset.

    Demographic columns take part even if only some of the other variables are chosen.
    """
    result = impute(
        cleaned, n_datasets=n_imputations, n_iterations=n_iterations, seed=random_state,
        n_random_variables=n_random_vars, always=DEMOGRAPHICS, tune=tune_parameters, id_column=id_column, method=method)
    datasets = result.completed()
    if path is not None:
        write_datasets(datasets, f"{path}/datasets", id_column, mode=mode)
        write_results({"trace": result.trace, "importance": result.importance}, path, mode)
    return ImputedCohort(result, datasets, correlations(datasets, id_column))


def correlations(datasets: DataFrame, id_column: str = ID_COLUMN) -> DataFrame:
    """Correlation of all variables within each dataset."""
    variables = [c for c in imputed_variables(datasets, id_column) if c != "dataset"]
    return correlation(datasets, variables, ["dataset"])


def resume(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Datasets and trace of an earlier run; the number of datasets is what the table holds."""
    return read_results(spark, path, ["datasets", "trace", "importance"])
