"""Latent regression of the outcomes on exposures and covariates, as result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import ID_COLUMN, WAVE_COLUMNS
from cohortloom.operators.crossval import CrossValidation, run_plsr_cv
from cohortloom.operators.pls import loadings_table
from cohortloom.operators.scores import component_frequency, score_summary, top_loadings
from cohortloom.operators.select import exposures


def run_plsr_analysis(
    df: DataFrame,
    outcomes: Sequence[str],
    covariates: Sequence[str],
    max_components: int = 5,
    outer_folds: int = 8,
    inner_folds: int = 7,
    n_repetitions: int = 10,
    random_state: int = 42,
    id_column: str = ID_COLUMN,
) -> CrossValidation:
    """Exposures are all columns that are no outcome, covariate, id or wave."""
    variables = exposures(df.columns, outcomes, covariates, [id_column, "dataset"], WAVE_COLUMNS)
    return run_plsr_cv(df, variables, outcomes, covariates, range(1, max_components + 1), outer_folds,
                       inner_folds, random_state, n_repetitions, id_column)


def report(result: CrossValidation) -> dict[str, DataFrame]:
    """The tables behind the usual figures."""
    final = result.final_model()
    x_final = loadings_table(final, result.x_vars)
    best = result.best_model()
    last = result.inner_scores.agg(F.max("rep")).first()[0]
    return {
        "component_frequency": component_frequency(result.chosen),
        "outer_summary": score_summary(result.outer_scores, ["outer"]),
        "inner_summary": score_summary(result.inner_scores.where(F.col("rep") == last), ["n_components"]),
        "final_x_loadings": top_loadings(x_final),
        "final_y_loadings": loadings_table(final, result.y_vars, "y_loading"),
        "best_x_loadings": top_loadings(loadings_table(best, result.x_vars)),
        "best_y_loadings": loadings_table(best, result.y_vars, "y_loading"),
        "explained_variance": final.select(
            F.col("n_components").alias("component"), "x_explained", "y_explained"),
    }
