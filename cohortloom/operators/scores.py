"""Summaries of cross-validation scores. These tables have a row per fold and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_summary(scores: DataFrame, keys: Sequence[str], score: str = "auroc") -> DataFrame:
    """Mean and population deviation of the scores per key."""
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("n"))


def best_components(inner: DataFrame, keys: Sequence[str] = ("rep", "outer"), score: str = "auroc") -> DataFrame:
    """Per outer fold the component count of greatest mean score; the smallest one wins a tie."""
    means = inner.groupBy(*keys, "n_components").agg(F.round(F.avg(score), 12).alias("mean_score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("mean_score"), "n_components")
    return means.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def component_frequency(chosen: DataFrame) -> DataFrame:
    """``(n_components, n, first)``: how often each count was chosen and where it came first."""
    return chosen.groupBy("n_components").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "outer")).alias("first"))


def mode_components(chosen: DataFrame) -> DataFrame:
    """The count chosen most often; of equals the one met first."""
    return (
        component_frequency(chosen).orderBy(F.desc("n"), "first").limit(1).select("n_components", "n")
    )


def top_loadings(loadings: DataFrame, n: int = 20, component: int = 1) -> DataFrame:
    """The variables with the greatest absolute loading on a component."""
    return (
        loadings.where(F.col("component") == component)
        .orderBy(F.desc(F.abs("loading")), "variable").limit(n)
    )
