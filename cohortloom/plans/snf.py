"""Fused similarity network of exposure blocks, and groups of participants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cohortloom.constants import BLOCK_PATTERNS, ID_COLUMN, WAVE_COLUMNS
from cohortloom.operators.fusion import FusedNetwork, run_snf
from cohortloom.operators.select import pattern_blocks
from cohortloom.sources import write_results


def run_snf_analysis(
    df: DataFrame,
    outcomes: Sequence[str],
    covariates: Sequence[str],
    patterns: Mapping[str, Sequence[str]] = BLOCK_PATTERNS,
    k: int = 20,
    n_clusters: int = 3,
    path: str | None = None,
    id_column: str = ID_COLUMN,
    mode: str = "errorifexists",
    grouping: str = "position",
) -> tuple[FusedNetwork, DataFrame]:
    """Blocks are the columns whose names contain a pattern; id and wave are in none.

    ``grouping="spectral"`` groups by several eigenvectors of the network in place of positions on one.
    """
    if grouping not in ("position", "spectral"):
        raise ValueError(f"grouping must be 'position' or 'spectral', not {grouping!r}")
    columns = [c for c in df.columns if c != id_column and c != "dataset" and c not in WAVE_COLUMNS]
    network = run_snf(df, pattern_blocks(columns, patterns), outcomes, covariates, k, id_column=id_column)
    clusters = network.clusters(n_clusters) if grouping == "position" else network.spectral_clusters(n_clusters)
    if path is not None:
        write_results({**network.tables(), "clusters": clusters}, path, mode)
    return network, clusters
