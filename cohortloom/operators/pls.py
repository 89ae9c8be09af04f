"""Partial least squares from cross-products.

The table is read once into sums of products of the columns. Everything that follows works on
matrices of column by column, whatever the number of participants.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import literal, name
from cohortloom.operators.moments import dense, sum_vectors
from cohortloom.operators.transform import row_count_and_moments

MODEL_SCHEMA = """rep int, outer int, inner int, n_components int, coef array<double>, intercept array<double>,
    x_weight array<double>, x_loading array<double>, y_loading array<double>, x_rotation array<double>,
    x_explained double, y_explained double"""


@dataclass
class Scaling:
    """Means and deviations used to bring the columns to a common scale."""

    x_mean: np.ndarray
    x_sd: np.ndarray
    y_mean: np.ndarray
    y_sd: np.ndarray


def check_variables(df: DataFrame, x_vars: Sequence[str], y_vars: Sequence[str]) -> None:
    for label, names in (("X", x_vars), ("Y", y_vars)):
        absent = [c for c in names if c not in df.columns]
        if absent:
            raise ValueError(f"{label} variables not in the table: {absent}")


def scaling_of(df: DataFrame, x_vars: Sequence[str], y_vars: Sequence[str]) -> Scaling:
    """One aggregate; also proves that no value is missing."""
    n, moments = row_count_and_moments(df, list(dict.fromkeys([*x_vars, *y_vars])))
    gaps = [c for c in [*x_vars, *y_vars] if moments[c][0] != n]
    if gaps:
        raise ValueError(f"missing values in {gaps}")

    def column(names, k):
        return np.array([moments[c][k] for c in names], dtype=float)

    x_sd, y_sd = column(x_vars, 2), column(y_vars, 2)
    return Scaling(column(x_vars, 1), np.where(x_sd > 0, x_sd, 1.0), column(y_vars, 1), np.where(y_sd > 0, y_sd, 1.0))


def _cross_products(x_vars, y_vars, scaling: Scaling, cells: Sequence[tuple[int, str]]):
    """Per task: Z'Z with Z = (1, X, Y), for each repetition and fold range."""
    width = 1 + len(x_vars) + len(y_vars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([
                np.ones(batch.num_rows),
                (dense(batch, x_vars) - scaling.x_mean) / scaling.x_sd,
                (dense(batch, y_vars) - scaling.y_mean) / scaling.y_sd,
            ])
            for rep, column in cells:
                ranges = batch.column(column).to_numpy(zero_copy_only=False)
                order = np.argsort(ranges, kind="stable")
                found, starts = np.unique(ranges[order], return_index=True)
                for a, at in zip(found, np.split(order, starts[1:])):
                    rows = z[at]
                    key = (rep, int(a))
                    totals[key] = totals.get(key, 0.0) + rows.T @ rows
        for (rep, a), product in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([rep] * width, pa.int32()), pa.array([a] * width, pa.int32()),
                 pa.array(range(width), pa.int32()),
                 pa.array([product[i, i:] for i in range(width)], pa.list_(pa.float64()))],
                names=["rep", "cell", "i", "vec"])

    return run


def cross_products(
    df: DataFrame, x_vars: Sequence[str], y_vars: Sequence[str], scaling: Scaling, cells: Sequence[tuple[int, str]]
) -> DataFrame:
    """``(rep, cell, i, vec)``: upper triangle rows of Z'Z; the cell columns come with the table."""
    partial = df.select(*dict.fromkeys([c for _, c in cells]), *dict.fromkeys([*x_vars, *y_vars])).mapInArrow(
        _cross_products(list(x_vars), list(y_vars), scaling, list(cells)),
        "rep int, cell int, i int, vec array<double>")
    return sum_vectors(partial, ["rep", "cell", "i"])


def square(rows: pd.DataFrame, width: int) -> np.ndarray:
    """Upper triangle rows to a symmetric matrix."""
    upper = np.zeros((width, width))
    for i, vec in zip(rows["i"], rows["vec"]):
        upper[i, i:] += np.asarray(vec)
    return upper + np.triu(upper, 1).T


def fit_pls(product: np.ndarray, n_x: int, n_y: int, max_components: int) -> list[dict]:
    """Models with 1 to ``max_components`` components from Z'Z (kernel form, columns scaled, ddof 1)."""
    n = product[0, 0]
    sums = product[0, 1:]
    centred = product[1:, 1:] - np.outer(sums, sums) / n
    sd = np.sqrt(np.maximum(np.diag(centred), 0.0) / max(n - 1.0, 1.0))
    sd[sd <= 1e-12] = 1.0
    scaled = centred / np.outer(sd, sd)
    xx, xy = scaled[:n_x, :n_x], scaled[:n_x, n_x:].copy()
    mean = sums / n
    x_total = np.trace(centred[:n_x, :n_x]) / n
    y_total = np.trace(scaled[n_x:, n_x:])
    w_all, p_all, q_all, r_all = [], [], [], []
    models = []
    for _ in range(max_components):
        # Dominant left singular vector of X'Y, by the small side.
        direction = np.linalg.eigh(xy.T @ xy)[1][:, -1]
        w = xy @ direction
        norm = np.linalg.norm(w)
        if norm > 1e-10:
            w = w / norm
            w = w * (1.0 if w[np.argmax(np.abs(w))] > 0 else -1.0)
            r = w.copy()
            for p, earlier in zip(p_all, r_all):
                r -= (p @ w) * earlier
            tt = r @ xx @ r
            if tt > 1e-10 * n:
                p = xx @ r / tt
                q = xy.T @ r / tt
                xy = xy - tt * np.outer(p, q)
                w_all.append(w), p_all.append(p), q_all.append(q), r_all.append(r)
                x_share, y_share = tt / n / x_total, (q @ q) * tt / y_total
        exhausted = len(w_all) <= len(models)
        if not w_all:
            w_all.append(np.zeros(n_x)), p_all.append(np.zeros(n_x))
            q_all.append(np.zeros(n_y)), r_all.append(np.zeros(n_x))
        coef = (np.array(r_all).T @ np.array(q_all)) * sd[n_x:] / sd[:n_x, None]
        models.append({
            "n_components": len(models) + 1,
            "coef": coef.ravel(),
            "intercept": mean[n_x:] - mean[:n_x] @ coef,
            "x_weight": w_all[-1], "x_loading": p_all[-1], "y_loading": q_all[-1], "x_rotation": r_all[-1],
            "x_explained": 0.0 if exhausted else x_share,
            "y_explained": 0.0 if exhausted else y_share,
        })
    return models


def _solver(n_x: int, n_y: int, max_components: int, plans: dict[int, tuple]):
    width = 1 + n_x + n_y

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rep, outer = key
        outer_of, inner_of = plans[rep]
        cells = {cell: square(part, width) for cell, part in rows.groupby("cell")}
        folds = [0] if outer == 0 or not inner_of else [0, *sorted(set(inner_of[outer]) - {0})]
        found = []
        for inner in folds:
            training = [
                product for cell, product in cells.items()
                if outer == 0 or (outer_of[cell] != outer and (inner == 0 or inner_of[outer][cell] != inner))
            ]
            for model in fit_pls(sum(training), n_x, n_y, max_components):
                found.append({"rep": rep, "outer": outer, "inner": inner, **model})
        return pd.DataFrame(found)

    return run


def solve(products: DataFrame, n_x: int, n_y: int, max_components: int, plans: dict[int, tuple]) -> DataFrame:
    """All models of all repetitions; outer fold 0 is the model on all rows.

    A task gets the cross-products of one repetition, whose size depends on the number of
    columns and folds only.
    """
    folds = max(max(outer) for outer, _ in plans.values())
    spread = products.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    return spread.groupBy("rep", "outer").applyInPandas(
        _solver(n_x, n_y, max_components, plans), MODEL_SCHEMA)


def fit_table(
    df: DataFrame, x_vars: Sequence[str], y_vars: Sequence[str], n_components: int
) -> tuple[DataFrame, Scaling]:
    """Models with 1 to ``n_components`` components on the whole table, and the scaling used."""
    check_variables(df, x_vars, y_vars)
    scaling = scaling_of(df, x_vars, y_vars)
    products = cross_products(df.withColumn("__cell", F.lit(0)), x_vars, y_vars, scaling, [(1, "__cell")])
    # A single range in the only fold: no fold is left out of fold 0.
    models = solve(products.withColumn("rep", F.lit(1)), len(x_vars), len(y_vars), n_components, {1: ([0], {})})
    return models, scaling


def loadings_table(models: DataFrame, variables: Sequence[str], side: str = "x_loading") -> DataFrame:
    """Long ``(rep, outer, component, variable, loading)`` of the models without inner fold.

    ``side`` may be ``x_loading``, ``y_loading``, ``x_weight`` or ``x_rotation``.
    """
    names = F.array(*[F.lit(v) for v in variables])
    return (
        models.where(F.col("inner") == 0)
        .select("rep", "outer", F.col("n_components").alias("component"), F.posexplode(side).alias("at", "loading"))
        .select("rep", "outer", "component", F.element_at(names, F.col("at") + 1).alias("variable"), "loading")
    )


def _model_row(models: DataFrame, n_components: int):
    return models.where((F.col("outer") == 0) & (F.col("inner") == 0)
                        & (F.col("n_components") <= n_components)).orderBy("n_components").collect()


def predict(
    df: DataFrame, models: DataFrame, scaling: Scaling, x_vars: Sequence[str], y_vars: Sequence[str],
    n_components: int, prefix: str = "pred_",
) -> DataFrame:
    """Predicted outcomes in their own units: a linear combination of columns, no Python."""
    row = _model_row(models, n_components)[-1]
    coef = np.asarray(row["coef"]).reshape(len(x_vars), len(y_vars))
    added = []
    for k, y in enumerate(y_vars):
        total = weighted_sum(x_vars, scaling, coef[:, k], row["intercept"][k])
        added.append(f"({total}) * {literal(float(scaling.y_sd[k]))} + {literal(float(scaling.y_mean[k]))} "
                     f"AS {name(prefix + y)}")
    return df.selectExpr("*", *added)


def weighted_sum(x_vars: Sequence[str], scaling: Scaling, weights, constant: float = 0.0) -> str:
    """SQL of ``constant`` plus the weighted sum of the scaled columns."""
    terms = [
        f"({name(x)} - {literal(float(mean))}) * {literal(float(weight / sd))}"
        for x, mean, sd, weight in zip(x_vars, scaling.x_mean, scaling.x_sd, weights)
    ]
    return " + ".join([literal(float(constant)), *terms])


def transform(
    df: DataFrame, models: DataFrame, scaling: Scaling, x_vars: Sequence[str], n_components: int, n_rows: int,
    prefix: str = "score_",
) -> DataFrame:
    """X scores of the model on all rows, one column per component."""
    # The model scales with ddof 1, the scaling with ddof 0.
    shrink = np.sqrt((n_rows - 1) / n_rows)
    return df.selectExpr("*", *[
        weighted_sum(x_vars, scaling, np.asarray(row["x_rotation"]) * shrink)
        + f" AS {name(prefix + str(row['n_components']))}"
        for row in _model_row(models, n_components)
    ])
