"""One covariate-adjusted regression per outcome and exposure, from one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.moments import dense, sum_vectors
from cohortloom.operators.pls import square
from cohortloom.operators.transform import column_moments


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    small = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), small)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1 + step * d or small)
            c = 1 + step / c or small
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def two_sided_p(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def t_quantile(level: float, freedom: float) -> float:
    """Value that |t| stays below with the given probability."""
    low, high = 0.0, 1.0
    while two_sided_p(high, freedom) > 1 - level and high < 1e8:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if two_sided_p(middle, freedom) > 1 - level else (low, middle)
    return (low + high) / 2


def _sums(outcomes, exposures, covariates, means, deviations):
    columns = [*outcomes, *exposures, *covariates]
    at = {c: i for i, c in enumerate(columns)}
    width = 3 + len(covariates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = (dense(batch, columns) - means) / deviations
            rest = values[:, [at[c] for c in covariates]]
            for o, outcome in enumerate(outcomes):
                for e, exposure in enumerate(exposures):
                    z = np.column_stack([np.ones(len(values)), values[:, at[exposure]], rest, values[:, at[outcome]]])
                    z = z[~np.isnan(z).any(axis=1)]
                    totals[o, e] = totals.get((o, e), 0.0) + z.T @ z
        for (o, e), product in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([o] * width, pa.int32()), pa.array([e] * width, pa.int32()),
                 pa.array(range(width), pa.int32()),
                 pa.array([product[i, i:] for i in range(width)], pa.list_(pa.float64()))],
                names=["o", "e", "i", "vec"])

    return run


def run_linear_models(
    df: DataFrame,
    outcomes: Sequence[str],
    exposures: Sequence[str],
    covariates: Sequence[str] = (),
    level: float = 0.95,
) -> DataFrame:
    """``(outcome, exposure, n, coef, std_error, t, p_value, ci_lower, ci_upper)``.

    Each model is ``outcome ~ 1 + exposure + covariates`` over the rows that have all of them.
    """
    outcomes, exposures, covariates = list(outcomes), list(exposures), list(covariates)
    columns = [*outcomes, *exposures, *covariates]
    moments = column_moments(df, columns)
    means = np.array([moments[c][1] or 0.0 for c in columns])
    deviations = np.array([moments[c][2] or 1.0 for c in columns])
    scale = dict(zip(columns, deviations))
    width = 3 + len(covariates)
    partial = df.select(*dict.fromkeys(columns)).mapInArrow(
        _sums(outcomes, exposures, covariates, means, deviations), "o int, e int, i int, vec array<double>")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        outcome, exposure = outcomes[int(key[0])], exposures[int(key[1])]
        product = square(rows, width)
        a, b = product[:-1, :-1], product[:-1, -1]
        n = int(round(product[0, 0]))
        freedom = n - (width - 1)
        found = {"outcome": [outcome], "exposure": [exposure], "n": [n]}
        names = ["coef", "std_error", "t", "p_value", "ci_lower", "ci_upper"]
        if freedom < 1 or np.linalg.matrix_rank(a, hermitian=True) < len(a):
            return pd.DataFrame({**found, **{name: [None] for name in names}})
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        residual = max(product[-1, -1] - beta @ b, 0.0)
        unit = scale[outcome] / scale[exposure]
        coef, error = beta[1] * unit, np.sqrt(residual / freedom * inverse[1, 1]) * unit
        t = coef / error if error > 0 else np.inf
        reach = t_quantile(level, freedom) * error
        return pd.DataFrame({**found, **dict(zip(names, (
            [coef], [error], [t], [two_sided_p(t, freedom)], [coef - reach], [coef + reach])))})

    return sum_vectors(partial, ["o", "e", "i"]).groupBy("o", "e").applyInPandas(
        solve, "outcome string, exposure string, n bigint, coef double, std_error double, t double, "
               "p_value double, ci_lower double, ci_upper double")
