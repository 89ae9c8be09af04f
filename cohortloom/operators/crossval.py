"""Repeated double cross-validation of partial least squares, scored by AUROC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import ID_COLUMN
from cohortloom.functions import order_key
from cohortloom.functions.text import name
from cohortloom.operators.folds import FoldPlan, fold_plan
from cohortloom.operators.moments import dense
from cohortloom.operators.pls import Scaling, check_variables, cross_products, scaling_of, solve
from cohortloom.operators.ranks import ROWS_PER_BOUNDARY, ROWS_PER_RANGE, RUNS, auroc_of_runs, exact_median, runs_batch, score_runs
from cohortloom.operators.scores import best_components, mode_components
from cohortloom.staging import discard, stage

# Cross-products that a task may hold at a time; more repetitions than fit take another pass.
TASK_BYTES = 256 * 1024 * 1024
# Scores that a task puts in order before it hands them on.
CHUNK_SCORES = 8_000_000


@dataclass
class CrossValidation:
    """Results as tables.

    ``inner_scores`` (rep, outer, inner, n_components, auroc), ``chosen`` (rep, outer,
    n_components, mean_score), ``outer_scores`` (rep, outer, n_components, auroc), ``models``
    with outer fold 0 being the fit on all rows and inner fold 0 the fit on an outer training set.
    """

    inner_scores: DataFrame
    outer_scores: DataFrame
    chosen: DataFrame
    models: DataFrame
    final_n_components: int
    x_vars: list[str]
    y_vars: list[str]
    scaling: Scaling

    def best_model(self) -> DataFrame:
        """Model rows of the outer fold with the greatest score, up to its component count."""
        best = self.outer_scores.orderBy(F.desc(F.round("auroc", 12)), "rep", "outer").limit(1)
        best = best.select("rep", "outer", F.col("n_components").alias("__kept"))
        return (
            self.models.where(F.col("inner") == 0).join(F.broadcast(best), ["rep", "outer"])
            .where(F.col("n_components") <= F.col("__kept")).drop("__kept")
        )

    def final_model(self) -> DataFrame:
        first = self.models.where((F.col("outer") == 0) & (F.col("inner") == 0) & (F.col("rep") == 1))
        return first.where(F.col("n_components") <= self.final_n_components)

    def tables(self) -> dict[str, DataFrame]:
        return {"inner_scores": self.inner_scores, "outer_scores": self.outer_scores, "chosen": self.chosen,
                "models": self.models, "final_model": self.final_model()}


@dataclass
class Cells:
    """Numbers for evaluated folds and for the scores in them.

    Fold number f stands for a (rep, outer, inner), inner 0 being the test fold of outer. The
    scores of component count number m and outcome number k in it have the cell
    ``(f * components + m) * outcomes + k``.
    """

    plans: dict[int, FoldPlan]
    components: list[int]
    n_outcomes: int

    def __post_init__(self):
        self.folds = [
            (rep, outer, inner) for rep, plan in self.plans.items()
            for outer in plan.inner for inner in sorted({0, *plan.inner[outer]})
        ]
        self.number = {fold: f for f, fold in enumerate(self.folds)}

    def evaluated(self, rep: int, a: int) -> list[int]:
        """Folds in which the rows of range a are evaluated."""
        plan = self.plans[rep]
        return [self.number[rep, plan.outer[a], 0]] + [
            self.number[rep, o, inner[a]] for o, inner in plan.inner.items() if inner[a]]

    def of(self, rep: int) -> list[int]:
        """Evaluated folds of a repetition."""
        return [f for f, fold in enumerate(self.folds) if fold[0] == rep]

    def ranges(self) -> dict[int, list[int]]:
        """Per evaluated fold the ranges whose rows it holds."""
        found: dict[int, list[int]] = {f: [] for f in range(len(self.folds))}
        for rep, plan in self.plans.items():
            for a in range(len(plan.outer)):
                for fold in self.evaluated(rep, a):
                    found[fold].append(a)
        return found

    def names(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [((f * len(self.components) + m) * self.n_outcomes + k, *fold, count)
             for f, fold in enumerate(self.folds)
             for m, count in enumerate(self.components) for k in range(self.n_outcomes)],
            "cell int, rep int, outer int, inner int, n_components int")


def fold_medians(located: DataFrame, y_vars: Sequence[str], cells: Cells) -> dict[tuple[int, int], float]:
    """Median of each outcome in each evaluated fold, ``{(fold number, outcome number): median}``."""
    rows = []
    for rep, plan in cells.plans.items():
        lists = ", ".join(
            "array(" + ", ".join(map(str, cells.evaluated(rep, a))) + ")" for a in range(len(plan.outer)))
        rows.append(f"element_at(array({lists}), __range{rep} + 1)")
    values = ", ".join(f"struct({k} AS outcome, CAST({name(y)} AS DOUBLE) AS y)" for k, y in enumerate(y_vars))
    long = located.selectExpr(f"explode(concat({', '.join(rows)})) AS fold", f"array({values}) AS ys").selectExpr(
        "fold", "inline(ys)")
    n_rows, n_ranges = located.count(), max(len(plan.outer) for plan in cells.plans.values())
    # Folds are random, so their medians lie near those of the table; exact_median checks it.
    reach = min(0.5, 0.01 + 2.5 / (n_rows / n_ranges) ** 0.5)
    shares = f"array({0.5 - reach!r}D, {0.5 + reach!r}D)"
    found = located.selectExpr(*[f"percentile_approx(CAST({name(y)} AS DOUBLE), {shares}, 1000)" for y in y_vars]).first()
    brackets = located.sparkSession.createDataFrame(
        [(f, k, *map(float, found[k])) for f in range(len(cells.folds)) for k in range(len(y_vars))],
        "fold int, outcome int, low double, high double")
    medians = exact_median(long, ["fold", "outcome"], "y", staged=True, brackets=brackets)
    return {(r["fold"], r["outcome"]): r["median"] for r in medians.collect()}


def _score_runs(x_vars, y_vars, scaling: Scaling, cells: Cells, coefs: dict, medians: dict, cuts: dict):
    """Per task and chunk of rows: the scores of the models that did not see a row, as runs per cell, class and value range."""
    n_y, n_m = len(y_vars), len(cells.components)
    ranges_in = cells.ranges()
    scores_per_row = max(1, len(cells.folds) * n_m * n_y // max(1, min(len(set(plan.outer)) for plan in cells.plans.values())))
    chunk = max(1, CHUNK_SCORES // scores_per_row)
    none = np.empty(0)

    def scored(x: np.ndarray, y: np.ndarray, ranges: dict[int, np.ndarray]) -> pa.RecordBatch:
        runs: list[tuple] = []
        for rep, plan in cells.plans.items():
            order = np.argsort(ranges[rep], kind="stable")
            starts = np.searchsorted(ranges[rep][order], np.arange(len(plan.outer) + 1))
            for fold in cells.of(rep):
                rows = np.concatenate([order[starts[a]:starts[a + 1]] for a in ranges_in[fold]])
                if not len(rows):
                    continue
                coef, intercept = coefs[fold]
                # Beyond nine digits lies noise of the matrix product, which must
                # not part rows with equal values.
                score = np.round(x[rows] @ coef + intercept, 9)
                for k in range(n_y):
                    label = y[rows, k] > medians[fold, k]
                    for m in range(n_m):
                        cell = (fold * n_m + m) * n_y + k
                        runs += score_runs(cell, label, score[:, m * n_y + k], cuts.get(cell, none))
        return runs_batch(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined():
            x, y, *found = (np.concatenate(part) for part in zip(*held))
            return scored(x, y, dict(zip(cells.plans, found)))

        for batch in batches:
            if batch.num_rows:
                held.append(((dense(batch, x_vars) - scaling.x_mean) / scaling.x_sd, dense(batch, y_vars),
                             *[batch.column(f"__range{rep}").to_numpy(zero_copy_only=False) for rep in cells.plans]))
            if sum(len(part[0]) for part in held) >= chunk:
                yield joined()
                held = []
        if held:
            yield joined()

    return run


def _range_cuts(located: DataFrame, cells: Cells, score, rows_per_range: int) -> dict[int, np.ndarray]:
    """Per cell the limits of value ranges of about ``rows_per_range`` scores; any limits give the same areas.

    ``score`` makes the runs of a table. A share of the rows, as many for each range, places the limits.
    """
    n_rows = located.count()
    largest = n_rows / min(len(set(plan.outer)) for plan in cells.plans.values())
    count = ceil(largest / rows_per_range)
    if count <= 1:
        return {}
    looked_at = located.sample(fraction=min(1.0, ROWS_PER_BOUNDARY * count / n_rows), seed=7)
    shares = "array(" + ", ".join(f"{i / count!r}D" for i in range(1, count)) + ")"
    found = looked_at.mapInArrow(score({}), RUNS).selectExpr("cell", "explode(score) AS score").where("NOT isnan(score)").groupBy("cell").agg(
        F.expr(f"percentile_approx(score, {shares}, {20 * count})").alias("cuts"))
    return {r["cell"]: np.unique(r["cuts"]) for r in found.collect()}


def _coefficients(models: DataFrame, n_x: int, n_y: int, cells: Cells) -> dict:
    """Per evaluated fold the coefficients of all component counts side by side.

    Their size depends on columns, folds and components, not on the number of rows.
    """
    wanted = models.where((F.col("outer") > 0) & F.col("n_components").isin(*cells.components))
    by_model = {
        (r["rep"], r["outer"], r["inner"], r["n_components"]):
            (np.asarray(r["coef"]).reshape(n_x, n_y), np.asarray(r["intercept"]))
        for r in wanted.select("rep", "outer", "inner", "n_components", "coef", "intercept").collect()
    }
    return {
        f: tuple(np.concatenate([by_model[(*fold, m)][part] for m in cells.components], axis=-1) for part in (0, 1))
        for f, fold in enumerate(cells.folds)
    }


def run_plsr_cv(
    df: DataFrame,
    exposure_vars: Sequence[str],
    outcome_vars: Sequence[str],
    covariates: Sequence[str],
    n_components_range: Sequence[int] | None = None,
    outer_folds: int = 8,
    inner_folds: int = 7,
    seed: int = 42,
    n_repetitions: int = 1,
    id_column: str = ID_COLUMN,
    rows_per_range: int = ROWS_PER_RANGE,
) -> CrossValidation:
    """Double cross-validation, the component count chosen by inner AUROC.

    The folds of a repetition cut the key order into short ranges; the cross-products of each
    range are summed in one pass and every training set is a sum of ranges, so that the cost
    of the fits does not grow with the number of folds. A second pass scores each row with the
    models that did not see it; tasks hand on sorted runs of scores, not a row per score. An outcome's label is whether it lies above its median in the
    evaluated fold.
    """
    components = sorted(n_components_range or range(1, 6))
    x_vars = list(dict.fromkeys([*exposure_vars, *covariates]))
    y_vars = list(outcome_vars)
    check_variables(df, x_vars, y_vars)
    base = stage(df.select(*dict.fromkeys([id_column, *x_vars, *y_vars])), "base")
    scaling = scaling_of(base, x_vars, y_vars)
    n_x, n_y = len(x_vars), len(y_vars)

    plans = {
        rep: fold_plan(base, outer_folds, inner_folds, seed + rep - 1, id_column)
        for rep in range(1, n_repetitions + 1)
    }
    # Read several times below, so the ranges are worked out once.
    located = stage(base.select(
        *dict.fromkeys([*x_vars, *y_vars]),
        *[plan.range_of(order_key(plan.seed, F.col(id_column))).alias(f"__range{rep}")
          for rep, plan in plans.items()]), "located")

    per_repetition = max(len(plan.outer) for plan in plans.values()) * (1 + n_x + n_y) ** 2 * 8
    at_once = max(1, TASK_BYTES // per_repetition)
    parts = []
    for start in range(1, n_repetitions + 1, at_once):
        reps = {rep: plans[rep] for rep in range(start, min(start + at_once, n_repetitions + 1))}
        products = cross_products(located, x_vars, y_vars, scaling, [(rep, f"__range{rep}") for rep in reps])
        models = stage(
            solve(products, n_x, n_y, max(components),
                  {rep: (plan.outer, plan.inner) for rep, plan in reps.items()}), "models")
        cells = Cells(reps, components, n_y)
        coefs = _coefficients(models, n_x, n_y, cells)
        medians = fold_medians(located, y_vars, cells)
        score = partial(_score_runs, x_vars, y_vars, scaling, cells, coefs, medians)
        runs = located.mapInArrow(score(_range_cuts(located, cells, score, rows_per_range)), RUNS)
        by_cell = auroc_of_runs(runs).join(F.broadcast(cells.names(df.sparkSession)), "cell")
        fold_scores = stage(
            by_cell.groupBy("rep", "outer", "inner", "n_components").agg(F.avg("auroc").alias("auroc")),
            "fold-scores")
        parts.append((models, fold_scores))
    discard(base, located)
    models = reduce(DataFrame.unionByName, [m for m, _ in parts])
    scores = reduce(DataFrame.unionByName, [s for _, s in parts])

    inner_scores = scores.where(F.col("inner") > 0)
    chosen = best_components(inner_scores)
    outer_scores = (
        scores.where(F.col("inner") == 0).drop("inner")
        .join(F.broadcast(chosen.select("rep", "outer", "n_components")), ["rep", "outer", "n_components"])
    )
    final = mode_components(chosen).first()["n_components"]
    return CrossValidation(inner_scores, outer_scores, chosen, models, final, x_vars, y_vars, scaling)
