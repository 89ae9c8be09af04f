"""Areas under the curve from packed scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import order_key
from cohortloom.operators import crossval, folds, ranks


@pytest.mark.parametrize("values", ["apart", "tied", "one class", "nan"])
def test_runs_give_the_areas_of_single_scores(spark, values):
    rng = np.random.default_rng(5)
    score, label = np.round(rng.normal(size=3000), 2), rng.random(3000) < 0.4
    if values == "apart":
        score = rng.normal(size=3000)
    elif values == "tied":
        score[:2500] = np.round(score[:2500], 0)
    elif values == "one class":
        label[:] = True
    else:
        score[::7] = np.nan
    cells, cuts = rng.integers(0, 3, 3000), np.array([-0.5, 0.0, 1.0])
    # Three tasks' worth of runs.
    runs = [r for part in range(3) for c in range(3)
            for r in ranks.score_runs(c, *(x[(cells == c) & (np.arange(3000) % 3 == part)] for x in (label, score)), cuts)]
    packed = spark.createDataFrame(
        [(c, at, p, s.tolist(), None if n is None else n.tolist()) for c, at, p, s, n in runs], ranks.RUNS)
    rows = spark.createDataFrame([(int(c), int(l), float(s)) for c, l, s in zip(cells, label, score)], "cell int, label int, score double")
    found = {r["cell"]: r["auroc"] for r in ranks.auroc_of_runs(packed).collect()}
    assert found == {r["cell"]: r["auroc"] for r in ranks.auroc(rows, ["cell"]).collect()}
    if values == "tied":
        assert any(n is not None for *_, n in runs)


def test_value_ranges_do_not_show_in_the_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 2))
    y = x @ [1.0, 0.5] + rng.normal(size=4000)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(np.column_stack([x, y]))], "sample long, a double, b double, y double")

    def scores(**options):
        result = crossval.run_plsr_cv(df, ["a", "b"], ["y"], [], [1, 2], 4, 3, **options)
        return sorted(tuple(r) for r in result.inner_scores.collect())

    assert scores(rows_per_range=200) == scores()


def test_key_of_a_row_is_worked_out_once(spark):
    df = spark.range(500).withColumnRenamed("id", "sample")
    plan = folds.fold_plan(df, 5, 4, 42)
    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return text

    key = F.udf(counted, "string").asNondeterministic()(order_key(42, F.col("sample")))
    located = df.select("sample", order_key(42, F.col("sample")).alias("k"), plan.range_of(order_key(42, F.col("sample"))).alias("a")).collect()
    assert all(r["a"] == sum(cut <= r["k"] for cut in plan.cuts) for r in located)
    df.select(plan.range_of(key).alias("a")).collect()
    assert calls.value == 500
