"""Imputation: invariants, matching against brute force, determinism."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import impute as chained
from cohortloom.operators.matching import match_donors
from cohortloom.plans import impute as plan


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(6)
    n = 240
    x = rng.normal(size=n)
    data = pd.DataFrame({"sample": np.arange(n), "Cycle": np.arange(n) % 3, "x": x, "y": 3 * x + rng.normal(0, 0.1, n),
                         "z": rng.normal(size=n), "code": (x > 0).astype(int)})
    data.loc[rng.random(n) < 0.2, "y"] = np.nan
    data.loc[rng.random(n) < 0.3, "z"] = np.nan
    data.loc[rng.random(n) < 0.1, "code"] = np.nan
    return data


def nulls(spark, data):
    df = spark.createDataFrame(data)
    return df.select(*[F.nullif(c, F.lit(float("nan"))).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


SETTINGS = {"n_datasets": 2, "n_iterations": 2, "seed": 3}


def test_invariants(spark, frame):
    result = chained.impute(nulls(spark, frame), **SETTINGS)
    assert result.targets == ["code", "y", "z"]
    done = result.completed().toPandas()
    assert list(done.columns) == ["dataset", "sample", "Cycle", "x", "y", "z", "code"]
    assert len(done) == 2 * len(frame) and not done.isna().any().any()
    for _, part in done.groupby("dataset"):
        part = part.sort_values("sample").reset_index(drop=True)
        assert (part["Cycle"] == frame["Cycle"]).all()
        for t in result.targets:
            seen = frame[t].notna()
            assert (part.loc[seen, t] == frame.loc[seen, t]).all()
            assert set(part[t]) <= set(frame.loc[seen, t])
    assert result.trace.count() == 2 * 2 * 3
    filled = {(r["iteration"], r["variable"]): r["n"] for r in result.trace.where("dataset = 1").collect()}
    assert filled[2, "y"] == frame["y"].isna().sum()
    a, b = (part.set_index("sample")["z"].sort_index() for _, part in done.groupby("dataset"))
    assert (a != b).any()
    predictors = result.importance.where("variable = 'y' AND dataset = 1").toPandas().set_index("predictor")
    assert predictors.coefficient.abs().idxmax() == "x"
    bars = result.distributions()
    assert bars.where("imputed AND variable = 'y' AND dataset = 2").agg(F.sum("n")).first()[0] == filled[2, "y"]
    assert set(result.penalties) == {"code", "y", "z"}


def test_same_result_whatever_the_partitioning(spark, frame):
    df = nulls(spark, frame)
    one = chained.impute(df.coalesce(1), **SETTINGS).completed().toPandas()
    many = chained.impute(df.repartition(9, "x"), **SETTINGS).completed().toPandas()
    order = ["dataset", "sample"]
    pd.testing.assert_frame_equal(one.sort_values(order).reset_index(drop=True),
                                  many.sort_values(order).reset_index(drop=True))


def test_one_variable_at_a_time_and_chosen_variables(spark, frame):
    strict = chained.impute(nulls(spark, frame), n_datasets=1, n_iterations=1, batch=1, tune=False)
    assert strict.completed().where("y IS NULL OR z IS NULL OR code IS NULL").count() == 0
    assert strict.trace.count() == 3
    some = chained.impute(nulls(spark, frame), n_datasets=1, n_iterations=1, tune=False, n_random_variables=1,
                          always=["x"])
    assert len(some.completed().columns) == 5
    full = chained.impute(nulls(spark, frame[["sample", "x"]]), n_datasets=2, n_iterations=1)
    assert full.completed().count() == 2 * len(frame) and full.trace.count() == 0
    with pytest.raises(ValueError, match="no observed value"):
        chained.impute(nulls(spark, frame).withColumn("empty", F.lit(None).cast("double")))


def test_masked_cells_are_predicted(spark, frame):
    complete = frame.dropna()[["sample", "x", "y", "z"]]
    errors = {r["variable"]: r for r in chained.masked_error(
        nulls(spark, complete), ["y", "z"], 0.3, n_datasets=1, n_iterations=3, tune=False).collect()}
    assert errors["y"]["rmse"] < 0.35 * complete["y"].std()
    assert errors["z"]["rmse"] > 0.7 * complete["z"].std()
    assert errors["y"]["mae"] <= errors["y"]["rmse"]


def test_every_cell_is_scored_once_by_folds(spark, frame):
    data = nulls(spark, frame[["sample", "x", "y", "z"]])
    errors = chained.cross_validated_error(data, ["y", "z"], 3, seed=5, n_iterations=2, tune=False).toPandas()
    fold = lambda v, i: int(hashlib.md5(f"5:{v}:{i}".encode()).hexdigest()[:6], 16) % 3 + 1
    for v in "yz":
        expected = pd.Series([fold(v, i) for i in frame.loc[frame[v].notna(), "sample"]]).value_counts().to_dict()
        assert errors[errors.variable == v].set_index("fold").n.to_dict() == expected
    assert (errors.dataset == 1).all()
    assert (errors[errors.variable == "y"].rmse < 0.4 * frame.y.std()).all()
    assert (errors[errors.variable == "z"].rmse > 0.7 * frame.z.std()).all()


def test_hidden_cells_reach_neither_start_values_nor_donors(spark):
    """Values of a fold are marked by their size: what stands in for them must come from the other folds."""
    fold = [int(hashlib.md5(f"1:v:{i}".encode()).hexdigest()[:6], 16) % 2 for i in range(60)]
    data = pd.DataFrame({"sample": range(60), "v": [i + 1000.0 * f for i, f in enumerate(fold)], "w": np.arange(60.0) % 7})
    result = chained.impute(spark.createDataFrame(data), n_datasets=1, n_iterations=1, seed=1, tune=False, held=["v"], folds=2)
    done = result.table.where("__m_v").toPandas()
    assert len(done) == 60 and set(done["sample"]) == set(range(60))
    for r in done.itertuples():
        assert fold[r.sample] == r.dataset - 1 and (r.v >= 1000) == (fold[r.sample] == 0)
    base = spark.createDataFrame(data)
    state = spark.createDataFrame([(d, i, None if fold[i] == d - 1 else v) for d in (1, 2) for i, v in enumerate(data.v)],
                                  "dataset int, sample long, v double")
    start = chained.held_start_values(state, base, ["v"], 2, 1, "sample").collect()
    assert len(start) == 60 and all((r["value"] >= 1000) == (r["dataset"] == 1) for r in start)


def test_held_variables_need_folds(spark, frame):
    data = nulls(spark, frame[["sample", "x", "y"]])
    for wrong in ({"held": ["y"]}, {"folds": 3}, {"held": ["y"], "folds": 1}, {"held": ["q"], "folds": 2}):
        with pytest.raises(ValueError, match="held"):
            chained.impute(data, **wrong)
    lone = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, None, 5.0)], "sample long, v double, w double")
    with pytest.raises(ValueError, match="outside of fold"):
        chained.impute(lone, held=["v"], folds=2, tune=False)


def test_tuning_prefers_little_shrinkage_of_a_strong_predictor(spark, frame):
    result = chained.impute(nulls(spark, frame), n_datasets=1, n_iterations=1)
    assert result.penalties["y"] <= 1e-3


@pytest.mark.parametrize("rows_per_range", [25, 10**6])
def test_matching_against_brute_force(spark, rows_per_range):
    rng = np.random.default_rng(9)
    n = 200
    data = pd.DataFrame({"g": rng.integers(0, 2, n), "id": np.arange(n), "p": rng.integers(0, 40, n) * 1.0,
                         "v": rng.normal(size=n)})
    data.loc[data.index % 3 == 0, "p"] = 7.0  # a crowded prediction
    data.loc[rng.random(n) < 0.3, "v"] = np.nan
    found = match_donors(nulls(spark, data).repartition(5), ["g"], "id", "p", "v", 5, seed=1,
                         rows_per_range=rows_per_range).collect()
    data["h"] = [hashlib.md5(f"1:{i}".encode()).hexdigest() for i in data.id]
    expected = {}
    for g, part in data.sort_values(["g", "p", "h"]).groupby("g"):
        donors = part[part.v.notna()].reset_index(drop=True)
        before = part.v.notna().cumsum()
        for (_, row), place in zip(part.iterrows(), before):
            if np.isnan(row.v):
                near = donors.loc[max(place - 5, 0):place + 4]
                order = np.lexsort((near.index, (near.p - row.p).abs()))[:5]
                draw = int(hashlib.md5(f"1:{g}:{int(row.id)}".encode()).hexdigest()[:6], 16) % len(order)
                expected[int(row.id)] = near.iloc[order[draw]].v
    assert {r["id"]: r["v"] for r in found} == expected


def test_stage(spark, frame, tmp_path):
    cohort = plan.impute_cohort(nulls(spark, frame), str(tmp_path / "out"), 2, 1, tune_parameters=False)
    assert cohort.correlations.count() == 2 * 6
    assert (tmp_path / "out" / "datasets" / "dataset=2").exists()
    back = plan.resume(spark, str(tmp_path / "out"))
    assert back["datasets"].columns[:2] == ["sample", "Cycle"]
    assert back["datasets"].select("dataset").distinct().count() == 2


@pytest.mark.parametrize("rows_per_range", [10, 50])
def test_matching_without_predictions(spark, rows_per_range):
    rows = [(i, [None, float("nan"), float(i % 9)][i % 3], float(i) if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, prediction double, value double")

    def found(n):
        return {r["id"]: r["value"] for r in match_donors(df, [], "id", rows_per_range=n).collect()}

    assert found(rows_per_range) == found(10**6) and len(found(10**6)) == 50


def test_chain_does_not_depend_on_memory(spark, frame, monkeypatch):
    def completed():
        table = chained.impute(nulls(spark, frame), **SETTINGS).completed().toPandas()
        return table.sort_values(["dataset", "sample"]).reset_index(drop=True)

    usual = completed()
    monkeypatch.setattr(chained, "TASK_BYTES", 1)
    pd.testing.assert_frame_equal(usual, completed())
    strict = chained.impute(nulls(spark, frame), batch=1, **SETTINGS).completed().toPandas()
    pd.testing.assert_frame_equal(usual, strict.sort_values(["dataset", "sample"]).reset_index(drop=True))


def test_repeated_ids_are_an_error(spark, frame):
    twice = nulls(spark, frame).union(nulls(spark, frame).limit(1))
    with pytest.raises(ValueError, match="once"):
        chained.impute(twice, **SETTINGS)


def test_few_tables_are_left(spark, frame):
    import os

    from cohortloom.staging import shared_folder

    folder = f"{shared_folder(spark)}/cohortloom/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    result = chained.impute(nulls(spark, frame), **SETTINGS)
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == ["importance", "penalties", "state", "trace"] and result.trace.count() == 12
