"""Order statistics, folds, latent regression and its cross-validation against plain numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import crossval, folds, linear, pls, ranks, scores
from cohortloom.plans import plsr


def md5_order(ids, seed):
    return sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest())


def split_sizes(n, k):
    return [n // k + (1 if f < n % k else 0) for f in range(k)]


def fold_of(ids, k, seed):
    order = md5_order(ids, seed)
    found = np.empty(len(ids), int)
    start = 0
    for f, size in enumerate(split_sizes(len(ids), k), start=1):
        found[order[start:start + size]] = f
        start += size
    return found


def area(label, score):
    positive, negative = score[label == 1], score[label == 0]
    if not len(positive) or not len(negative):
        return 0.5
    d = positive[:, None] - negative[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def nipals(x, y, n_components):
    """Textbook deflation, columns scaled with ddof 1; coefficients for raw columns."""
    xm, ym, xs, ys = x.mean(0), y.mean(0), x.std(0, ddof=1), y.std(0, ddof=1)
    xs, ys = np.where(xs == 0, 1, xs), np.where(ys == 0, 1, ys)
    e, f = (x - xm) / xs, (y - ym) / ys
    ws, ps, qs = [], [], []
    for _ in range(n_components):
        u = f[:, np.argmax(f.var(0))]
        for _ in range(2000):
            w = e.T @ u
            w /= np.linalg.norm(w)
            t = e @ w
            q = f.T @ t / (t @ t)
            new = f @ q / (q @ q)
            if np.linalg.norm(new - u) < 1e-14 * np.linalg.norm(new):
                break
            u = new
        w *= np.sign(w[np.argmax(np.abs(w))])
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
    coef = w @ np.linalg.inv(p.T @ w) @ q.T
    return (coef * ys) / xs[:, None], ym - xm @ ((coef * ys) / xs[:, None]), w, p, q


def cohort(n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 3, 1] + [0, 100, 5, 0, 2]
    x[:, 3] += x[:, 0]
    y = np.column_stack([x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=n), 20 * x[:, 2] - x[:, 4] + rng.normal(size=n)])
    frame = pd.DataFrame(np.column_stack([x, y]), columns=["x1", "x2", "x3", "c1", "c2", "y1", "y2"])
    frame.insert(0, "sample", np.arange(1000, 1000 + n))
    return frame


X, Y = ["x1", "x2", "x3", "c1", "c2"], ["y1", "y2"]


@pytest.mark.parametrize("n, k", [(10, 3), (8, 8), (23, 5)])
def test_folds_are_tiles_of_the_key_order(spark, n, k):
    ids = list(range(100, 100 + n))
    df = spark.createDataFrame([(i,) for i in ids], "sample bigint").repartition(4)
    found = {r["sample"]: r["fold"] for r in folds.assign_folds(df, k, seed=7).collect()}
    assert [found[i] for i in ids] == list(fold_of(ids, k, 7))
    with pytest.raises(ValueError):
        folds.assign_folds(df, n + 1)


def test_nested_folds(spark):
    ids = [f"p{i}" for i in range(53)]
    df = spark.createDataFrame([(i,) for i in ids], "sample string")
    rows = folds.nested_folds(df, 4, 3, seed=5).collect()
    outer = fold_of(ids, 4, 5)
    assert len(rows) == 53 * 3
    for o in range(1, 5):
        training = [i for i, f in zip(ids, outer) if f != o]
        inner = dict(zip(training, fold_of(training, 3, 5)))
        assert {r["sample"]: r["inner_fold"] for r in rows if r["outer_fold"] == o} == inner


@pytest.mark.parametrize("rows_per_range", [10, 10**6])
def test_order_statistics(spark, rows_per_range):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": rng.integers(0, 60, 400) / 4.0,
                          "label": rng.integers(0, 2, 400)})
    frame.loc[frame.g == 2, "label"] = 1
    frame.loc[frame.index[:130], "v"] = 7.25  # a third of the rows share one value
    df = spark.createDataFrame(frame).repartition(5)
    medians = {r["g"]: r["median"] for r in ranks.exact_median(
        df, ["g"], "v", rows_per_range=rows_per_range).collect()}
    assert medians == {g: part.median() for g, part in frame.v.groupby(frame.g)}
    areas = {r["g"]: r["auroc"] for r in ranks.auroc(df, ["g"], "label", "v", rows_per_range).collect()}
    for g, part in frame.groupby("g"):
        assert areas[g] == pytest.approx(area(part.label.to_numpy(), part.v.to_numpy()))
    assert ranks.exact_median(df, [], "v", rows_per_range=rows_per_range).first()[0] == frame.v.median()
    assert ranks.auroc(df, [], "label", "v", rows_per_range).first()[0] == pytest.approx(
        area(frame.label.to_numpy(), frame.v.to_numpy()))


def test_median_with_a_bracket_that_misses(spark):
    frame = pd.DataFrame({"g": np.arange(101) % 2, "v": np.arange(101) * 1.0})
    df = spark.createDataFrame(frame)
    wrong = spark.createDataFrame([(0, 90.0, 95.0), (1, 40.0, 60.0)], "g bigint, low double, high double")
    found = ranks.exact_median(df, ["g"], "v", rows_per_range=10, brackets=wrong)
    assert {r["g"]: r["median"] for r in found.collect()} == {0: 50.0, 1: 50.0}


@pytest.mark.parametrize("rows_per_range", [20, 10**6])
def test_running_totals_with_ties(spark, rows_per_range):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 300), "id": np.arange(300), "v": rng.integers(0, 30, 300) * 1.0,
                          "w": rng.integers(0, 5, 300)})
    frame.loc[frame.index % 3 == 0, "v"] = 11.0
    df = spark.createDataFrame(frame).repartition(6)
    found = ranks.running_totals(df, ["g"], "v", ["w"], tie="id", seed=9, rows_per_range=rows_per_range).toPandas()
    frame["h"] = [hashlib.md5(f"9:{i}".encode()).hexdigest() for i in frame.id]
    ordered = frame.sort_values(["g", "v", "h"])
    ordered["before"] = ordered.groupby("g").w.cumsum() - ordered.w
    expected = ordered.set_index("id").before
    assert (found.set_index("id").before_w.sort_index() == expected.sort_index()).all()


def test_fit_matches_deflation(spark):
    frame = cohort()
    models, scaling = pls.fit_table(spark.createDataFrame(frame).repartition(3), X, Y, 4)
    models = models.cache()
    for a in (1, 2, 4):
        coef, intercept, w, p, q = nipals(frame[X].to_numpy(), frame[Y].to_numpy(), a)
        predicted = pls.predict(spark.createDataFrame(frame), models, scaling, X, Y, a).toPandas()
        expected = frame[X].to_numpy() @ coef + intercept
        assert np.allclose(predicted[["pred_y1", "pred_y2"]], expected, atol=1e-6)
    loadings = pls.loadings_table(models, X).toPandas().pivot(index="variable", columns="component", values="loading")
    assert np.allclose(loadings.loc[X].to_numpy(), p, atol=1e-5)
    y_loadings = pls.loadings_table(models, Y, "y_loading").toPandas().pivot(
        index="variable", columns="component", values="loading")
    assert np.allclose(y_loadings.loc[Y].to_numpy(), q, atol=1e-5)
    scored = pls.transform(spark.createDataFrame(frame), models, scaling, X, 4, len(frame)).toPandas()
    shares = [r["x_explained"] for r in models.orderBy("n_components").collect()]
    variances = [scored[f"score_{a}"].var(ddof=0) / len(X) for a in range(1, 5)]
    assert np.allclose(shares, variances)
    assert scores.top_loadings(pls.loadings_table(models, X), 2).count() == 2


def test_more_components_than_columns(spark):
    frame = cohort(40)
    models, _ = pls.fit_table(spark.createDataFrame(frame), ["x1", "x2"], ["y1"], 4)
    rows = models.orderBy("n_components").collect()
    assert len(rows) == 4 and rows[3]["coef"] == rows[1]["coef"] and rows[3]["x_explained"] == 0.0


def test_guards(spark):
    df = spark.createDataFrame(cohort(30))
    with pytest.raises(ValueError, match="not in the table"):
        crossval.run_plsr_cv(df, ["x1", "absent"], ["y1"], [])
    with pytest.raises(ValueError, match="missing values"):
        crossval.run_plsr_cv(df.withColumn("x1", F.when(F.col("sample") > 1003, F.col("x1"))), ["x1"], ["y1"], [])


def brute_force_cv(frame, components, outer_k, inner_k, seed):
    """Every fit and score one by one."""
    ids = list(frame["sample"])
    x, y = frame[X].to_numpy(), frame[Y].to_numpy()
    outer = fold_of(ids, outer_k, seed)

    def score(train, test, a):
        coef, intercept, *_ = nipals(x[train], y[train], a)
        predicted = x[test] @ coef + intercept
        return np.mean([area((y[test, k] > np.median(y[test, k])).astype(int), predicted[:, k]) for k in range(2)])

    inner_scores, best, outer_scores = {}, {}, {}
    for o in range(1, outer_k + 1):
        training = np.flatnonzero(outer != o)
        inner = fold_of([ids[i] for i in training], inner_k, seed)
        means = {}
        for a in components:
            values = [score(training[inner != i], training[inner == i], a) for i in range(1, inner_k + 1)]
            inner_scores.update({(o, i + 1, a): v for i, v in enumerate(values)})
            means[a] = round(np.mean(values), 12)
        best[o] = max(components, key=lambda a: (means[a], -a))
        outer_scores[o] = score(training, np.flatnonzero(outer == o), best[o])
    return inner_scores, best, outer_scores


def test_cross_validation_against_brute_force(spark):
    frame = cohort(130)
    df = spark.createDataFrame(frame).repartition(5)
    result = crossval.run_plsr_cv(df, X[:3], Y, X[3:], [1, 2, 3], 4, 3, seed=11, n_repetitions=2)
    inner = {(r["rep"], r["outer"], r["inner"], r["n_components"]): r["auroc"] for r in result.inner_scores.collect()}
    chosen = {(r["rep"], r["outer"]): r["n_components"] for r in result.chosen.collect()}
    outer = {(r["rep"], r["outer"]): r["auroc"] for r in result.outer_scores.collect()}
    picks = []
    for rep in (1, 2):
        expected_inner, best, expected_outer = brute_force_cv(frame, [1, 2, 3], 4, 3, 11 + rep - 1)
        for (o, i, a), v in expected_inner.items():
            assert inner[rep, o, i, a] == pytest.approx(v)
        for o in best:
            assert chosen[rep, o] == best[o]
            assert outer[rep, o] == pytest.approx(expected_outer[o])
            picks.append(best[o])
    assert result.final_n_components == max(dict.fromkeys(picks), key=picks.count)
    coef, *_ = nipals(frame[X].to_numpy(), frame[Y].to_numpy(), result.final_n_components)
    assert result.final_model().count() == result.final_n_components
    top = max(outer, key=lambda k: (round(outer[k], 12), -k[0], -k[1]))
    assert {(r["rep"], r["outer"]) for r in result.best_model().collect()} == {top}
    report = plsr.report(result)
    assert report["outer_summary"].count() == 4
    assert report["inner_summary"].count() == 3
    assert report["component_frequency"].agg(F.sum("n")).first()[0] == 8
    assert set(result.tables()) == {"inner_scores", "outer_scores", "chosen", "models", "final_model"}


def test_passes_of_repetitions(spark, monkeypatch):
    frame = cohort(60)
    df = spark.createDataFrame(frame)
    once = crossval.run_plsr_cv(df, X, ["y1"], [], [1, 2], 3, 2, n_repetitions=2)
    monkeypatch.setattr(crossval, "TASK_BYTES", 1)
    apart = crossval.run_plsr_cv(df.repartition(7), X, ["y1"], [], [1, 2], 3, 2, n_repetitions=2)

    def rows(result):
        return sorted((r["rep"], r["outer"], r["inner"], r["n_components"], round(r["auroc"], 9))
                      for r in result.inner_scores.collect())

    assert rows(once) == rows(apart)


def test_roles_of_the_analysis(spark):
    frame = cohort(40).assign(Cycle=1)
    result = plsr.run_plsr_analysis(spark.createDataFrame(frame), ["y1"], ["c1", "c2"], 2, 3, 2, 1)
    assert result.x_vars == ["x1", "x2", "x3", "y2", "c1", "c2"]


def test_linear_models(spark):
    frame = cohort(50)
    frame.loc[frame.index[:5], "x1"] = np.nan
    df = spark.createDataFrame(frame)
    df = df.withColumn("x1", F.nullif("x1", F.lit(float("nan"))))
    rows = {(r["outcome"], r["exposure"]): r for r in linear.run_linear_models(
        df, ["y1", "y2"], ["x1", "x2"], ["c1", "c2"]).collect()}
    assert len(rows) == 4
    for (outcome, exposure), r in rows.items():
        part = frame[[outcome, exposure, "c1", "c2"]].dropna()
        a = np.column_stack([np.ones(len(part)), part[[exposure, "c1", "c2"]]])
        beta, *_ = np.linalg.lstsq(a, part[outcome], rcond=None)
        residual = part[outcome] - a @ beta
        error = np.sqrt(residual @ residual / (len(part) - 4) * np.linalg.inv(a.T @ a)[1, 1])
        assert r["n"] == len(part)
        assert (r["coef"], r["std_error"]) == (pytest.approx(beta[1]), pytest.approx(error))
        assert r["ci_lower"] < r["coef"] < r["ci_upper"]
    same = linear.run_linear_models(df.withColumn("twin", F.col("c1") * 2), ["y1"], ["twin"], ["c1"]).first()
    assert same["coef"] is None


@pytest.mark.parametrize("t, freedom, p", [(2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (12.7062, 1, 0.05),
                                           (0.0, 5, 1.0), (4.0321, 5, 0.01)])
def test_student(t, freedom, p):
    assert linear.two_sided_p(t, freedom) == pytest.approx(p, abs=2e-6)
    if p < 1:
        assert linear.t_quantile(1 - p, freedom) == pytest.approx(t, rel=1e-4)


def odd_scores(spark):
    """Scores with NULL, NaN, infinity and many ties, in two groups and one without a key."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        value = [None, float("nan"), float("inf"), 1.0, float(rng.integers(0, 30))][int(rng.integers(0, 5))]
        rows.append((i, [0, 1, None][i % 3], value, int(rng.integers(0, 2))))
    return spark.createDataFrame(rows, "id long, g int, v double, label int")


@pytest.mark.parametrize("most_ranges", [2000, 3])
@pytest.mark.parametrize("rows_per_range", [10, 50])
def test_missing_order_values_keep_their_place(spark, monkeypatch, rows_per_range, most_ranges):
    monkeypatch.setattr(ranks, "MAX_RANGES", most_ranges)
    df = odd_scores(spark)

    def total(**options):
        found = ranks.running_totals(df.withColumn("w", F.lit(1)), ["g"], "v", ["w"], tie="id", **options)
        return {r["id"]: r["before_w"] for r in found.collect()}

    def area(**options):
        return {r["g"]: round(r["auroc"], 12) for r in ranks.auroc(df, ["g"], "label", "v", **options).collect()}

    def median(**options):
        return {r["g"]: r["median"] for r in ranks.exact_median(df.where("NOT isnan(v)"), ["g"], "v", **options).collect()}

    assert total(rows_per_range=rows_per_range) == total(rows_per_range=10**6)
    assert area(rows_per_range=rows_per_range) == area(rows_per_range=10**6)
    assert median(rows_per_range=rows_per_range) == median(rows_per_range=10**6)


def test_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_RANGES", 4)
    df = spark.range(4000).selectExpr("id", "CAST(pmod(id * 7919, 4000) AS DOUBLE) AS v")
    sizes = [r["count"] for r in ranks._value_ranges(df, "v", 4000, 100).groupBy("__range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 400
