"""Imputation and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import impute as chained
from cohortloom.operators.linear import run_linear_models
from cohortloom.operators.matching import match_donors
from cohortloom.operators.moments import correlation
from cohortloom.operators.transform import column_moments
from cohortloom.plans.panel import measure_panel, survey_panel, with_panel
from cohortloom.staging import stage

VARIABLES = ["outcome", "cov_bal", "x_qty", "x_price", "x_gap", "x_prio"]
TARGETS = ["x_qty", "x_price", "x_gap"]


def _panel(spark, sf_dir):
    return stage(survey_panel(spark, sf_dir).select("sample", "Cycle", *VARIABLES), "panel")


def initial_fill(spark, sf_dir):
    """Random observed values in the missing cells of two datasets."""
    panel = _panel(spark, sf_dir)
    moments = column_moments(panel, TARGETS)
    return chained.start_values(panel, TARGETS, {t: moments[t][0] for t in TARGETS}, 2, 42, "sample")


def pmm_match(spark, sf_dir):
    """Quantities of orders without one, from orders of similar total, within a priority."""
    panel = survey_panel(spark, sf_dir).select("sample", "x_prio", "x_qty", "outcome")
    return match_donors(panel, ["x_prio"], "sample", "outcome", "x_qty", n_donors=5, seed=42)


def _imputed(spark, sf_dir, **options):
    panel = _panel(spark, sf_dir)
    settings = {"n_datasets": 2, "n_iterations": 2, "seed": 42, "tune": False, **options}
    return panel, chained.impute(panel, **settings)


def mice_invariants(spark, sf_dir):
    """Per dataset: rows, values still missing, observed cells that changed, values never observed."""
    return _invariants(*_imputed(spark, sf_dir))


def mice_tree_invariants(spark, sf_dir):
    """The same of five datasets after five iterations with trees of tuned depth."""
    return _invariants(*_imputed(spark, sf_dir, n_datasets=5, n_iterations=5, tune=True, method="tree"))


def mice_tree_importance(spark, sf_dir):
    """The predictor whose splits gain most, per dataset, for a variable that steps up on both sides of a range of the outcome."""
    step = F.when(F.abs(F.col("outcome") - 150_000) > 60_000, 5.0).otherwise(0.0) + F.col("cov_bal") / 1e6
    panel = survey_panel(spark, sf_dir).select(
        "sample", "Cycle", "outcome", "cov_bal", "x_prio", F.when(F.col("sample") % 3 != 0, step).alias("x_step"))
    result = chained.impute(stage(panel, "panel"), n_datasets=5, n_iterations=5, seed=42, method="tree")
    return result.importance.groupBy("dataset", "variable").agg(F.max_by("predictor", "gain").alias("predictor"))


def _invariants(panel, result):
    table = result.completed()
    original = panel.select("sample", *[F.col(t).alias(f"o_{t}") for t in TARGETS])
    joined = table.join(original, "sample")
    missing = sum((F.col(v).isNull().cast("bigint") for v in VARIABLES), F.lit(0))
    changed = sum(((F.col(f"o_{t}").isNotNull() & (F.col(f"o_{t}") != F.col(t))).cast("bigint") for t in TARGETS),
                  F.lit(0))
    counts = joined.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample").alias("n_samples"),
        F.sum(missing).cast("bigint").alias("n_missing"), F.sum(changed).cast("bigint").alias("n_changed"))
    values = table.select("dataset", F.inline(F.array(*[
        F.struct(F.lit(t).alias("variable"), F.col(t).alias("value")) for t in TARGETS]))).distinct()
    observed = panel.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("variable"), F.col(t).alias("value")) for t in TARGETS]))).distinct()
    foreign = values.join(observed, ["variable", "value"], "left_anti").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_foreign"))
    return counts.join(foreign, "dataset", "left").withColumn("n_foreign", F.coalesce("n_foreign", F.lit(0)))


def mice_observed(spark, sf_dir):
    """The cells that were observed come back unchanged in every dataset."""
    _, result = _imputed(spark, sf_dir, n_iterations=1)
    return result.table.select("dataset", "sample", "Cycle", *[
        F.when(~F.col(chained.flag(t)), F.col(t)).alias(t) for t in TARGETS])


def mice_trace(spark, sf_dir):
    """Imputed cells per dataset, iteration and variable."""
    _, result = _imputed(spark, sf_dir)
    return result.trace.select("dataset", "iteration", "variable", "n")


def mice_trace_moments(spark, sf_dir):
    _, result = _imputed(spark, sf_dir)
    return result.trace


def mice_distributions(spark, sf_dir):
    """Values per dataset, variable and kind in the diagnostic histograms."""
    _, result = _imputed(spark, sf_dir, n_iterations=1)
    return result.distributions().groupBy("dataset", "variable", "imputed").agg(
        F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("bins"))


def mice_importance(spark, sf_dir):
    _, result = _imputed(spark, sf_dir, n_iterations=1)
    return result.importance


def mice_tuning(spark, sf_dir):
    """The penalty that the held-out rows choose per variable, in a whole tuned run."""
    _, result = _imputed(spark, sf_dir, n_datasets=1, n_iterations=1, tune=True)
    return result.tuned


def mice_correlation(spark, sf_dir):
    _, result = _imputed(spark, sf_dir, n_iterations=1)
    return correlation(result.completed(), VARIABLES, ["dataset"])


def masked_error(spark, sf_dir):
    panel = measure_panel(spark, sf_dir).select("sample", "y_price", "x_qty", "x_order")
    return chained.masked_error(panel, ["x_qty", "x_order"], 0.1, n_datasets=1, n_iterations=1, tune=False).select(
        "variable", "n", "mae", "rmse")


def imputation_cv(spark, sf_dir):
    """Every observed cell of two variables is imputed from the other four folds, as trees and iterations are by default; counts and bounds of errors."""
    panel = stage(measure_panel(spark, sf_dir).select("sample", "y_price", "x_qty", "x_order"), "panel")
    errors = chained.cross_validated_error(panel, ["x_qty", "x_order"], method="tree")
    limits = panel.agg(*[(F.max(v) - F.min(v)).alias(v) for v in ("x_qty", "x_order")]).first()
    width = F.when(F.col("variable") == "x_qty", F.lit(float(limits["x_qty"]))).otherwise(F.lit(float(limits["x_order"])))
    return errors.select("variable", "fold", "n", ((F.col("mae") <= F.col("rmse") + 1e-9) & (F.col("rmse") <= width)).alias("bounded"))


def linear_models(spark, sf_dir):
    models = run_linear_models(survey_panel(spark, sf_dir), ["outcome", "x_price"], ["x_qty", "x_gap"], ["cov_bal"])
    return models.select("outcome", "exposure", "n", F.round("coef", 4).alias("coef"),
                         F.round("std_error", 4).alias("std_error"), F.round("t", 5).alias("t"))


def linear_model_intervals(spark, sf_dir):
    return run_linear_models(survey_panel(spark, sf_dir), ["outcome"], ["x_qty", "x_price", "x_gap"],
                             ["cov_bal", "x_prio"])


QUERIES = {f.__name__: f for f in (
    initial_fill, pmm_match, mice_invariants, mice_tree_invariants, mice_tree_importance, mice_observed, mice_trace, mice_trace_moments, mice_distributions,
    mice_importance, mice_tuning, mice_correlation, masked_error, imputation_cv, linear_models, linear_model_intervals,
)}

_CELLS = " UNION ALL ".join(
    f"SELECT sample, '{t}' AS variable, {t}::DOUBLE AS value FROM panel" for t in TARGETS)
_DATASETS = "(SELECT unnest(range(1, 3))::INTEGER AS dataset)"

ORACLES = {
    "initial_fill": with_panel(
        """SELECT dataset, sample, variable, value FROM (
             SELECT dataset, sample, c.variable,
               ('0x' || substr(md5('42:' || dataset || ':' || sample || ':' || c.variable), 1, 12))::BIGINT % n AS place
             FROM cells c JOIN (SELECT variable, COUNT(value) AS n FROM cells GROUP BY variable) USING (variable), """
        + _DATASETS + """ WHERE value IS NULL) JOIN (
             SELECT variable, value,
               ROW_NUMBER() OVER (PARTITION BY variable ORDER BY md5('42:' || sample), sample) - 1 AS place
             FROM cells WHERE value IS NOT NULL) USING (variable, place)""",
        f"cells AS ({_CELLS})"),
    "pmm_match": with_panel(
        """SELECT x_prio, sample, value AS x_qty FROM (
             SELECT s.x_prio, s.sample, d.x_qty AS value,
               ROW_NUMBER() OVER (PARTITION BY s.x_prio, s.sample ORDER BY ABS(d.outcome - s.outcome), d.before) AS r,
               LEAST(COUNT(*) OVER (PARTITION BY s.x_prio, s.sample), 5) AS size
             FROM placed s JOIN placed d ON d.x_prio = s.x_prio AND d.before BETWEEN s.before - 5 AND s.before + 4
             WHERE s.x_qty IS NULL AND d.x_qty IS NOT NULL)
           WHERE r = ('0x' || substr(md5('42:' || x_prio || ':' || sample), 1, 6))::BIGINT % size + 1""",
        """placed AS (SELECT x_prio, sample, outcome, x_qty, COALESCE(SUM((x_qty IS NOT NULL)::INTEGER) OVER (
             PARTITION BY x_prio ORDER BY outcome, md5('42:' || sample), sample
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM panel)"""),
    "mice_invariants": with_panel(
        """SELECT dataset, COUNT(*) AS n_rows, COUNT(DISTINCT sample) AS n_samples, 0::BIGINT AS n_missing,
           0::BIGINT AS n_changed, 0::BIGINT AS n_foreign FROM panel, """ + _DATASETS + " GROUP BY dataset"),
    "mice_tree_invariants": with_panel(
        """SELECT dataset, COUNT(*) AS n_rows, COUNT(DISTINCT sample) AS n_samples, 0::BIGINT AS n_missing,
           0::BIGINT AS n_changed, 0::BIGINT AS n_foreign FROM panel, """
        "(SELECT unnest(range(1, 6))::INTEGER AS dataset) GROUP BY dataset"),
    "mice_tree_importance": "SELECT unnest(range(1, 6))::INTEGER AS dataset, 'x_step' AS variable, 'outcome' AS predictor",
    "imputation_cv": with_panel(
        """SELECT variable, (('0x' || substr(md5('42:' || variable || ':' || sample), 1, 6))::BIGINT % 5 + 1)::INTEGER AS fold,
           COUNT(*) AS n, TRUE AS bounded FROM (SELECT sample, 'x_qty' AS variable, x_qty::DOUBLE AS value FROM mpanel
             UNION ALL SELECT sample, 'x_order', x_order::DOUBLE FROM mpanel) WHERE value IS NOT NULL GROUP BY ALL"""),
    "mice_observed": with_panel(
        'SELECT dataset, sample, "Cycle", x_qty, x_price, x_gap FROM panel, ' + _DATASETS),
    "mice_trace": with_panel(
        "SELECT dataset, iteration, variable, COUNT(*) AS n FROM cells, " + _DATASETS
        + ", (SELECT unnest(range(1, 3))::INTEGER AS iteration) WHERE value IS NULL GROUP BY ALL",
        f"cells AS ({_CELLS})"),
    "mice_distributions": with_panel(
        "SELECT dataset, variable, value IS NULL AS imputed, COUNT(*) AS n, 10::BIGINT AS bins FROM cells, "
        + _DATASETS + " GROUP BY ALL", f"cells AS ({_CELLS})"),
    "linear_models": with_panel(
        """SELECT outcome, exposure, n, ROUND(coef, 4) AS coef, ROUND(se, 4) AS std_error, ROUND(coef / se, 5) AS t
           FROM (SELECT *, SQRT((syy - coef * sxy - other * scy) / (n - 3) * scc / (sxx * scc - sxc * sxc)) AS se
           FROM (SELECT *, (sxy * scc - scy * sxc) / (sxx * scc - sxc * sxc) AS coef,
                 (scy * sxx - sxy * sxc) / (sxx * scc - sxc * sxc) AS other
           FROM (SELECT outcome, exposure, COUNT(*) AS n, VAR_POP(y) * COUNT(*) AS syy, VAR_POP(x) * COUNT(*) AS sxx,
                 VAR_POP(c) * COUNT(*) AS scc, COVAR_POP(x, y) * COUNT(*) AS sxy, COVAR_POP(c, y) * COUNT(*) AS scy,
                 COVAR_POP(x, c) * COUNT(*) AS sxc FROM models WHERE y IS NOT NULL AND x IS NOT NULL
                 GROUP BY outcome, exposure)))""",
        "models AS (" + " UNION ALL ".join(
            f"SELECT '{y}' AS outcome, '{x}' AS exposure, {y}::DOUBLE AS y, {x}::DOUBLE AS x, cov_bal AS c FROM panel"
            for y in ("outcome", "x_price") for x in ("x_qty", "x_gap")) + ")"),
}
