"""Missingness, quality rules and column types."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import profile, qc, select
from cohortloom.plans.panel import COVARIATES, OUTCOMES, survey_panel, with_panel

PANEL_COLUMNS = ["sample", "Cycle", "outcome", "cov_bal", "cov_nation", "x_qty", "x_price", "x_gap",
                 "x_sparse", "x_zero", "x_cat", "x_prio"]
CHECKED = ["x_qty", "x_price", "x_gap", "x_sparse", "x_zero", "x_cat", "x_prio"]
CYCLES = range(1995, 2002)


def _rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def missing_pct_by_cycle(spark, sf_dir):
    wide = profile.missing_percentage(survey_panel(spark, sf_dir))
    return _rounded(wide, *[c for c in wide.columns if c != "column_name"])


def missing_counts(spark, sf_dir):
    return profile.missing_counts(survey_panel(spark, sf_dir))


def missing_pct_overall(spark, sf_dir):
    return _rounded(profile.missing_percentage(survey_panel(spark, sf_dir).drop("Cycle")), "percentage_missing")


def drop_incomplete(spark, sf_dir):
    return select.drop_incomplete(survey_panel(spark, sf_dir), ["x_qty", "x_price"])


def drop_incomplete_default(spark, sf_dir):
    panel = survey_panel(spark, sf_dir).withColumnRenamed("x_gap", "CFDRIGHT")
    return select.drop_incomplete(panel).select("sample", "CFDRIGHT")


def drop_incomplete_present(spark, sf_dir):
    panel = select.drop_incomplete_present(survey_panel(spark, sf_dir), ["x_gap", "not_there", "x_qty"])
    return panel.drop("x_sparse", "not_there")


def _rule_profile(spark, sf_dir):
    panel = survey_panel(spark, sf_dir)
    columns = qc.checked_columns(panel, OUTCOMES, COVARIATES)
    return qc.qc_profile(panel, columns, "Cycle")


def qc_rule1(spark, sf_dir):
    return _rule_profile(spark, sf_dir).select(
        "column_name", "n_valid", (F.col("n_valid") < 200).alias("removed"))


def qc_rule2(spark, sf_dir):
    few = F.col("levels") < 10
    return _rule_profile(spark, sf_dir).where(few).select(
        "column_name", "levels", "smallest_level", (F.col("smallest_level") < 200).alias("removed"))


def qc_rule3(spark, sf_dir):
    share = F.try_divide(F.col("n_zero"), F.col("n_valid"))
    return _rule_profile(spark, sf_dir).select(
        "column_name", F.round(share, 6).alias("zero_share"), (share >= 0.9).alias("removed"))


def qc_rule4(spark, sf_dir):
    return _rule_profile(spark, sf_dir).select(
        "column_name", "worst_wave", (F.col("worst_wave") == 0).alias("removed"))


def qc_verdict(spark, sf_dir):
    return qc.qc_verdicts(survey_panel(spark, sf_dir), OUTCOMES, COVARIATES)


def qc_removed(spark, sf_dir):
    return qc.removal_counts(qc.qc_verdicts(survey_panel(spark, sf_dir), OUTCOMES, COVARIATES))


def qc_apply(spark, sf_dir):
    result = qc.apply_qc_rules(survey_panel(spark, sf_dir), OUTCOMES, COVARIATES, log2_values=True,
                               standardize_values=True)
    return _rounded(result, *[c for c in result.columns if c.startswith("x_")])


def wave_coverage(spark, sf_dir):
    return profile.wave_coverage(survey_panel(spark, sf_dir))


def variable_types(spark, sf_dir):
    panel = survey_panel(spark, sf_dir)
    return profile.variable_types(panel.withColumn("half", F.when(F.col("x_prio") > 2, F.lit("high"))
                                                   .otherwise(F.lit("low")))
                                  .withColumn("nothing", F.lit(None).cast("double")))


QUERIES = {f.__name__: f for f in (
    missing_pct_by_cycle, missing_counts, missing_pct_overall, drop_incomplete, drop_incomplete_default,
    drop_incomplete_present, qc_rule1, qc_rule2, qc_rule3, qc_rule4, qc_verdict, qc_removed, qc_apply,
    wave_coverage, variable_types,
)}


def _per_column(template: str, columns=PANEL_COLUMNS) -> str:
    return "\nUNION ALL\n".join(template.format(c=c) for c in columns)


_STATS = "stats AS (" + _per_column(
    """SELECT '{c}' AS column_name, SUM(nv)::BIGINT AS n_valid, SUM(nz)::BIGINT AS n_zero, MIN(nv) AS worst_wave
       FROM (SELECT "Cycle", COUNT({c}) AS nv, COUNT(*) FILTER (WHERE {c} = 0) AS nz FROM panel GROUP BY "Cycle")""",
    CHECKED) + ")"
_LEVELS = "levels AS (SELECT column_name, COUNT(*) AS levels, MIN(n) AS smallest_level FROM (" + _per_column(
    "SELECT '{c}' AS column_name, {c}::VARCHAR AS v, COUNT(*) AS n FROM panel WHERE {c} IS NOT NULL GROUP BY {c}",
    CHECKED) + ") GROUP BY column_name)"
_VERDICT = """verdict AS (
  SELECT s.column_name, CASE
    WHEN s.n_valid < 200 THEN 1
    WHEN l.levels < 10 AND l.smallest_level < 200 THEN 2
    WHEN s.n_zero / s.n_valid >= 0.9 THEN 3
    WHEN s.worst_wave = 0 THEN 4 END AS failed_rule
  FROM stats s JOIN levels l USING (column_name))"""

# The years are those of the given orders; the pivot names one column for each.
_BY_CYCLE = with_panel(
    "SELECT column_name, " + ", ".join(
        f"ROUND(MAX(pct) FILTER (WHERE cycle = {y}), 6) AS cycle_{y}_missing_pct" for y in CYCLES)
    + " FROM long GROUP BY column_name",
    "long AS (" + _per_column(
        """SELECT '{c}' AS column_name, "Cycle" AS cycle,
           100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*) AS pct FROM panel GROUP BY "Cycle" """) + ")")

_APPLIED = with_panel(
    """SELECT sample, "Cycle", cov_bal, cov_nation, outcome, """ + ", ".join(
        f"ROUND((l_{c} - m_{c}) / s_{c}, 6) AS {c}" for c in ("x_qty", "x_price", "x_prio"))
    + " FROM logged, (SELECT " + ", ".join(
        f"AVG(l_{c}) AS m_{c}, STDDEV_POP(l_{c}) AS s_{c}" for c in ("x_qty", "x_price", "x_prio"))
    + " FROM logged)",
    "logged AS (SELECT *, " + ", ".join(
        f"CASE WHEN {c} + 1e-10 > 0 THEN LOG2({c} + 1e-10) END AS l_{c}" for c in ("x_qty", "x_price", "x_prio"))
    + " FROM panel)")

ORACLES = {
    "missing_pct_by_cycle": _BY_CYCLE,
    "missing_counts": with_panel("SELECT * FROM (" + _per_column(
        "SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_missing FROM panel") + ") WHERE n_missing > 0"),
    "missing_pct_overall": with_panel(_per_column(
        """SELECT '{c}' AS column_name,
           ROUND(100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS percentage_missing FROM panel""",
        [c for c in PANEL_COLUMNS if c != "Cycle"])),
    "drop_incomplete": with_panel("SELECT * FROM panel WHERE x_qty IS NOT NULL AND x_price IS NOT NULL"),
    "drop_incomplete_default": with_panel(
        'SELECT sample, x_gap AS "CFDRIGHT" FROM panel WHERE x_gap IS NOT NULL'),
    "drop_incomplete_present": with_panel(
        "SELECT * EXCLUDE (x_sparse) FROM panel WHERE x_gap IS NOT NULL AND x_qty IS NOT NULL"),
    "qc_rule1": with_panel("SELECT column_name, n_valid, n_valid < 200 AS removed FROM stats", _STATS),
    "qc_rule2": with_panel(
        "SELECT column_name, levels, smallest_level, smallest_level < 200 AS removed FROM levels WHERE levels < 10",
        _LEVELS),
    "qc_rule3": with_panel(
        """SELECT column_name, ROUND(n_zero / n_valid, 6) AS zero_share, n_zero / n_valid >= 0.9 AS removed
           FROM stats""", _STATS),
    "qc_rule4": with_panel(
        "SELECT column_name, worst_wave, worst_wave = 0 AS removed FROM stats", _STATS),
    "qc_verdict": with_panel("SELECT * FROM verdict", _STATS, _LEVELS, _VERDICT),
    "qc_removed": with_panel(
        "SELECT failed_rule, COUNT(*) AS n_removed FROM verdict WHERE failed_rule IS NOT NULL GROUP BY failed_rule",
        _STATS, _LEVELS, _VERDICT),
    "qc_apply": _APPLIED,
    "wave_coverage": with_panel("SELECT * EXCLUDE (x_gap) FROM panel"),
    "variable_types": with_panel(
        "SELECT column_name, CASE WHEN levels < 10 THEN 'categorical' ELSE 'continuous' END AS variable_type FROM ("
        + _per_column("SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS levels FROM panel")
        + ") UNION ALL SELECT 'half', 'categorical'"),
}
