"""Numbers of levels beyond the default threshold."""

import pytest

from cohortloom.operators.profile import column_profile, most_estimated, variable_types
from cohortloom.operators.qc import qc_verdicts


def table(spark):
    return spark.range(6000).selectExpr(
        "id AS sample", "0 AS y", "1 AS c", "id % 9 AS nine", "id % 10 AS ten", "id % 49 AS most", "id % 50 AS fifty",
        "CAST(id % 300 AS DOUBLE) AS hundreds", "id AS every", "IF(id < 5999, id % 30, 777) AS rare")


@pytest.mark.parametrize("bound, few", [
    (10, {"y", "c", "nine"}),
    (50, {"y", "c", "nine", "ten", "most", "rare"}),
    (301, {"y", "c", "nine", "ten", "most", "fifty", "hundreds", "rare"}),
])
def test_variable_types(spark, bound, few):
    found = {r[0]: r[1] for r in variable_types(table(spark), bound).collect()}
    assert {c for c, kind in found.items() if kind == "categorical"} == few


@pytest.mark.parametrize("bound, failed", [(10, set()), (50, {"rare"}), (31, set()), (32, {"rare"})])
def test_rare_levels(spark, bound, failed):
    found = qc_verdicts(table(spark), ["y"], ["c"], "sample", max_levels=bound, min_level_rows=50, max_zero_share=2.0)
    assert {r[0] for r in found.where("failed_rule = 2").collect()} == failed


def test_estimate_never_exceeds_its_bound(spark):
    """The filter loses no column: values up to the bound, in many mixtures."""
    for bound in (10, 50, 200, 1000):
        values = bound - 1
        df = spark.range(values * 2).selectExpr(*[
            f"(id % {values}) * {step} + {shift} AS v{step}_{shift}" for step in (1, 7, 1001, 65537) for shift in (0, 5, 10**9)])
        found = column_profile(df, levels=True, max_levels=bound)
        assert max(r["about_levels"] for r in found.collect()) <= most_estimated(bound)
