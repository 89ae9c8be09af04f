"""Registered queries against their SQL counterparts, on the smallest tables.

The queries on networks and imputation take minutes together. They run with ALL_QUERIES=1 or by
``python tests/oracle.py``; their operators are checked by brute force in any case.
"""

import os

import pytest
from oracle import differences

from cohortloom.registry import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


LONG = ("snf_", "mice_", "imputation_cv", "pls_cv", "pls_final", "masked_")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name.startswith(LONG) and not os.environ.get("ALL_QUERIES"):
        pytest.skip("long; set ALL_QUERIES=1")
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, SF_DIR, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
