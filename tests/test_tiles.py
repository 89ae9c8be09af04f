"""Cross-products in tiles of columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import moments


def wide(spark, n, p, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1] += x[:, 0]
    x[rng.random((n, p)) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    frame["c3"] = 7.0
    frame["g"] = np.arange(n) % 3
    df = spark.createDataFrame(frame).repartition(3)
    return frame, df.select("g", *[F.nullif(c, F.lit(float("nan"))).alias(c) for c in frame.columns if c != "g"])


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_tiles_give_the_same(spark, monkeypatch, keys):
    frame, df = wide(spark, 90, 23)
    columns = [c for c in df.columns if c != "g"]

    def found():
        rows = moments.whole_correlation(df, columns, keys).collect()
        return {tuple(r[c] for c in (*keys, "var_i", "var_j")): (r["n"], None if r["r"] is None else round(r["r"], 10)) for r in rows}

    usual = found()
    assert len(usual) == 23 * 23 * (3 if keys else 1)
    # tiles of seven columns, and a task that hands on the sums of one key at a time
    monkeypatch.setattr(moments, "TILE_BYTES", 8 * 6 * 7 * 7)
    monkeypatch.setattr(moments, "TASK_BYTES", 1)
    assert [len(t) for t in moments.tiles(23)] == [7, 7, 7, 2] and found() == usual
    for key, part in frame.groupby("g") if keys else [(None, frame)]:
        expected = part[columns].corr(min_periods=2)
        for a in columns:
            for b in columns:
                n, r = usual[(key, a, b) if keys else (a, b)]
                assert n == (part[a].notna() & part[b].notna()).sum()
                assert r is None if "c3" in (a, b) else r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_a_wide_table_under_a_small_bound(spark, monkeypatch):
    frame, df = wide(spark, 40, 600)
    monkeypatch.setattr(moments, "TILE_BYTES", 8 * 6 * 200 * 200)
    columns = [c for c in df.columns if c != "g"]
    assert len(moments.tiles(600)) == 3
    found = moments.correlation(df, columns).agg(F.count("*").alias("n"), F.sum("r").alias("r")).first()
    expected = np.nan_to_num(frame[columns].corr(min_periods=2).to_numpy())
    assert found["n"] == 600 * 599 // 2 and found["r"] == pytest.approx(np.triu(expected, 1).sum(), rel=1e-6, abs=1e-6)
