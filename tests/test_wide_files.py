"""Typing of wide text files."""

import numpy as np

from cohortloom.sources import read_cohort


def test_wide_file_is_scanned_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    names = [f"c.{i}" if i % 50 == 0 else f"c {i}" for i in range(500)]
    values = rng.integers(0, 100, (60, 500)).astype(str)
    values[7, 3], values[59, 499], values[5, 8], values[:, 20] = "low", "12F", "", ""
    lines = ["sample," + ",".join(names)] + [f"{i}," + ",".join(row) for i, row in enumerate(values)]
    path = tmp_path / "wide.csv"
    path.write_text("\n".join(lines) + "\n")
    found = read_cohort(spark, str(path))
    kinds = dict(found.dtypes)
    assert kinds["sample"] == "bigint" and {c for c in names if kinds[c] == "string"} == {"c 3", "c 499"}
    # Nothing reads the file any more.
    assert not any("wide.csv" in name for name in found.inputFiles())
    path.unlink()
    rows = found.orderBy("sample").collect()
    assert len(rows) == 60 and rows[7]["c 3"] == "low" and rows[5]["c 8"] is None and rows[9]["c.50"] == float(values[9, 50])
    assert all(r["c 20"] is None for r in rows)


def test_header_alone(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("sample,a,b\n")
    found = read_cohort(spark, str(path))
    assert found.count() == 0 and found.dtypes == [("sample", "bigint"), ("a", "double"), ("b", "double")]
    path.write_text("sample\n4\n")
    assert [tuple(r) for r in read_cohort(spark, str(path)).collect()] == [(4,)]
