"""Small tables: selection, profiles, quality rules, merging, files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortloom import constants
from cohortloom.operators import histogram, merge, moments, profile, qc, select, transform
from cohortloom.plans.clean import clean_cohort
from cohortloom.sources import load_cohort, read_cohort, read_results, write_datasets, write_results, write_table


def table(spark, **columns):
    frame = pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})
    rows = [tuple(None if v is None else v for v in row) for row in frame.itertuples(index=False)]
    kinds = {}
    for name, values in columns.items():
        present = [v for v in values if v is not None]
        kinds[name] = ("string" if present and isinstance(present[0], str)
                       else "bigint" if all(isinstance(v, (int, np.integer)) for v in present) and present
                       else "double")
    rows = [tuple(float(v) if v is not None and kinds[n] == "double" else v for n, v in zip(columns, row))
            for row in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


@pytest.fixture(scope="module")
def gaps(spark):
    return table(spark, id=[1, 2, 3, 4, 5, 6], a=[1.0, None, 3.0, 4.0, None, 6.0],
                 b=[1.0, 2.0, None, 4.0, 5.0, 6.0], other=[7, 7, 7, 7, 7, 7])


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_drop_incomplete(gaps):
    seen = Observation()
    kept = select.drop_incomplete(gaps, ["a", "b"], seen)
    assert ids(kept) == [1, 4, 6]
    assert seen.get["n_removed"] == 3
    assert ids(select.drop_incomplete(gaps, "a")) == [1, 3, 4, 6]
    assert gaps.count() == 6
    with pytest.raises(KeyError):
        select.drop_incomplete(gaps, ["a", "absent"])
    assert ids(select.drop_incomplete_present(gaps, ["absent", "b"])) == [1, 2, 4, 5, 6]


@pytest.mark.parametrize("wanted, keep, expected", [
    (["var1", "var2"], None, ["var1", "var2"]),
    (["var1", "var2"], ["var3"], ["var3", "var1", "var2"]),
    (["var1", "var2"], ["var2"], ["var2", "var1"]),
    (["var1", "nope"], ["nothing", "var4"], ["var4", "var1"]),
    (["nope"], None, []),
    ([], ["var1"], ["var1"]),
])
def test_keep_first(spark, wanted, keep, expected):
    df = table(spark, var1=[1, 2], var2=[3, 4], var3=[5, 6], var4=[7, 8])
    assert select.keep_first(df, wanted, keep).columns == expected


def test_dictionary(spark):
    main = table(spark, var1=[1], var2=[2], var3=[3], var4=[4])
    description = table(spark, var=["var1", "var2", "var3", "var4", "var9"],
                        category=["cotinine", "heavy metals", "housing", "alcohol use", "pcbs"])
    tables = {"main": main, "description": description}
    assert select.select_by_dictionary(tables).columns == ["var1", "var2"]
    assert select.select_by_dictionary(tables, ["var4"]).columns == ["var4", "var1", "var2"]
    with pytest.raises(KeyError):
        select.select_by_dictionary({"main": main})
    with pytest.raises(KeyError):
        select.select_by_dictionary({"main": main, "description": description.drop("category")})


def test_pattern_blocks():
    blocks = select.pattern_blocks(["LBXBPB", "LBXBCD", "URXMHP", "AGE", "lbx"])
    assert blocks["heavy metals"] == ["LBXBPB", "LBXBCD"]
    assert blocks["phthalates"] == ["LBXBPB", "LBXBCD", "URXMHP"]
    assert len(blocks) == len(constants.BLOCK_PATTERNS)
    assert select.pattern_blocks(["AGE"]) == {}
    assert select.exposures(["id", "x", "y", "c"], ["id"], ["y"], ["c"]) == ["x"]


def test_sample_names():
    names = [f"v{i}" for i in range(30)]
    chosen = select.sample_names(names, 5, seed=1)
    assert len(set(chosen)) == 5 and chosen == select.sample_names(names[::-1], 5, seed=1)
    assert select.sample_names(names, 99) == names


def test_missing_counts(gaps):
    assert {r[0]: r[1] for r in profile.missing_counts(gaps).collect()} == {"a": 2, "b": 1}


def test_missing_percentage(spark):
    df = table(spark, SDDSRVYR=[1, 1, 2, 2, 2], id=[1, 2, 3, 4, 5], a=[1.0, None, 3.0, 4.0, 5.0],
               b=[1.0, 2.0, None, 4.0, 5.0])
    found = {r["column_name"]: r for r in profile.missing_percentage(df).collect()}
    assert set(found) == {"SDDSRVYR", "id", "a", "b"}
    assert (found["a"]["year_1_missing_pct"], found["a"]["year_2_missing_pct"]) == (50.0, 0.0)
    assert found["b"]["year_2_missing_pct"] == pytest.approx(100 / 3)
    first = profile.missing_percentage(df).first()
    assert first["column_name"] == "a"
    overall = profile.missing_percentage(df.drop("SDDSRVYR")).collect()
    assert [(r[0], r[1]) for r in overall[:2]] == [("a", 20.0), ("b", 20.0)]
    emptied = table(spark, SDDSRVYR=[1, 1, 1, 2, 2], c=[1.0, None, 3.0, None, None])
    row = profile.missing_percentage(emptied).where("column_name = 'c'").first()
    assert row["year_1_missing_pct"] == pytest.approx(100 / 3) and row["year_2_missing_pct"] == 100.0
    assert profile.covered_columns(emptied) == ["SDDSRVYR"]


def test_many_columns_are_batched(spark):
    n = profile.COLUMNS_PER_BATCH * 2 + 5
    df = spark.range(20).selectExpr("id", *[f"IF(id % {i + 2} = 0, NULL, id * 1D) AS `c.{i}`" for i in range(n)])
    found = {r[0]: r[1] for r in profile.missing_counts(df).collect()}
    assert len(found) == n and found["c.0"] == 10 and found["c.1"] == 7


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(0)
    n = 300
    wave = np.repeat([1.0, 2.0, 3.0], 100)
    few = rng.normal(size=n)
    few[199:] = np.nan
    gap = rng.normal(5, 1, n)
    gap[100:200] = np.nan
    zeros = np.zeros(n)
    zeros[:30] = rng.normal(1, 0.1, 30)
    frame = pd.DataFrame({
        "sample": np.arange(1, n + 1), "SDDSRVYR": wave, "score": rng.normal(100, 15, n),
        "age": rng.normal(50, 10, n), "few": few, "zeros": zeros, "gap": gap,
        "kept": rng.normal(10, 2, n), "levels": rng.choice([1, 2, 3], n), "even": np.tile([1.0], n)})
    schema = ", ".join(f"{c} {'bigint' if c in ('sample', 'levels') else 'double'}" for c in frame)
    df = spark.createDataFrame(frame, schema)
    return df.select(*[F.nullif(c, F.lit(float("nan"))).alias(c) if t == "double" else c for c, t in df.dtypes])


def test_quality_rules(survey):
    verdicts = {r[0]: r[1] for r in qc.qc_verdicts(survey, ["score"], ["age", "SDDSRVYR"]).collect()}
    assert verdicts == {"few": 1, "levels": 2, "zeros": 3, "gap": 4, "kept": None, "even": None}
    result = qc.apply_qc_rules(survey, ["score", "absent"], ["age", "SDDSRVYR"])
    assert result.columns == ["sample", "age", "SDDSRVYR", "score", "kept", "even"]
    # The wave is checked like any other column unless it is a covariate: 100 rows per level.
    assert "SDDSRVYR" not in qc.apply_qc_rules(survey, ["score"], ["age"]).columns
    without = qc.apply_qc_rules(survey.drop("SDDSRVYR"), ["score"], ["age"], min_valid=100)
    assert "gap" in without.columns
    counts = {r[0]: r[1] for r in qc.removal_counts(
        qc.qc_verdicts(survey, ["score"], ["age", "SDDSRVYR"])).collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 1}


def test_nine_and_ten_levels(spark):
    df = spark.range(2000).selectExpr("id AS sample", "id % 9 AS nine", "id % 10 AS ten", "-0D * id AS zero")
    found = {r["column_name"]: r for r in qc.qc_profile(df, ["nine", "ten", "zero"], None).collect()}
    assert found["nine"]["levels"] == 9 and found["nine"]["smallest_level"] == 222
    assert found["zero"]["levels"] == 1
    types = {r[0]: r[1] for r in profile.variable_types(df).collect()}
    assert types == {"sample": "continuous", "nine": "categorical", "ten": "continuous", "zero": "categorical"}


def test_log2_and_standardize(spark):
    df = table(spark, id=[1, 2, 3, 4], x=[0.0, 2.0, None, -1.0], c=[5.0, 5.0, 5.0, 5.0])
    logged = [r["x"] for r in transform.log2_columns(df, ["x"]).orderBy("id").collect()]
    assert logged[0] == pytest.approx(np.log2(1e-10)) and logged[1] == pytest.approx(1.0)
    assert logged[2] is None and logged[3] is None
    z = transform.standardize(df, ["x", "c"]).orderBy("id").collect()
    values = np.array([0.0, 2.0, -1.0])
    expected = (values - values.mean()) / values.std()
    assert [z[0]["x"], z[1]["x"], z[3]["x"]] == pytest.approx(list(expected)) and z[2]["x"] is None
    assert [r["c"] for r in z] == [0.0] * 4
    index = transform.exposure_index(df, ["x", "c"]).orderBy("id").collect()
    assert [r["exposure_index"] for r in index] == [5.0, 7.0, 5.0, 4.0]


def test_outer_merge(spark):
    left = table(spark, sample=[1, 2, 3], a=[1.0, 2.0, 3.0], Cycle=[1.0, None, 1.0], rate_1=[1.0, 1.0, 1.0])
    right = table(spark, sample=[2, 3, 4], Cycle=[2.0, 9.0, 2.0], b=[5.0, 6.0, 7.0])
    merged = merge.outer_merge(left, right, sort=True)
    assert merged.columns == ["sample", "a", "rate_1", "b", "Cycle"]
    assert [tuple(r) for r in merged.collect()] == [
        (1, 1.0, 1.0, None, 1.0), (2, 2.0, 1.0, 5.0, 2.0), (3, 3.0, 1.0, 6.0, 1.0), (4, None, None, 7.0, 2.0)]


def test_inner_merge_and_repeats(spark):
    outcomes = table(spark, SEQN=[1, 2, 4], CFDDS=[10, 20, 40])
    exposures = table(spark, SEQN=[1, 3, 4], LBXBPB=[0.1, 0.3, 0.4])
    assert ids(merge.inner_merge(outcomes, exposures, "SEQN"), "SEQN") == [1, 4]
    twice = table(spark, sample=[1, 1, 2])
    assert [tuple(r) for r in merge.repeated_ids(twice).collect()] == [(1, 2)]


def test_harmonise(spark):
    a, b = table(spark, sample=[1], CFDRIGHT=[1]), table(spark, sample=[1], CFDDS=[2])
    right, renamed = merge.harmonise_names(a, b)
    assert right.columns == ["sample", "CFDRIGHT"] and renamed == {"CFDDS": "CFDRIGHT"}
    right, renamed = merge.harmonise_names(b, a)
    assert right.columns == ["sample", "CFDDS"] and renamed == {"CFDRIGHT": "CFDDS"}
    both = table(spark, sample=[1], CFDDS=[2], CFDRIGHT=[3])
    assert merge.harmonise_names(b, both)[0].columns == both.columns


def test_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1.0, (200, 4))
    x[:, 1] += x[:, 0] - 1e6
    x[rng.random((200, 4)) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abcd")).assign(k=0.1, lone=np.nan)
    frame.loc[3, "lone"] = 1.0
    df = spark.createDataFrame(frame)
    df = df.select(*[F.nullif(c, F.lit(float("nan"))).alias(c) for c in df.columns])
    expected = frame.corr(min_periods=2)
    rows = moments.correlation(df, df.columns).collect()
    assert len(rows) == 15
    for r in rows:
        if "k" in (r["var_i"], r["var_j"]) or "lone" in (r["var_i"], r["var_j"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected.loc[r["var_i"], r["var_j"]], abs=1e-9)
    full = moments.full_matrix(moments.correlation(df, ["a", "b", "c"]), ["a", "b", "c"])
    assert full.count() == 6
    assert moments.correlation(df, ["a"]).count() == 0


def test_histogram(spark):
    values = [0.0, 0.5, 1.0, 9.99, 10.0, None]
    df = table(spark, x=values, y=[5.0, None, None, None, None, None])
    counts = {(r["variable"], r["bin"]): r["n"] for r in histogram.histogram(df, ["x", "y"]).collect()}
    expected, _ = np.histogram([v for v in values if v is not None], 10, (0, 10))
    assert [counts["x", b] for b in range(1, 11)] == list(expected)
    assert counts["y", 6] == 1 and sum(counts["y", b] for b in range(1, 11)) == 1
    flat = histogram.histogram(table(spark, x=[2.0, 2.0]), ["x"]).where("n > 0").first()
    assert (flat["lower"], flat["n"]) == (2.0, 2)


def test_csv_cohort(spark, tmp_path):
    (tmp_path / "one.csv").write_text("sample,sequence,x,label,Cycle\n1,9,nan,a,1\n2,8,NA,b,2\n3,7, 2.5 ,,1\n")
    (tmp_path / "two.csv").write_text("sample,sequence,x\n1,9,1e3\n2,8,NaN\n3,7,\n")
    tables = load_cohort(spark, str(tmp_path), ["one.csv", "two.csv"])
    assert list(tables) == ["data_1", "data_2"]
    first = tables["data_1"]
    assert dict(first.dtypes) == {"sample": "bigint", "x": "double", "label": "string", "Cycle": "double"}
    assert [tuple(r) for r in first.orderBy("sample").collect()] == [
        (1, None, "a", 1.0), (2, None, "b", 2.0), (3, 2.5, None, 1.0)]
    assert [r["x"] for r in tables["data_2"].orderBy("sample").collect()] == [1000.0, None, None]
    with pytest.raises(FileNotFoundError):
        load_cohort(spark, str(tmp_path), ["one.csv", "three.csv"])
    (tmp_path / "bare.csv").write_text("sample,x\n1,2\n")
    with pytest.raises(KeyError):
        load_cohort(spark, str(tmp_path), ["bare.csv"])
    typed = read_cohort(spark, str(tmp_path / "two.csv"), schema="sample bigint, sequence bigint, x double")
    assert [r["x"] for r in typed.orderBy("sample").collect()] == [1000.0, None, None]


def test_sinks(spark, tmp_path):
    df = table(spark, sample=[1, 2, 3, 4], x=[1.0, 2.0, 3.0, None], Cycle=[1, 1, 2, 2], dataset=[1, 1, 2, 2])
    write_datasets(df, str(tmp_path / "sets"))
    assert (tmp_path / "sets" / "dataset=2").exists()
    back = spark.read.parquet(str(tmp_path / "sets"))
    assert back.columns == ["sample", "Cycle", "x", "dataset"] and back.count() == 4
    write_table(df, str(tmp_path / "plain"), file_format="csv")
    again = read_cohort(spark, str(tmp_path / "plain"))
    assert sorted(map(tuple, again.select("sample", "x").collect()), key=str) == sorted(
        map(tuple, df.select("sample", "x").collect()), key=str)
    write_results({"a": df, "b": back}, str(tmp_path / "results"))
    assert read_results(spark, str(tmp_path / "results"), ["a"])["a"].count() == 4


def test_clean_cohort(spark, survey):
    one = survey.select("sample", (F.col("SDDSRVYR").cast("int")).alias("Cycle"), "age",
                        F.col("score").alias("CFDDS"), "kept", "gap", F.lit(1).alias("INDHHINC"))
    two = survey.where("sample > 50").select(
        "sample", F.col("SDDSRVYR").cast("int").alias("Cycle"), "age", F.col("score").alias("CFDRIGHT"),
        F.abs("kept").alias("more"))
    result = clean_cohort({"data_1": one, "data_2": two}, covariates=["Cycle", "age"])
    assert result.outcomes == ["CFDDS"]
    assert result.combined.columns == ["sample", "kept", "more", "Cycle", "age", "CFDDS"]
    assert result.combined.count() == 300
    assert result.exposures(result.combined) == ["kept", "more"]
    stats = result.combined.agg(F.avg("kept"), F.stddev_pop("kept")).first()
    assert tuple(stats) == pytest.approx((0.0, 1.0), abs=1e-9)
    assert result.exposure_correlation().first()["r"] == pytest.approx(1.0, abs=0.05)
    assert result.missing("data_1").count() == 5
    assert result.outcome_histogram().agg(F.sum("n")).first()[0] == 300


def test_schema_is_bound_by_name(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("sample,b,a,t\n1,10,1, NA \n2,nan,2,x\n3,1d,3,nan\n")
    typed = read_cohort(spark, str(tmp_path / "swapped.csv"), schema="sample bigint, a double, b double, t string")
    assert [tuple(r) for r in typed.orderBy("sample").collect()] == [
        (1, 1.0, 10.0, None), (2, 2.0, None, "x"), (3, 3.0, None, None)]
    with pytest.raises(KeyError):
        read_cohort(spark, str(tmp_path / "swapped.csv"), schema="sample bigint, c double")


def test_only_decimal_text_is_a_number(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("sample,x,y\n1,1d,1e3\n2,12F,-.5\n3,3,+2.\n")
    found = read_cohort(spark, str(tmp_path / "odd.csv"))
    assert dict(found.dtypes) == {"sample": "bigint", "x": "string", "y": "double"}
    assert [r["y"] for r in found.orderBy("sample").collect()] == [1000.0, -0.5, 2.0]
