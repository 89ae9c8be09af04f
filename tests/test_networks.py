"""Neighbour graphs and fusion against dense matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import fusion, graph, hubs
from cohortloom.plans import snf


def dense_graph(blocks, k, drop_nearest):
    """Similarity and neighbour matrices per block."""
    found = []
    for x in blocks:
        sd = x.std(0)
        z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
        sim = np.exp(-d**2 / (2 * d.mean() ** 2))
        np.fill_diagonal(sim, 0)
        near = np.zeros_like(sim)
        for i in range(len(x)):
            others = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 9), j))
            first = 1 if drop_nearest else 0
            for j in others[first:first + k]:
                near[i, j] = sim[i, j]
        found.append((d, sim, near))
    return found


def dense_fusion(found):
    near = [n for _, _, n in found]
    last = near[-1]
    sums = last.sum(1, keepdims=True)
    p = last / np.where(sums == 0, 1, sums)
    return p @ (sum(near[:-1]) / (len(near) - 1)) @ p.T


def matrix(df, n, value="value"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"], r["j"]] = r[value]
    return out


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(5)
    n = 70
    frame = pd.DataFrame(rng.normal(size=(n, 6)), columns=["a1", "a2", "b1", "b2", "score", "flat"])
    frame["flat"] = 3.0
    frame["group"] = rng.integers(0, 3, n)
    frame.loc[:n // 3, ["a1", "a2"]] = 1.5  # a third of the rows are copies
    frame.insert(0, "sample", np.arange(n))
    return frame


CATEGORIES = {"a": ["a1", "a2"], "b": ["b1", "b2", "flat"], "none": []}
COLUMNS = [["a1", "a2"], ["b1", "b2", "flat"], ["score"], ["group"]]


@pytest.mark.parametrize("tile_rows, drop_nearest", [(1000, True), (16, True), (16, False)])
def test_network(spark, cohort, tile_rows, drop_nearest):
    n, k = len(cohort), 6
    found = dense_graph([cohort[c].to_numpy(float) for c in COLUMNS], k, drop_nearest)
    df = spark.createDataFrame(cohort).repartition(4)
    network = fusion.run_snf(df, CATEGORIES, ["score"], ["group"], k, drop_nearest=drop_nearest, tile_rows=tile_rows)
    assert network.graph.blocks.names == ["a", "b", "cognitive", "covariates"]
    for b, (d, sim, near) in enumerate(found):
        assert np.allclose(matrix(network.edges.where(f"b = {b}"), n, "similarity"), near)
        sums = {r["sample"]: r["distance_sum"] for r in network.graph.distance_sums().where(
            f"block = '{network.graph.blocks.names[b]}'").collect()}
        assert np.allclose([sums[i] for i in range(n)], d.sum(1))
    scales = {r["block"]: r["sigma"] for r in network.graph.kernel_scales().collect()}
    assert scales["b"] == pytest.approx(found[1][0].mean())
    fused = dense_fusion(found)
    assert np.allclose(matrix(network.entries(), n), fused)
    totals = {r["i"]: r["x"] for r in network.row_sums().collect()}
    assert np.allclose([totals[i] for i in range(n)], fused.sum(1))
    pairs = network.neighbour_pairs()
    at = [(r["i"], r["j"], r["value"]) for r in network.values_at(pairs).collect()]
    assert len(at) == pairs.count() and np.allclose([v for *_, v in at], [fused[i, j] for i, j, _ in at])
    mean = sum(s for _, s, _ in found) / 4
    average = [(r["i"], r["j"], r["value"]) for r in network.average_at(pairs).collect()]
    assert np.allclose([v for *_, v in average], [mean[i, j] for i, j, _ in average])


def test_reads_of_the_small_example(spark):
    """Five participants on a line, two neighbours: shapes and symmetric distances."""
    base = np.arange(1, 6)
    frame = pd.DataFrame({"sample": np.arange(5), "e1": base * 0.1, "e2": base * 1.0, "e3": base * 10,
                          "e4": base * 100, "y": base * 1000, "c1": base * 10000, "c2": base * 100000})
    blocks = {"one": ["e1", "e2"], "two": ["e3", "e4"]}
    network = fusion.run_snf(spark.createDataFrame(frame), blocks, ["y"], ["c1", "c2"], k=2)
    assert network.graph.blocks.names == ["one", "two", "cognitive", "covariates"]
    found = dense_graph([frame[c].to_numpy(float) for c in (["e1", "e2"], ["e3", "e4"], ["y"], ["c1", "c2"])], 2, True)
    assert np.allclose(matrix(network.entries(), 5), dense_fusion(found))
    assert network.edges.groupBy("b", "i").count().where("count <> 2").count() == 0


def test_more_neighbours_than_participants(spark, cohort):
    df = spark.createDataFrame(cohort.head(5))
    network = fusion.run_snf(df, {"b": ["b1", "b2"]}, ["score"], [], k=20)
    assert network.edges.groupBy("b", "i").count().where("count <> 3").count() == 0


def test_empty_tiles(spark, cohort):
    df = spark.createDataFrame(cohort.head(5))
    network = fusion.run_snf(df, {"b": ["b1", "b2"]}, ["score"], [], k=2, tile_rows=1)
    assert network.edges.groupBy("b", "i").count().where("count <> 2").count() == 0


def test_guards(spark, cohort):
    df = spark.createDataFrame(cohort)
    with pytest.raises(ValueError, match="not in the table"):
        fusion.run_snf(df, {"a": ["absent"]}, ["score"], [])
    with pytest.raises(ValueError, match="two blocks"):
        fusion.run_snf(df, {}, ["score"], [])
    with pytest.raises(ValueError, match="no kernel scale"):
        fusion.run_snf(df, {"a": ["flat"]}, ["score"], [])
    with pytest.raises(ValueError, match="missing values"):
        fusion.run_snf(df.selectExpr("sample", "IF(sample = 3, NULL, a1) AS a1", "score"), {"a": ["a1"]}, ["score"], [])


def test_clusters_find_separate_groups(spark, tmp_path):
    rng = np.random.default_rng(8)
    centre = np.repeat([0.0, 50.0, 120.0], [20, 30, 40])
    frame = pd.DataFrame({"sample": np.arange(90), "LBXA": centre + rng.normal(size=90),
                          "URXPHT": centre + rng.normal(size=90), "score": centre + rng.normal(size=90),
                          "age": centre + rng.normal(size=90), "Cycle": 1})
    network, clusters = snf.run_snf_analysis(
        spark.createDataFrame(frame), ["score"], ["age"], k=8, path=str(tmp_path / "snf"))
    assert "heavy metals" in network.graph.blocks.names
    found = clusters.toPandas().sort_values("sample")
    assert len(found) == 90 and found.cluster.between(0, 2).all()
    assert len(spark.read.parquet(str(tmp_path / "snf" / "clusters")).collect()) == 90


def test_hub_join(spark):
    left = spark.range(1000).selectExpr("id AS i", "IF(id % 3 = 0, 0, id) AS a")
    right = spark.range(1000).selectExpr("id AS a", "id * 2 AS twice")
    plain = sorted(map(tuple, left.join(right, "a").select("a", "i", "twice").collect()))
    divided = hubs.hub_join(left, right, "a", "i", rows_per_key=50).select("a", "i", "twice")
    assert sorted(map(tuple, divided.collect())) == plain
    assert hubs.crowded_keys(left, ["a"], 50).first()["__parts"] == 7
    assert hubs.crowded_keys(left, ["a"], 5000) is None


def test_nearest_breaks_ties_by_position():
    d = np.array([[1.0, 0.0, 1.0, 1.0, 2.0], [5.0, 4.0, 3.0, 2.0, 1.0]])
    assert graph._nearest(d, 3).tolist() == [[True, True, True, False, False], [False, False, True, True, True]]


def test_clusters_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(8)
    centre = np.repeat([0.0, 4.0, 9.0], [30, 40, 50])
    frame = pd.DataFrame({"sample": np.arange(120), "a": centre + rng.normal(size=120), "b": rng.normal(size=120),
                          "score": centre + rng.normal(size=120), "age": rng.integers(0, 9, 120).astype(float)})
    df = spark.createDataFrame(frame)
    labels = []
    for parts in (1, 7):
        network = fusion.run_snf(df.repartition(parts), {"low": ["a"], "high": ["b"]}, ["score"], ["age"], k=6)
        labels.append(sorted(map(tuple, network.clusters(3).select("sample", "cluster").collect())))
    assert labels[0] == labels[1] and {c for _, c in labels[0]} == {0, 1, 2}


def test_groups_in_one_dimension(spark):
    values = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0, 9.2, 9.4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, position double")
    found = df.select("i", fusion.grouped_positions(df, 3).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in found] == [0, 0, 0, 1, 1, 2, 2, 2]
    same = df.withColumn("position", F.lit(1.0))
    assert same.select(fusion.grouped_positions(same, 3).alias("c")).distinct().count() == 1


def test_keys_crowded_on_both_sides(spark):
    left = spark.range(300).selectExpr("id AS i", "id % 3 AS a")
    right = spark.range(300).selectExpr("id % 3 AS a", "id AS j")
    plain = sorted(map(tuple, left.join(right, "a").select("a", "i", "j").collect()))
    divided = hubs.hub_join(left, right, "a", "i", rows_per_key=500)
    assert sorted(map(tuple, divided.select("a", "i", "j").collect())) == plain


@pytest.mark.parametrize("strips", [(5, 7), (1024, 4096)])
def test_strips_do_not_change_neighbours(spark, monkeypatch, strips):
    monkeypatch.setattr(graph, "STRIP", strips[0])
    monkeypatch.setattr(graph, "OTHER_STRIP", strips[1])
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"sample": np.arange(40), "a": rng.normal(size=40), "b": rng.integers(0, 3, 40).astype(float)})
    blocks = graph.block_vectors(spark.createDataFrame(frame), {"x": ["a", "b"]})
    found = graph.neighbour_graph(blocks, 4, tile_rows=16).edges().select("i", "j", "place").collect()
    z = (frame[["a", "b"]] - frame[["a", "b"]].mean()) / frame[["a", "b"]].std(ddof=0)
    d = np.round(np.sqrt(((z.to_numpy()[:, None] - z.to_numpy()[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    expected = {(i, int(j), k) for i in range(40) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5]) if k}
    assert {tuple(r) for r in found} == expected
