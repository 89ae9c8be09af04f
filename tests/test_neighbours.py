"""Pruned neighbours against all pairs."""

import numpy as np
import pandas as pd
import pytest

from cohortloom.operators.graph import block_vectors
from cohortloom.operators.neighbours import nearest_neighbours


def cohort(n, seed=3):
    """Ten far groups in block a; block b spread, with a third of the rows equal; block c with tied distances."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 10, n)
    a = 100.0 * rng.normal(size=(10, 3))[group] + rng.normal(size=(n, 3))
    b = rng.normal(size=(n, 2))
    b[: n // 3] = 0.5
    frame = pd.DataFrame(np.column_stack([a, b, rng.integers(0, 4, n)]), columns=["a1", "a2", "a3", "b1", "b2", "c1"])
    frame.insert(0, "sample", np.arange(n)[::-1])
    return frame


BLOCKS = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2"], "c": ["c1"]}


def all_pairs(frame, columns, k):
    x = frame[columns].to_numpy(float)
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    ids = frame["sample"].to_numpy()
    found = {}
    for row, i in enumerate(ids):
        others = sorted((round(d[row, c], 9), ids[c]) for c in range(len(ids)) if c != row)
        found[i] = [j for _, j in others[:k]]
    return found


def listed(edges, block):
    found = {}
    for r in edges.where(f"block = '{block}'").orderBy("i", "place").collect():
        found.setdefault(r["i"], []).append(r["j"])
    return found


@pytest.mark.parametrize("pivots, tile_rows", [(None, 4096), (1, 50), (12, 40)])
def test_same_as_all_pairs(spark, pivots, tile_rows):
    frame = cohort(300)
    blocks = block_vectors(spark.createDataFrame(frame).repartition(3), BLOCKS)
    found = nearest_neighbours(blocks, 7, pivots, tile_rows)
    for name, columns in BLOCKS.items():
        assert listed(found.edges, name) == all_pairs(frame, columns, 7)


def test_far_groups_are_skipped(spark):
    frame = cohort(1500)
    found = nearest_neighbours(block_vectors(spark.createDataFrame(frame), BLOCKS), 5)
    work = {r["block"]: r for r in found.work.collect()}
    assert work["a"]["met"] < work["a"]["cell_pairs"] / 3
    assert work["a"]["comparisons"] < 1500 * 1500 / 3
    assert listed(found.edges, "a") == all_pairs(frame, BLOCKS["a"], 5)


def test_few_participants(spark):
    frame = cohort(4)
    found = nearest_neighbours(block_vectors(spark.createDataFrame(frame), BLOCKS), 20)
    assert listed(found.edges, "a") == all_pairs(frame, BLOCKS["a"], 20)
    one = nearest_neighbours(block_vectors(spark.createDataFrame(frame.head(1)), BLOCKS), 20)
    assert one.edges.count() == 0


def test_rows_are_sent_per_tile_and_not_per_cell(spark):
    frame = cohort(900)
    found = nearest_neighbours(block_vectors(spark.createDataFrame(frame), BLOCKS), 5, tile_rows=1000)
    work = {r["block"]: r for r in found.work.collect()}
    assert work["b"]["met"] > work["b"]["cells"] > 1
    assert work["b"]["sent"] == 900  # all cells share a tile
    assert listed(found.edges, "b") == all_pairs(frame, BLOCKS["b"], 5)
