"""Exact nearest neighbours per block of columns, without comparing participants that cannot be near.

Every participant belongs to the cell of its nearest pivot. By the triangle inequality, cell sizes and the
distances between pivots bound from above how far the last wanted neighbour of a cell's members can be, and from below how
far another cell's members are. Pairs of cells whose lower bound exceeds the upper one are skipped, and of the other cells
only the members beyond the bound are compared. Cells are packed into a few tiles, and a task takes two tiles: a participant is sent
once per tile that its cell must meet, so the rows that move do not grow with the number of cells. The kernel scale of a graph still needs all distances (see ``graph``); this operator
is for neighbours alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.graph import DIGITS, STRIP, TILE_BYTES, Blocks, _strip_distances, compare_tiles
from cohortloom.staging import stage

# Pivots per block. They only place the cells; the routes between cells that the driver sees are at most their square.
PIVOTS = 128
TILE_ROWS = 4096
# Distances that agree to DIGITS count as equal, so bounds leave room for that.
SLACK = 10.0 ** (1 - DIGITS)


@dataclass
class Neighbours:
    """``edges``: ``(b, block, i, j, place, distance)``, staged; ``work``: ``(block, cells, cell_pairs, met, sent, comparisons)``.

    ``met`` of the ``cell_pairs`` are compared; ``comparisons`` of the rows squared are made.
    """

    edges: DataFrame
    work: DataFrame


def _nearest_pivot(pivots: list[np.ndarray], id_type: str):
    """Rows per block with the nearest pivot and the distance to it; the lower one among equals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for b, part in rows.groupby("b"):
                values = np.stack(part["v"].to_numpy())
                found = [_strip_distances(values[s:s + STRIP], pivots[b]) for s in range(0, len(values), STRIP)]
                distances = np.concatenate(found)
                cell = distances.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), radius=distances[np.arange(len(cell)), cell])

    return run, f"b int, i {id_type}, v array<double>, cell int, radius double"


def _routes(pivots: np.ndarray, cells: list, count: int) -> list[tuple[int, int, float]]:
    """``(cell, other, least radius)`` of the pairs of cells that must meet.

    ``cells`` holds ``(cell, radius, nearest radii)``. Members of ``other`` nearer to their pivot than the least radius
    are too far from every member of ``cell``.
    """
    at = np.array([c for c, _, _ in cells])
    radius = np.array([r for _, r, _ in cells])
    between = _strip_distances(pivots[at], pivots[at])
    reach = np.concatenate([np.add.outer(between[:, o], near) for o, (_, _, near) in enumerate(cells)], axis=1)
    # A participant is in a list of near ones itself, hence one more than wanted.
    place = min(count, reach.shape[1] - 1)
    upper = radius + np.partition(reach, place, axis=1)[:, place]
    least = between - radius[:, None] - (upper * (1 + 1e-9) + SLACK)[:, None]
    return [(int(at[c]), int(at[o]), float(least[c, o]))
            for c, o in np.argwhere(least <= radius[None, :] * (1 + 1e-9) + SLACK)]


def _packed(pivots: np.ndarray, cells: list, tile_rows: int) -> dict[int, tuple[int, int]]:
    """``{cell: (first tile, tiles)}`` of ``(cell, rows)``: large cells are cut, small ones share a tile with near ones."""
    rows, found, tile, filled = dict(cells), {}, 0, 0
    at = cells[0][0]
    while True:
        n = rows.pop(at)
        if n > tile_rows:
            tile += 1 if filled else 0
            found[at] = (tile, ceil(n / tile_rows))
            tile, filled = tile + found[at][1], 0
        else:
            if filled + n > tile_rows:
                tile, filled = tile + 1, 0
            found[at], filled = (tile, 1), filled + n
        if not rows:
            return found
        left = list(rows)
        at = left[int(_strip_distances(pivots[[at]], pivots[left])[0].argmin())]


def _visits(tiles: dict[int, tuple[int, int]], least: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(cell, first tile, tiles, bound)``: members at the bound or beyond it go to these tiles, those of cells that must meet."""
    members: dict[tuple[int, int], list[int]] = {}
    for cell, place in tiles.items():
        members.setdefault(place, []).append(cell)
    found = []
    for cell in tiles:
        for (first, count), others in members.items():
            # Searching members visit the tile all; those that are looked for only beyond the least radius.
            bound = -1.0 if np.isfinite(least[cell, others]).any() else float(least[others, cell].min())
            if bound < np.inf:
                found.append((cell, first, count, bound))
    return found


def _same_ids(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal ids in two ascending lists."""
    low, high = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    row = np.repeat(np.arange(len(left)), high - low)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)


def _tile_neighbours(count: int, least: list[np.ndarray]):
    """Nearest members of one tile for each participant of another, both ways, over the cells that must meet."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b, first, second = key
        rows = rows.sort_values("i", kind="stable")
        tile, cell, radius, ids = (rows[c].to_numpy() for c in ("tile", "cell", "radius", "i"))
        vectors, frames = np.stack(rows["v"].to_numpy()), []
        for mine, theirs in {(first, second), (second, first)}:
            right = np.flatnonzero(tile == theirs)
            for c in np.unique(cell[tile == mine]):
                searching = np.flatnonzero((tile == mine) & (cell == c))
                others = right[radius[right] >= least[b][c, cell[right]]]
                if not len(others):
                    continue
                best = compare_tiles(vectors[searching], vectors[others], count, skip=_same_ids(ids[searching], ids[others]),
                                     sums=False, both=False)[1]
                distances, near = best.lists(ids[others])
                frames.append(pd.DataFrame({
                    "b": b, "i": ids[searching], "met": len(others), "near_distance": distances, "near_id": near}))
        none = pd.DataFrame({c: pd.Series(dtype=object) for c in ("b", "i", "met", "near_distance", "near_id")})
        return pd.concat(frames) if frames else none

    return run


def nearest_neighbours(
    blocks: Blocks, k: int = 20, pivots: int | None = None, tile_rows: int | None = None
) -> Neighbours:
    """The ``k`` nearest other participants per block and participant, equal to a comparison of all pairs.

    Distances that agree to nine digits count as equal, and ids decide. ``pivots`` are the participants with the lowest
    hashes; large cells, such as a third of all rows being copies, are cut into tiles by a hash of the id, so no task holds
    more than two tiles. Tiles of ``tile_rows`` grow with the table unless given, so that a row is sent to few of them. With fewer than ``k`` others all of them are returned; a lone participant has none.
    """
    spark, names = blocks.table.sparkSession, blocks.names
    id_type = dict(blocks.table.dtypes)[blocks.id_column]
    k = min(k, max(blocks.n_rows - 1, 0))
    wanted = min(PIVOTS, max(1, ceil(sqrt(blocks.n_rows)))) if pivots is None else min(pivots, PIVOTS)
    by_hash = blocks.table.orderBy(F.xxhash64(blocks.id_column), blocks.id_column).limit(wanted).collect()
    places = [np.array([row[f"v{b}"] for row in by_hash], dtype=float) for b in range(len(names))]
    vectors = F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"v{b}").alias("v")) for b in range(len(names))])
    long = blocks.table.select(F.col(blocks.id_column).alias("i"), F.inline(vectors)).select("b", "i", "v")
    celled = stage(long.mapInPandas(*_nearest_pivot(places, id_type)), "cells")

    if tile_rows is None:
        widest = max((p.shape[1] for p in places if p.ndim == 2), default=1)
        share = ceil(blocks.n_rows / ceil(sqrt(2 * spark.sparkContext.defaultParallelism)))
        tile_rows = min(max(share, TILE_ROWS), max(TILE_ROWS, TILE_BYTES // (8 * max(1, widest))))
    sizes = stage(celled.groupBy("b", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("reach")), "cell-sizes")
    # At most PIVOTS rows per block.
    numbers = [[] for _ in names]
    for row in sizes.orderBy("b", "cell").collect():
        numbers[row["b"]].append((row["cell"], row["n"]))
    tiles = [_packed(places[b], cells, tile_rows) if cells else {} for b, cells in enumerate(numbers)]
    packed = [(b, cell, *place) for b, found in enumerate(tiles) for cell, place in found.items()]
    packed = spark.createDataFrame(packed, "b int, cell int, first int, parts int")
    tiled = celled.join(F.broadcast(packed), ["b", "cell"]).withColumn(
        "tile", F.col("first") + F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")).drop("first", "parts")
    tiled = stage(tiled, "tiles")
    # The radii nearest to each pivot, first per tile and then per cell.
    near = tiled.select("b", "cell", "tile", "radius")
    for keys in (["b", "cell", "tile"], ["b", "cell"]):
        order = Window.partitionBy(*keys).orderBy("radius")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    lists = near.groupBy("b", "cell").agg(F.sort_array(F.collect_list("radius")).alias("near"))
    bounds = [[] for _ in names]
    for row in sizes.join(lists, ["b", "cell"]).orderBy("b", "cell").collect():
        bounds[row["b"]].append((row["cell"], row["reach"], np.array(row["near"])))
    found = [(b, *route) for b, cells in enumerate(bounds) if cells for route in _routes(places[b], cells, k)]
    routes = stage(spark.createDataFrame(found, "b int, cell int, other int, least double"), "routes")
    least = [np.full((len(by_hash), len(by_hash)), np.inf) for _ in names]
    for b, cell, other, radius in found:
        least[b][cell, other] = radius
    visits = [(b, *visit) for b in range(len(names)) for visit in _visits(tiles[b], least[b])]
    visits = spark.createDataFrame(visits, "b int, cell int, first int, parts int, bound double")  # at most a row per two cells

    pair = ["b", "one", "two"]
    met = tiled.join(F.broadcast(visits), ["b", "cell"]).where(F.col("radius") >= F.col("bound"))
    met = met.withColumn("other", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).select(
        "b", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "cell", "radius", "i", "v")
    met = stage(met.groupBy(*pair).applyInPandas(
        _tile_neighbours(max(k, 1), least),
        f"b int, i {id_type}, met long, near_distance array<double>, near_id array<{id_type}>"), "met")

    block = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("b") + 1).alias("block")
    nearest = Window.partitionBy("b", "i").orderBy(F.round("distance", DIGITS), "j")
    edges = (
        met.select("b", "i", F.inline(F.arrays_zip(F.col("near_distance").alias("distance"), F.col("near_id").alias("j"))))
        .where(F.col("i") != F.col("j")).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k)
        .select("b", block, "i", "j", "place", "distance")
    )
    cells = sizes.groupBy("b").agg(F.count(F.lit(1)).alias("cells"))
    work = (
        cells.join(routes.groupBy("b").agg(F.count(F.lit(1)).alias("met")), "b")
        .join(met.groupBy("b").agg(F.count(F.lit(1)).alias("sent"), F.sum("met").alias("comparisons")), "b")
        .select(block, "cells", (F.col("cells") * F.col("cells")).alias("cell_pairs"), "met", "sent", "comparisons")
    )
    return Neighbours(stage(edges, "neighbours"), work)
