"""Seeded folds of equal size, without sorting the table.

Rows are ordered by an md5 key of seed and id. A fold is a range of that order, so a row's
fold follows from comparing its key with the few keys at which the folds start. Only a
histogram of key prefixes and one short range of keys per boundary are ever looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.constants import ID_COLUMN
from cohortloom.functions import order_key

PREFIX_DIGITS = 4  # 65,536 ranges


def starts_of(n: int, k: int) -> list[int]:
    """First position (from 0) of each of k ranges over n rows, longer ranges first."""
    if k > n:
        raise ValueError(f"{k} folds need at least as many rows, not {n}")
    size, longer = divmod(n, k)
    return [f * size + min(f, longer) for f in range(k)]


def keys_at(keys: DataFrame, positions) -> tuple[int, dict[int, str]]:
    """Number of rows, and the keys at the given positions (from 0) of the sorted order.

    ``positions`` may be a function of the row count. ``keys`` has one text column ``k``.
    """
    prefix = F.substring("k", 1, PREFIX_DIGITS)
    histogram = sorted(keys.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends, total = [], 0
    for row in histogram:
        total += row["n"]
        ends.append(total)
    wanted = sorted(set(positions(total) if callable(positions) else positions))
    places = {}
    for position in wanted:
        slot = bisect_right(ends, position)
        places[position] = (histogram[slot]["p"], position - (ends[slot] - histogram[slot]["n"]))
    if not places:
        return total, {}
    ranked = (
        keys.withColumn("p", prefix).where(F.col("p").isin(*{p for p, _ in places.values()}))
        .withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1)
    )
    hit = F.lit(False)
    for p, r in set(places.values()):
        hit = hit | ((F.col("p") == p) & (F.col("r") == r))
    found = {(row["p"], row["r"]): row["k"] for row in ranked.where(hit).collect()}
    return total, {position: found[place] for position, place in places.items()}


@dataclass
class FoldPlan:
    """Ranges of the key order, and to which outer and inner fold each of them belongs.

    ``outer[a]`` is the outer fold of range a; ``inner[o][a]`` its inner fold in the training
    set of outer fold o, 0 for the ranges that o keeps for testing. Folds count from 1.
    """

    seed: int
    cuts: list[str]
    outer: list[int]
    inner: dict[int, list[int]]

    def range_of(self, key: Column) -> Column:
        """Range of a row, from 0."""
        if not self.cuts:
            return F.lit(0)
        cuts = F.array(*[F.lit(c) for c in self.cuts])
        # As an element of an array the key is worked out once, not once per cut.
        return F.transform(F.array(key), lambda k: F.size(F.filter(cuts, lambda cut: cut <= k)))[0]


def fold_plan(
    df: DataFrame, outer: int, inner: int | None = None, seed: int = 42, id_column: str = ID_COLUMN
) -> FoldPlan:
    """Boundaries of outer folds, and of the inner folds drawn in each outer training set."""
    layout: dict[str, list] = {}

    def positions(n: int) -> list[int]:
        starts = starts_of(n, outer)
        ends = [*starts[1:], n]
        cuts = set(starts)
        inner_starts = {}
        for o in range(outer if inner else 0):
            held_out = ends[o] - starts[o]
            # Positions among the training rows, put back into the whole order.
            inner_starts[o] = [s if s < starts[o] else s + held_out
                               for s in starts_of(n - held_out, inner)]
            cuts.update(inner_starts[o])
        cuts = sorted(cuts)
        layout["starts"], layout["inner"], layout["cuts"] = starts, inner_starts, cuts
        return cuts[1:]

    key = order_key(seed, F.col(id_column))
    _, keys = keys_at(df.select(key.alias("k")), positions)
    cuts = layout["cuts"]
    outer_of = [bisect_right(layout["starts"], c) for c in cuts]
    inner_of = {
        o + 1: [0 if outer_of[a] == o + 1 else bisect_right(starts, c) for a, c in enumerate(cuts)]
        for o, starts in layout["inner"].items()
    }
    return FoldPlan(seed, [keys[c] for c in cuts[1:]], outer_of, inner_of)


def assign_folds(df: DataFrame, k: int, seed: int = 42, id_column: str = ID_COLUMN, name: str = "fold") -> DataFrame:
    """Add the fold (1 to k) of each row; a narrow step once the boundaries are known."""
    plan = fold_plan(df, k, seed=seed, id_column=id_column)
    return df.withColumn(name, plan.range_of(order_key(seed, F.col(id_column))) + 1)


def nested_folds(
    df: DataFrame, outer: int = 8, inner: int = 7, seed: int = 42, id_column: str = ID_COLUMN
) -> DataFrame:
    """A row per participant and outer training set it is in: ``(id, outer_fold, inner_fold)``."""
    plan = fold_plan(df, outer, inner, seed, id_column)
    memberships = F.array(*[
        F.array(*[
            F.struct(F.lit(o).alias("outer_fold"), F.lit(plan.inner[o][a]).alias("inner_fold"))
            for o in plan.inner if plan.inner[o][a]
        ])
        for a in range(len(plan.outer))
    ])
    located = df.select(id_column, plan.range_of(order_key(seed, F.col(id_column))).alias("__range"))
    return located.select(id_column, F.inline(F.element_at(memberships, F.col("__range") + 1)))
