"""Order statistics without sorting a group in one task.

A group (a fold, a dataset) may hold a large part of all rows. Large inputs are therefore cut
into value ranges, each range is summed in its own window partition, and the sums of the
ranges before it are added. The input is read more than once; tables that are not cheap to
read again are staged, unless ``staged`` says that this has been done.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import order_key
from cohortloom.staging import broadcast_if_small, stage

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 2_000
ROWS_PER_BOUNDARY = 5_000
# A range with so many times the usual rows holds a value that many rows share.
CROWDED = 4
TIE_DIGITS = 3


def same_key_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet each other, as they do in a window or a group."""
    marked = right.withColumnsRenamed({c: f"__other_{c}" for c in on})
    equal = [left[c].eqNullSafe(marked[f"__other_{c}"]) for c in on]
    return left.join(marked, equal).drop(*[f"__other_{c}" for c in on])


def _value_ranges(df: DataFrame, order: str, n_rows: int, rows_per_range: int) -> DataFrame:
    """Add ``__range``: the position of the value between approximate quantiles.

    Any boundaries give the same result, they only balance the ranges; so a share of the rows
    is enough to find them. NULL has a range before all others and NaN one after them, which
    is where Spark sorts them. Ranges that would hold too many rows are cut a second time, at quantiles of
    their own.
    """
    wanted = ceil(n_rows / rows_per_range)
    count = min(MAX_RANGES, wanted)
    value = F.col(order).cast("double")
    regular = value.isNotNull() & ~F.isnan(value)

    def shares(n: int):
        return F.expr("array(" + ", ".join(f"{i / n!r}D" for i in range(1, n)) + ")")

    looked_at = df.sample(fraction=min(1.0, ROWS_PER_BOUNDARY * wanted / n_rows), seed=7).where(regular)
    if count > 1:
        quantiles = looked_at.agg(F.percentile_approx(value, shares(count), F.lit(20 * count))).first()[0]
    else:
        quantiles = []
    cuts = sorted({-inf, *(quantiles or []), inf})
    bucketizer = Bucketizer(splits=cuts, inputCol="__value", outputCol="__position", handleInvalid="keep")

    def located(rows: DataFrame) -> DataFrame:
        placed = bucketizer.transform(rows.withColumn("__value", value))
        at = F.when(F.col("__value").isNull(), -1).when(F.isnan("__value"), len(cuts)).otherwise(F.col("__position"))
        return placed.withColumn("__range", at.cast("long")).drop("__position")

    if wanted <= MAX_RANGES:
        return located(df).drop("__value")
    inner = ceil(wanted / MAX_RANGES) + 1
    finer = stage(located(looked_at).groupBy("__range").agg(
        F.percentile_approx("__value", shares(inner), F.lit(20 * inner)).alias("__cuts")), "finer")
    # At most MAX_RANGES + 2 rows.
    ranged = located(df).join(F.broadcast(finer), "__range", "left")
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__value"))), F.lit(0))
    below = F.when(F.col("__cuts").isNull(), 0).otherwise(below)
    return ranged.withColumn("__range", F.col("__range") * inner + below).drop("__value", "__cuts")


def _range_totals(ranged: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> tuple[DataFrame, int]:
    """``__offset_*``: sums of the ranges before, per key; and the rows of the fullest range."""
    sums = stage(
        ranged.groupBy(*keys, "__range").agg(
            F.count(F.lit(1)).alias("__rows"), *[F.sum(m).alias(f"__sum_{m}") for m in measures]), "ranges")
    # One row per range and key meets in this window, whatever the ranges hold.
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__range",
        *[F.coalesce(F.sum(f"__sum_{m}").over(earlier), F.lit(0)).alias(f"__offset_{m}") for m in measures])
    return offsets, sums.agg(F.max("__rows")).first()[0] or 0


def _add_before(
    ranged: DataFrame, offsets: DataFrame, keys: Sequence[str], order: Sequence, measures: Sequence[str]
) -> DataFrame:
    """``before_*`` within the value range plus the sums of the ranges before."""
    local = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    located = same_key_join(ranged, broadcast_if_small(offsets), [*keys, "__range"])
    return located.withColumns({
        f"before_{m}": F.coalesce(F.sum(m).over(local), F.lit(0)) + F.col(f"__offset_{m}") for m in measures
    }).drop("__range", *[f"__offset_{m}" for m in measures])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    tie: str | None = None,
    seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Add ``before_<m>``: the sum of each measure over the rows of the key that sort earlier.

    NULL order values come first and NaN last, as Spark sorts them. Without ``tie`` the rows must be unique in key and order value. With it, equal values are
    put in the order of a seeded hash of the tie column, then of the column itself; a value
    shared by many rows is divided by that hash.
    """
    keys = list(keys)
    data = df if staged else stage(df, "ordered")
    n_rows = data.count()
    ties = [order_key(seed, F.col(tie)), F.col(tie)] if tie else []
    if n_rows <= rows_per_range:
        before = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
        return data.withColumns(
            {f"before_{m}": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures})
    ranged = _value_ranges(data, order, n_rows, rows_per_range)
    offsets, fullest = _range_totals(ranged, keys, measures)
    if not tie or fullest <= CROWDED * rows_per_range:
        return _add_before(ranged, offsets, keys, [order, *ties], measures)

    # Rows of equal value are first counted by parts of their hash, the parts put in order,
    # and the rows then within their part.
    parted = data.withColumn("__hash", ties[0]).withColumn("__part", F.substring("__hash", 1, TIE_DIGITS))
    groups = [*keys, order, "__part"]
    sums = stage(parted.groupBy(*groups).agg(*[F.sum(m).alias(m) for m in measures]), "parts")
    part_ranges = _value_ranges(sums, order, n_rows, rows_per_range)
    offsets, _ = _range_totals(part_ranges, keys, measures)
    placed = _add_before(part_ranges, offsets, keys, [order, "__part"], measures)
    within = Window.partitionBy(*groups).orderBy("__hash", tie).rowsBetween(Window.unboundedPreceding, -1)
    located = parted.withColumns(
        {f"__in_{m}": F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures})
    joined = same_key_join(located, placed.drop(*measures), groups)
    return joined.withColumns(
        {f"before_{m}": F.col(f"before_{m}") + F.col(f"__in_{m}") for m in measures}
    ).drop("__hash", "__part", *[f"__in_{m}" for m in measures])


def _middle_of(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median from ``(keys, value, n, before_n, total)``."""
    def at(position):
        holds = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
        return F.max(F.when(holds, F.col(value)))

    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return counts.groupBy(*keys).agg(((at(first) + at(second)) / 2).alias(name))


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    rows_per_range: int = ROWS_PER_RANGE,
    staged: bool = False,
    brackets: DataFrame | None = None,
) -> DataFrame:
    """Exact median per key: the mean of the two middle values when their number is even.

    On large inputs approximate quantiles bracket the middle; the values below are counted
    and only those within the bracket are put in order. The counts prove the bracket right,
    else all values are put in order. ``brackets`` (keys, low, high) may be given.
    """
    keys = list(keys)
    if not keys:
        whole = exact_median(df.withColumn("__all", F.lit(0)), ["__all"], value, name, rows_per_range, staged)
        return whole.drop("__all")
    data = df.where(F.col(value).isNotNull()).select(*keys, value)
    data = data if staged else stage(data, "values")
    if data.count() > rows_per_range:
        if brackets is None:
            quantiles = F.percentile_approx(value, F.array(F.lit(0.48), F.lit(0.52)), F.lit(200))
            brackets = stage(data.groupBy(*keys).agg(quantiles.alias("q")), "brackets").select(
                *keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
        known = data.join(broadcast_if_small(brackets), keys)
        outside = stage(known.groupBy(*keys).agg(
            F.count_if(F.col(value) < F.col("low")).alias("below"),
            F.count_if(F.col(value) <= F.col("high")).alias("reached"),
            F.count(F.lit(1)).alias("total")), "outside")
        missed = (F.col("below") > F.floor((F.col("total") - 1) / 2)) | (
            F.col("reached") <= F.floor(F.col("total") / 2))
        if outside.where(missed).isEmpty():
            inside = known.where(F.col(value).between(F.col("low"), F.col("high"))).groupBy(*keys, value).agg(
                F.count(F.lit(1)).alias("n"))
            placed = running_totals(inside, keys, value, ["n"], rows_per_range=rows_per_range)
            placed = placed.join(broadcast_if_small(outside), keys)
            return _middle_of(placed.withColumn("before_n", F.col("before_n") + F.col("below")), keys, value, name)
    counts = data.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, keys, value, ["n"], rows_per_range=rows_per_range)
    sizes = placed.groupBy(*keys).agg(F.sum("n").alias("total"))
    return _middle_of(placed.join(broadcast_if_small(sizes), keys), keys, value, name)


def auroc(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    score: str = "score",
    rows_per_range: int = ROWS_PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Area under the ROC curve per key; tied scores count half, a single class gives 0.5.

    A NULL score is below all others, a NaN above them; such scores are tied among themselves.

    One shuffle by key and score range. If many rows share a score, equal scores are counted
    together before.
    """
    keys = list(keys)
    if not keys:
        whole = auroc(df.withColumn("__all", F.lit(0)), ["__all"], label, score, rows_per_range, staged)
        return whole.drop("__all")
    data = df.select(*keys, F.col(score), F.col(label).cast("tinyint").alias("pos"))
    data = data if staged else stage(data, "scored")
    negative = (1 - F.col("pos")).cast("bigint")
    n_rows = data.count()
    if n_rows <= rows_per_range:
        ranged = data.withColumn("__range", F.lit(0))
        offsets = None
    else:
        ranged = _value_ranges(data, score, n_rows, rows_per_range)
        offsets, fullest = _range_totals(ranged.withColumn("neg", negative), keys, ["neg"])
        if fullest > CROWDED * rows_per_range:
            counts = data.groupBy(*keys, score).agg(
                F.sum("pos").alias("pos"), F.sum(negative).alias("neg"))
            placed = running_totals(counts, keys, score, ["neg"], rows_per_range=rows_per_range)
            beaten = F.col("before_neg") + F.col("neg") / F.lit(2.0)
            return _area(placed.select(
                *keys, (F.col("pos") * beaten).alias("wins"), "pos", "neg"), keys)
    parts = [*keys, "__range"]
    by_score = Window.partitionBy(*parts).orderBy(score)
    up_to = F.sum(negative).over(by_score.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum(negative).over(by_score.rangeBetween(Window.currentRow, Window.currentRow))
    within = ranged.withColumn("beaten", up_to - equal / F.lit(2.0)).groupBy(*parts).agg(
        F.sum(F.col("pos") * F.col("beaten")).alias("wins"), F.sum("pos").alias("pos"),
        F.sum(negative).alias("neg"))
    if offsets is not None:
        # Each positive of a range also beats the negatives of all ranges before.
        within = same_key_join(within, offsets, parts).withColumn("wins", F.col("wins") + F.col("pos") * F.col("__offset_neg"))
    return _area(within, keys)


def score_runs(cell: int, label: np.ndarray, score: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """Rows of ``RUNS`` for scores of a cell: per class and range between the ``cuts`` an ascending run.

    Where most scores repeat, a run holds each once and how often it occurs.
    """
    runs = []
    for positive in (True, False):
        values = np.sort(score[label == positive])
        limits = np.searchsorted(values, cuts, side="right").tolist()
        for at, (low, high) in enumerate(zip([0, *limits], [*limits, len(values)])):
            if high > low:
                run = values[low:high]
                starts = np.flatnonzero(np.concatenate([[True], ~((run[1:] == run[:-1]) | np.isnan(run[:-1]))]))
                if 2 * len(starts) > len(run):
                    runs.append((cell, at, positive, run, None))
                else:
                    runs.append((cell, at, positive, run[starts], np.diff(np.append(starts, len(run)))))
    return runs


#: Scores of one class of a cell and a value range, ascending; ``n`` how often each occurs, NULL where all do once.
RUNS = "cell int, range int, positive boolean, score array<double>, n array<bigint>"


def runs_batch(runs: Sequence[tuple]) -> pa.RecordBatch:
    cell, at, positive, score, n = zip(*runs)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int32()), pa.array(at, pa.int32()), pa.array(positive, pa.bool_()), pa.array(score, pa.list_(pa.float64())),
         pa.array(n, pa.list_(pa.int64()))], names=["cell", "range", "positive", "score", "n"])


def _run_wins(runs: pa.Table) -> pa.Table:
    """Of a cell and range: twice the wins of positives over negatives in it, and the rows of both classes."""
    positive = runs["positive"].to_numpy()
    score, n = runs["score"].combine_chunks(), runs["n"].combine_chunks()
    parts = {}
    for kind in (True, False):
        rows = np.flatnonzero(positive == kind)
        values = [score[int(r)].values.to_numpy() for r in rows]
        counts = [n[int(r)].values.to_numpy() if n[int(r)].is_valid else np.ones(len(v), np.int64) for r, v in zip(rows, values)]
        whole = np.concatenate([*values, np.empty(0)])
        if n.null_count == len(n):
            parts[kind] = np.sort(whole), None
        else:
            order = np.argsort(whole, kind="stable")
            parts[kind] = whole[order], np.concatenate([*counts, np.empty(0, np.int64)])[order]
    (above, times), (below, weights) = parts[True], parts[False]
    first, last = np.searchsorted(below, above, side="left"), np.searchsorted(below, above, side="right")
    if weights is None:
        wins, n_pos, n_neg = int(first.sum() + last.sum()), len(above), len(below)
    else:
        sums = np.concatenate([[0], np.cumsum(weights)])
        wins, n_pos, n_neg = int(((sums[first] + sums[last]) * times).sum()), int(times.sum()), int(sums[-1])
    return pa.table({
        "cell": runs["cell"].slice(0, 1), "range": runs["range"].slice(0, 1), "wins": pa.array([wins], pa.int64()),
        "pos": pa.array([n_pos], pa.int64()), "neg": pa.array([n_neg], pa.int64())})


def auroc_of_runs(runs: DataFrame) -> DataFrame:
    """``auroc`` per ``cell`` from packed scores, ``RUNS``: the same areas, with a row to shuffle per run in place of one per score.

    A task sorts the scores of one cell and range; the negatives of the ranges before are added. NaN scores are tied above all others.
    """
    within = stage(runs.groupBy("cell", "range").applyInArrow(
        _run_wins, "cell int, range int, wins bigint, pos bigint, neg bigint"), "wins")
    # A row per cell and range.
    earlier = Window.partitionBy("cell").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    return _area(within.select("cell", (F.col("wins") / 2 + F.col("pos") * before).alias("wins"), "pos", "neg"), ["cell"])


def _area(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wins of positives over negatives, as a share of the pairs."""
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return sums.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("wins").cast("double"), pairs), F.lit(0.5)).alias("auroc"))
