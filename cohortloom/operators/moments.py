"""Pair moments of many columns in one pass, and correlation from them.

Each task multiplies its Arrow batches with numpy and hands on a few rows per column; the
shuffle carries column pairs, never participants. Wide tables are cut into tiles of columns: a scan
reads the columns of two tiles, and a task holds the sums of their pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.transform import column_moments

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Bytes of sums of two tiles of columns for one key, and of all keys that a task holds before it hands them on.
TILE_BYTES, TASK_BYTES = 64 * 1024 * 1024, 256 * 1024 * 1024


def dense(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rows by columns, missing values as NaN."""
    return np.column_stack([
        batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns
    ]) if columns else np.empty((batch.num_rows, 0))


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: str = "vec") -> DataFrame:
    """Element-wise sum of an array column per key, combined on the map side."""
    return (
        df.withColumn(vector, array_to_vector(F.col(vector)))
        .groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col(vector))).alias(vector))
    )


def tiles(n: int) -> list[range]:
    """Positions of ``n`` columns in tiles, so that the sums of two tiles stay within ``TILE_BYTES``."""
    size = max(1, int((TILE_BYTES / (8 * len(MOMENTS))) ** 0.5))
    return [range(i, min(n, i + size)) for i in range(0, n, size)]


def _pair_moments(keys: Sequence[str], columns: Sequence[str], shift: np.ndarray, left: range, right: range, diagonal: bool):
    """Sums over pairs (i, j) of a column of the left tile and a later one (or the same) of the right."""
    wanted = list(dict.fromkeys([*left, *right]))
    x_at, y_at = [wanted.index(i) for i in left], [wanted.index(j) for j in right]
    step = 0 if diagonal else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list = []

        def handed_on() -> Iterator[pa.RecordBatch]:
            for key, sums in totals.items():
                # A row per column i, holding the six sums over pairs (i, j) with j from ``first`` on.
                first = [max(i + step, right.start) for i in left]
                rows = [k for k in range(len(left)) if first[k] < right.stop]
                vectors = [sums[k, :, first[k] - right.start:].ravel() for k in rows]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([k] * len(rows), t) for k, t in zip(key, types)], pa.array([left[k] for k in rows], pa.int32()),
                     pa.array([first[k] for k in rows], pa.int32()), pa.array(vectors, pa.list_(pa.float64()))],
                    names=[*keys, "i", "first", "vec"],
                )
            totals.clear()

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            values = dense(batch, [columns[i] for i in wanted]) - shift[wanted]
            seen = ~np.isnan(values)
            filled = np.where(seen, values, 0.0)
            mask = seen.astype(float)
            for key, rows in split_by_key(batch, keys):
                part, present = filled[rows], mask[rows]
                x, m, y, k = part[:, x_at], present[:, x_at], part[:, y_at], present[:, y_at]
                sums = np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y], axis=1)
                if key in totals:
                    totals[key] += sums
                else:
                    totals[key] = sums
                if len(totals) * sums.nbytes > TASK_BYTES:  # many keys
                    yield from handed_on()
        yield from handed_on()

    return run


def split_by_key(batch: pa.RecordBatch, keys: Sequence[str]):
    """Row positions of a batch per value of its key columns."""
    if not keys:
        yield (), slice(None)
        return
    columns = [batch.column(k).dictionary_encode("encode") for k in keys]
    codes = np.zeros(batch.num_rows, np.int64)
    for column in columns:
        codes = codes * len(column.dictionary) + column.indices.to_numpy()
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for rows in np.split(order, starts[1:]) if len(order) else []:
        yield tuple(column[int(rows[0])].as_py() for column in columns), rows


def pair_moments(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centre: bool = True, diagonal: bool = False
) -> DataFrame:
    """``(keys, var_i, var_j, n, sx, sy, sxx, syy, sxy)`` over the rows that have both values, i before j; with ``diagonal`` also i = j.

    With ``centre`` a first small aggregate takes the column means, which are subtracted to
    keep the sums accurate; correlations do not depend on the shift. Each pair of column tiles is a scan of its own that reads
    those columns only.
    """
    columns, keys = list(columns), list(keys)
    names = F.array(*[F.lit(c) for c in columns])
    if len(columns) < (1 if diagonal else 2):
        nothing = [F.lit(None).cast("string").alias("var_i"), F.lit(None).cast("string").alias("var_j"),
                   F.lit(None).cast("bigint").alias("n"),
                   *[F.lit(None).cast("double").alias(m) for m in MOMENTS[1:]]]
        return df.where(F.lit(False)).select(*keys, *nothing)
    shift = np.zeros(len(columns))
    if centre:
        moments = column_moments(df, columns)
        shift = np.array([moments[c][1] or 0.0 for c in columns], dtype=float)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "i int", "first int", "vec array<double>"])
    cut, parts = tiles(len(columns)), []
    for at, left in enumerate(cut):
        for right in cut[at:]:
            needed = [columns[i] for i in dict.fromkeys([*left, *right])]
            parts.append(df.select(*keys, *needed).mapInArrow(
                _pair_moments(keys, columns, shift, left, right, diagonal), schema))
    rows = sum_vectors(reduce(DataFrame.unionByName, parts), [*keys, "i", "first"])
    width = (F.size("vec") / len(MOMENTS)).cast("int")
    return (
        rows.select(*keys, "i", "first", "vec", width.alias("w"), F.explode(F.sequence(F.lit(1), width)).alias("step"))
        .select(
            *keys,
            F.element_at(names, F.col("i") + 1).alias("var_i"),
            F.element_at(names, F.col("first") + F.col("step")).alias("var_j"),
            *[F.element_at("vec", F.col("w") * k + F.col("step")).alias(m) for k, m in enumerate(MOMENTS)],
        )
        .withColumn("n", F.round("n").cast("bigint"))
    )


def correlation(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centre: bool = True, diagonal: bool = False
) -> DataFrame:
    """Pearson correlation over complete pairs, ``(keys, var_i, var_j, n, r)`` with i before j; with ``diagonal`` also i = j.

    Missing where fewer than two pairs exist or one side does not vary.
    """
    n = F.col("n")
    cross = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    # Below this share of the sum of squares a variance is rounding noise.
    noise = F.lit(1e-12)
    varies = (n >= 2) & (vx > noise * F.col("sxx")) & (vy > noise * F.col("syy"))
    r = F.try_divide(cross, F.sqrt(vx * vy))
    r = F.when(F.col("var_i") == F.col("var_j"), F.lit(1.0)).otherwise(r)
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pair_moments(df, columns, keys, centre, diagonal).select(*keys, "var_i", "var_j", "n", r.alias("r"))


def full_matrix(pairs: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Both triangles of a correlation table; the diagonal is left to the reader as one, see ``whole_correlation``."""
    mirrored = pairs.select(*keys, F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "n", "r")
    return pairs.unionByName(mirrored)


def whole_correlation(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centre: bool = True) -> DataFrame:
    """The whole correlation matrix, ``(keys, var_i, var_j, n, r)``: both triangles and the diagonal, which is one where a column varies."""
    upper = correlation(df, columns, keys, centre, diagonal=True)
    both = F.array(F.struct("var_i", "var_j"), F.struct(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j")))
    sides = F.when(F.col("var_i") == F.col("var_j"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(*keys, F.explode(sides).alias("side"), "n", "r").select(*keys, "side.*", "n", "r")
