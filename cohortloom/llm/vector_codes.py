"""Product codes of vectors: codebooks by Lloyd's rounds in integers, comparing only what can have changed."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.staging import broadcast_if_bytes, discard, stage

#: Parts of a vector, entries of a codebook, rounds, and the factor of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components are held to this size, so that distances stay within a long.
LARGEST = 2**24
#: Vectors that are compared with a codebook at a time.
STRIP = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as int64."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * largest * largest < 2**53:
        # whole numbers below 2**53 are exact in floating point, whatever the order of the sums
        a, b = x.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)
        return found.astype(np.int64)
    found = np.empty((len(x), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        apart = x - entry
        found[:, k] = (apart * apart).sum(1)
    return found


def nearest(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each row, ties to the lower index.

    ``code`` and ``distance`` are those of the round before (code -1: none). Where the assigned entry is not among ``moved``, its
    distance still holds and all other unmoved entries lose to it as before, so only moved entries are compared; other
    rows are compared with every entry.
    """
    code, distance = code.copy(), distance.copy()
    lost = code < 0
    lost[~lost] = np.isin(code[~lost], moved)
    every = np.arange(len(entries))
    for rows, active in ((np.flatnonzero(lost), every), (np.flatnonzero(~lost), moved)):
        if not len(active):
            continue
        for k in range(0, len(rows), STRIP):
            here = rows[k : k + STRIP]
            found = squares(x[here], entries[active])
            at = found.argmin(1)  # the first of equal ones, and ``active`` ascends
            best, entry = found[np.arange(len(here)), at], active[at]
            held = ~lost[here]
            better = ~held | (best < distance[here]) | ((best == distance[here]) & (entry < code[here]))
            code[here[better]], distance[here[better]] = entry[better], best[better]
    return code, distance


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(state: DataFrame, codebooks: np.ndarray, moved: list[np.ndarray]) -> DataFrame:
    """``state`` (vector, code, distance and others) with codes and distances for the codebooks."""
    schema = state.schema
    sent = state.sparkSession.sparkContext.broadcast((codebooks, moved))  # at most 4 x 256 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, changed = sent.value
        for batch in batches:
            x, code, distance = (_matrix(batch.column(c)) for c in ("vector", "code", "distance"))
            x, code, distance = x.astype(np.int64), code.astype(np.int64), distance.copy()
            width = books.shape[2]
            for p in range(PARTS):
                part = x[:, p * width : (p + 1) * width]
                code[:, p], distance[:, p] = nearest(part, books[p], changed[p], code[:, p], distance[:, p])
            new = {"code": code.astype(np.int16), "distance": distance}
            columns = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * PARTS), pa.array(new[f.name].ravel())) if f.name in new
                else batch.column(f.name) for f in schema.fields
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return state.mapInArrow(run, schema)


def part_sums(state: DataFrame, width: int) -> DataFrame:
    """``part``, ``entry`` and ``vec``: sum of the parts assigned to each entry, and their count at the end. Summed up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
        for batch in batches:
            x, code = (_matrix(batch.column(c)).astype(np.int64) for c in ("vector", "code"))
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                own, first = np.unique(code[order, p], return_index=True)
                part = np.column_stack([x[order, p * width : (p + 1) * width], np.ones(len(x), np.int64)])
                if len(own):
                    sums[p, own] += np.add.reduceat(part, first, axis=0)
        part, entry = np.nonzero(sums[:, :, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "vec"]
        )

    partial = state.select("vector", "code").mapInArrow(run, "part int, entry int, vec array<long>")
    return _sum_longs(partial, width + 1)


def _sum_longs(partial: DataFrame, size: int) -> DataFrame:
    """Exact sums of long arrays, position by position."""
    summed = [F.sum(F.get("vec", F.lit(i))).alias(f"__{i}") for i in range(size)]
    return partial.groupBy("part", "entry").agg(*summed).select("part", "entry", F.array(*[f"__{i}" for i in range(size)]).alias("vec"))


def renewed(codebooks: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codebooks of floored means (unused entries stay), and the entries of each part that changed. At most 4 x 256 rows come here."""
    after = codebooks.copy()
    for row in sums.collect():
        *total, count = row["vec"]
        after[row["part"], row["entry"]] = [t // count for t in total]
    return after, [np.flatnonzero((after[p] != codebooks[p]).any(1)) for p in range(PARTS)]


def codebook_digest(codebooks: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def train_codes(
    vectors: DataFrame, vec: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label"), key: str = "vec_id", rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Columns ``keep`` with ``code`` (an entry per part) and ``distance`` of each kept vector, and the codebooks (part, entry, position).

    A component x counts as floor(1024 * x). The codebook of a part starts as that part of the ``ENTRIES`` smallest keys (equal keys by
    their vectors, null keys last); with fewer vectors it is smaller. Each round assigns all parts and moves the entries to their floored means; a last
    assignment follows. The vectors are written once per round with their codes and distances, and the state before is deleted.

    The length of the vector with the smallest key decides: vectors of another length are dropped like null ones. One that four does not
    divide, or no vector at all, gives an empty result. Scaled components are held within ``LARGEST`` (2 ** 24).
    """
    v, k = F.col(f"`{vec}`"), F.col(f"`{key}`")
    order = [k.asc_nulls_last(), v]
    seeds = vectors.where(usable(v)).orderBy(*order).limit(ENTRIES).select(v.alias("v")).collect()
    size = len(seeds[0]["v"]) if seeds and len(seeds[0]["v"]) % PARTS == 0 else 0
    width = size // PARTS
    fit = vectors.where(usable(v) & (F.size(v) == size) if size else F.lit(False))
    if size and any(len(r["v"]) != size for r in seeds):
        seeds = fit.orderBy(*order).limit(ENTRIES).select(v.alias("v")).collect()
    # doubles hold 1024 times a float exactly
    scaled = F.transform(v.cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    state = fit.select(
        *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], scaled.alias("vector"),
        F.array_repeat(F.lit(-1).cast("smallint"), PARTS).alias("code"), F.array_repeat(F.lit(0).cast("long"), PARTS).alias("distance"),
    )
    first = [[max(-LARGEST, min(LARGEST, math.floor(float(x) * SCALE))) for x in r["v"]] for r in seeds] if size else []
    codebooks = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2) if first else np.zeros((PARTS, 0, 0), np.int64)
    moved = [np.arange(len(first))] * PARTS
    if first:
        before = None
        for _ in range(rounds):
            state = stage(assigned(state, codebooks, moved), "codes")
            codebooks, moved = renewed(codebooks, part_sums(state, width))
            if before is not None:
                discard(before)
            before = state
        state = stage(assigned(state, codebooks, moved), "codes")
        if before is not None:
            discard(before)
    return state.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "code", "distance"), codebooks


def vector_codes(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """``key``, code (two hex digits per part), error (squared distance of all parts), label_error (summed over equal labels, nulls together) and codebooks_sha256.

    See ``train_codes``. Repeated rows have rows of their own and count as often in the means; other columns are ignored; an empty table stays empty.
    """
    coded, codebooks = train_codes(vectors, vec, (key, label), key)
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, d: a + d)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = coded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), code.alias("code"), error.alias("error"))
    # one row per label, added up before the shuffle
    totals = broadcast_if_bytes(stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels"))
    both = rows.alias("l").join(totals.alias("r"), F.col("l.label").eqNullSafe(F.col("r.label")))
    return both.select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256")
    )
