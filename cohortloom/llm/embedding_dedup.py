"""Near duplicates of embeddings by sorted projection passes within labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.components import components
from cohortloom.llm.near_dedup import whole_groups
from cohortloom.staging import broadcast_if_bytes, scratch, stage

#: Vectors that a window is meant to hold, and bits of an order's hash at most.
COSINE, WINDOW, BITS = 0.93, 128, 24
#: Chance wanted that some pass brings a pair at the threshold into one window.
RECALL = 0.9999
#: Vectors of a chunk of a crowded window, and of one product with another chunk.
FULL_CHUNK, FULL_ROWS = 2000, 250


def plan_passes(n: int, spread: float, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> tuple[int, int]:
    """Leading bits that make a window, and passes, for ``n`` unit vectors whose mean square distance from their mean is ``spread``.

    Seen from the mean, vectors at the threshold stand at an angle that grows as the spread shrinks; a random plane separates them with
    probability angle / pi. Of all numbers of bits that leave about ``window`` vectors or more, the one with the fewest compared pairs
    is taken. That is no bit and one pass, a full comparison, where passes would compare as many.
    """
    apart = 2 * (1 - cosine)
    together = 1 - math.acos(max(-1.0, min(1.0, 1 - apart / (2 * max(spread, 1e-9))))) / math.pi
    best = (1.0, 0, 1)
    for bits in range(1, min(BITS, int(math.log2(max(1, n / window)))) + 1):
        shared = min(together**bits, 1 - 1e-12)
        passes = max(1, math.ceil(math.log(1 - recall) / math.log1p(-shared))) if shared > 1e-6 else 10**6
        best = min(best, (passes / 2**bits, bits, passes))
    return best[1:]


def planes(turn: int, size: int) -> np.ndarray:
    """Random planes of a pass, one per bit; the same on every executor."""
    return np.random.Generator(np.random.PCG64([turn, size])).standard_normal((size, BITS))


def linked(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the unit vectors x and y reach the cosine, a bounded number of pairs at a time."""
    return np.concatenate([np.empty(0, bool), *[
        np.einsum("ij,ij->i", vectors[x[i : i + 20_000]], vectors[y[i : i + 20_000]]) >= cosine for i in range(0, len(x), 20_000)
    ]])


def unit_vectors(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each length that occurs."""
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join([raw[i] for i in rows]), np.float64).reshape(len(rows), -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        yield rows, v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def classes_of(vectors: DataFrame, vec: str, label: str, key: str) -> DataFrame:
    """``id`` (smallest key), ``kind`` (label and length), ``vector`` and ``copies`` of each distinct usable vector of a label."""
    v = F.col(f"`{vec}`")
    usable = F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one number
    rows = vectors.where(usable & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{label}`"), F.size(v)).alias("kind"),
        F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
    )
    return rows.groupBy("kind", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _stars(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Links of each local component's members with its smallest id."""
    order = np.argsort(ids, kind="stable")
    _, first, at = np.unique(root[order], return_index=True, return_inverse=True)
    hub = ids[order][first][at]
    return np.column_stack([ids[order], hub])[ids[order] != hub]


def _vectors(column: pa.Array) -> list[bytes]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def in_orders(classes: DataFrame, cosine: float, window: int, exact: bool) -> DataFrame:
    """``classes`` with ``places``: the window of each vector in the order of each pass of its kind, the leading bits of its hash there.

    The vectors of a kind are hashed from their mean. One narrow aggregate gives the kinds' sizes and means, one row each.
    """
    unit = F.transform("vector", lambda x: x / F.col("norm"))
    largest = F.array_max(F.transform("vector", F.abs))
    rows = classes.withColumn("norm", largest * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + (x / largest) * (x / largest))))
    means = rows.groupBy("kind").agg(vector_to_array(Summarizer.mean(array_to_vector(unit))).alias("mean"), F.count("*").alias("size"))

    @F.pandas_udf("bits int, passes int")
    def planned(size, mean):
        import pandas as pd

        found = [(0, 1) if exact else plan_passes(int(n), max(0.0, 1 - float(np.dot(m, m))), cosine, window) for n, m in zip(size, mean, strict=True)]
        return pd.DataFrame(found, columns=["bits", "passes"])

    kinds = broadcast_if_bytes(stage(means.withColumn("plan", planned("size", "mean")).select("kind", "mean", "plan.*"), "kinds"))
    joined = classes.join(kinds, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            bits, passes = (batch.column(c).to_numpy() for c in ("bits", "passes"))
            places: list = [None] * len(bits)
            means = _vectors(batch.column("mean"))
            for where, unit in unit_vectors(_vectors(batch.column("vector"))):
                size = unit.shape[1]
                seen = unit - np.frombuffer(b"".join([means[i] for i in where])).reshape(len(where), size)
                codes = np.zeros((len(where), passes[where].max()), np.int32)
                for turn in range(codes.shape[1]):
                    if (turn, size) not in cache:
                        cache[turn, size] = planes(turn, size)
                    above = seen @ cache[turn, size] > 0
                    for bit in range(bits[where].max()):
                        codes[:, turn] = np.where(bit < bits[where], 2 * codes[:, turn] + above[:, bit], codes[:, turn])
                for i, code in zip(where, codes, strict=True):
                    places[i] = code[: passes[i]]
            kept = [batch.column(c) for c in ("kind", "id", "vector", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.list_(pa.int32()))], ["kind", "id", "vector", "copies", "places"])

    return joined.mapInArrow(run, "kind long, id long, vector array<double>, copies long, places array<int>")


def window_links(ordered: DataFrame, cosine: float) -> DataFrame:
    """What the windows of all passes show: rows (a, b) that link components found in one, and rows (a, n) of links counted.

    ``ordered``: the result of ``in_orders``. A window that holds more than a chunk is dealt by a hash into chunks of about ``FULL_CHUNK``; two
    chunks meet in a group, so a crowded window is compared in full. Links are verified in double precision. A pair
    that stands in several windows is counted in the first pass that has it, so counts (of copies of the other class) add up over
    passes without a table of pairs, and a group returns at most one link and one count per vector.
    """
    rows = ordered.select("kind", "id", "vector", "copies", "places", F.posexplode("places").alias("turn", "place"))
    rows = rows.withColumn("window", F.xxhash64("kind", "turn", "place"))
    crowded = rows.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > FULL_CHUNK)
    chunks = stage(crowded.select("window", F.ceil(F.col("n") / FULL_CHUNK).cast("int").alias("chunks")), "crowded")
    rows = rows.join(broadcast_if_bytes(chunks), "window", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    group = F.xxhash64("window", F.least("chunk", "other"), F.greatest("chunk", "other"))
    side = F.when(F.col("chunk") == F.col("other"), -1).otherwise(F.col("chunk"))
    # rows without neighbours in their window end here
    rows = rows.select(group.alias("group"), "kind", side.alias("side"), "turn", "id", "vector", "copies", "places")
    rows = rows.repartition("group").sortWithinPartitions("group", "kind", "side", "id")

    def compared(unit, side, turn, ids, copies, places) -> tuple[np.ndarray, np.ndarray]:
        """Root of each vector among the links of a group, and copies of others that are linked here for the first time."""
        n = len(ids)
        root, counts = np.arange(n), np.zeros(n, np.int64)
        within = side[0] < 0
        left = np.arange(n) if within else np.flatnonzero(side == side[0])
        right = left if within else np.flatnonzero(side != side[0])
        for k in range(0, len(left) if len(right) else 0, FULL_ROWS):
            here = left[k : k + FULL_ROWS]
            near = unit[here] @ unit[right].T
            # the product decides but for rounding; close ones are summed up again
            close = np.abs(near - cosine) <= 1e-9
            fit = near >= cosine
            x, y = np.nonzero(close)
            if len(x):
                fit[x, y] = linked(unit, here[x], right[y], cosine)
            if within:
                fit &= here[:, None] < right[None, :]
            for i in np.flatnonzero(fit.any(axis=1)):
                met = right[fit[i]]
                tops = np.unique(np.append(root[met], root[here[i]]))
                if len(tops) > 1:
                    root[np.isin(root, tops)] = tops[0]
            for before in range(turn):
                fit &= places[here, before][:, None] != places[right, before][None, :]
            counts[here] += fit @ copies[right]
            counts[right] += copies[here] @ fit
        return root, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            group, kind, side, turn, ids, copies = (table.column(c).to_numpy() for c in ("group", "kind", "side", "turn", "id", "copies"))
            starts = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(kind) != 0)))
            raw, at = _vectors(table.column("vector")), _vectors(table.column("places"))
            a, b, n = [], [], []
            for first, last in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                if last - first < 2:
                    continue
                spot = slice(first, last)
                unit = next(unit_vectors(raw[spot]))[1]  # a kind has one length
                places = np.frombuffer(b"".join(at[spot]), np.int32).reshape(last - first, -1)
                root, counts = compared(unit, side[spot], int(turn[first]), ids[spot], copies[spot], places)
                stars, own = _stars(ids[spot], root), np.flatnonzero(counts)
                a += [stars[:, 0], ids[spot][own]]
                b += [stars[:, 1], np.full(len(own), -1)]
                n += [np.zeros(len(stars), np.int64), counts[own]]
            if a:
                a, b, n = (np.concatenate(x).astype(np.int64) for x in (a, b, n))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], ["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def near_vectors(
    vectors: DataFrame, vec: str = "embedding", label: str = "label", key: str = "vec_id", cosine: float = COSINE, window: int = WINDOW, exact: bool = False
) -> DataFrame:
    """``key``, n_links (other vectors linked directly), component_id (smallest key reachable) and kept of every row.

    Vectors of equal, non-null label and length are linked by a cosine of ``cosine`` or more in double precision. Equal vectors
    are one class, which counts its copies. Each pass puts the vectors of a label into the order of random hashes, as seen from their mean; those
    that share the leading bits stand in one window and are compared, however many they are. The bits and the number of passes follow from the
    label's size and spread, so that a pair at the threshold meets with probability ``RECALL``; ``window`` is the number of vectors that a
    window is meant to hold. A label that is small or so dense that passes would compare as much is one window, compared in full. ``exact``
    makes every label one. Links join across passes.

    A null label, a vector that is null, empty, zero or holds null or non-finite entries, links with nothing: no links, its own
    component, kept. A null key has a null component and is not kept. Repeated rows count as other vectors; other columns are
    ignored; an empty table stays empty.
    """
    with scratch() as made:
        classes = stage(classes_of(vectors, vec, label, key), "classes")
        found = stage(window_links(in_orders(classes, cosine, window, exact), cosine), "links")
        counts = stage(found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), "counts")
        joined = stage(components(stage(found.where("n = 0").select("a", "b").distinct(), "pairs")), "components")
        made += [classes, counts, joined]
    joined = joined.withColumnRenamed("node", "id")
    result = classes.join(joined, "id", "left").join(counts, "id", "left").select(
        "kind", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    v = F.col(f"`{vec}`")
    own = vectors.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{label}`"), F.size(v)).alias("kind"),
        F.when(F.col(f"`{label}`").isNotNull(), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0))).alias("vector"),
    )
    all_ = own.join(result, ["kind", "vector"], "left")
    component = F.coalesce(F.when(F.col("key").isNotNull(), F.col("component")), F.col("key").cast("long"))
    return all_.select(
        F.col("key").alias(key), F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"),
    )
