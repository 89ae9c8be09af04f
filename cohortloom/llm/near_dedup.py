"""Near duplicates of documents by min-max hashing of word shingles, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from cohortloom.llm.batches import map_texts
from cohortloom.llm.components import components
from cohortloom.staging import broadcast_if_small, stage

#: Words of a shingle, and per cent of the union that two sets must share.
WORDS, PERCENT = 5, 75
#: Permutations (each gives a minimum and a maximum) and values of a band: 32 bands of 4. A pair at the threshold
#: meets in no band with probability (1 - 0.75**4)**32 = 5e-6.
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Values of 128 that must agree before whole sets are compared: the threshold less five standard deviations.
LEAST_AGREEING = int(2 * PERMUTATIONS * (PERCENT / 100 - 5 * (0.75 * 0.25 / (2 * PERMUTATIONS)) ** 0.5))
#: Documents that one group of comparisons holds at most, on each side.
CHUNK = 100
#: Documents of a band that are compared within one group, on each side.
BLOCK = 1_000

_generator = np.random.Generator(np.random.PCG64(20_240_601))
MULTIPLIERS = _generator.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)
OFFSETS = _generator.integers(0, 2**64, PERMUTATIONS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; of the whole sequence if it is shorter."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=words)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run = (run ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    return np.unique(mixed(run))


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for first in range(0, len(hashes), 2_048):
        values = (hashes[first : first + 2_048] ^ OFFSETS[:, None]) * MULTIPLIERS[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.column_stack([low, high]).ravel()


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number for each band, with the band's place in it."""
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, n_shingles, set_a and set_b (128-bit digest of the set), bands and signature (a byte a value)."""
    out = StructType([
        StructField("n_shingles", LongType()), StructField("set_a", LongType()), StructField("set_b", LongType()),
        StructField("bands", ArrayType(LongType())), StructField("signature", BinaryType()),
    ])

    def make():
        def work(texts: list[str]) -> dict:
            found: dict[str, list] = {f.name: [] for f in out.fields}
            for x in texts:
                own = shingles(x)
                found["n_shingles"].append(len(own))
                if not len(own):
                    for name in ("set_a", "set_b", "bands", "signature"):
                        found[name].append(None)
                    continue
                a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
                values = min_max(own)
                found["set_a"].append(a)
                found["set_b"].append(b)
                found["bands"].append(band_keys(values))
                found["signature"].append((mixed(values) >> np.uint64(56)).astype(np.uint8).tobytes())
            return found

        return work

    return map_texts(docs, make, out, text, [key])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches of a sorted table, cut where the value of ``column`` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held:
            if held[-1].column(column)[-1].as_py() != values[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif not len(changes):
                held.append(batch)
                continue
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, int(changes[-1]))])
            held = [batch.slice(int(changes[-1]))]
        else:
            held = [*held, batch]
    if held:
        yield pa.Table.from_batches(held)


def confirmed(docs: DataFrame, pairs: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole shingle sets share enough.

    The sets are made anew from the texts of the documents in ``pairs``. Each b goes, in parts of ``CHUNK`` partners,
    to the place of its partners; a part holds the set of b and reads those of its a one by one.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    placed = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    left = placed.select(F.col("a").alias("id"), F.struct(F.xxhash64("b", "part").alias("place"), F.lit(1).alias("role"), "b").alias("p"))
    right = parts.select(
        F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    ).select("id", F.struct(F.xxhash64("id", "part").alias("place"), F.lit(0).alias("role"), F.col("id").alias("b")).alias("p"))
    wanted = stage(left.union(right).groupBy("id").agg(F.collect_list("p").alias("places")), "wanted")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")).join(broadcast_if_small(wanted, 100_000), "id")
    out = StructType([StructField("hashes", BinaryType())])
    sets = map_texts(rows, lambda: lambda texts: {"hashes": [shingles(x).tobytes() for x in texts]}, out, "t", ["id", "places"])
    sets = sets.select("id", "hashes", F.explode("places").alias("p")).select("id", "hashes", "p.place", "p.role", "p.b")
    sets = sets.repartition("place").sortWithinPartitions("place", "b", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("place", "b", "role", "id")), batch.column("hashes"), strict=True)
            for place, b, role, a, raw in rows:
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                if at != (place, b):
                    at, own = (place, b), []
                if role == 0:
                    own.append(hashes)
                    continue
                for other in own:
                    common = len(np.intersect1d(hashes, other, assume_unique=True))
                    if 100 * common >= PERCENT * (len(hashes) + len(other) - common):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return sets.mapInArrow(run, "a long, b long")


def band_links(docs: DataFrame, rows: DataFrame, text: str, key: str) -> DataFrame:
    """Links (a, b) between components among the documents of each band.

    ``rows``: band, place (of the band in the signature), id, component, n_shingles, bands, signature, size (documents of the
    band). The sets are made anew from the texts and go to the document's bands. Bands of more than ``BLOCK`` documents are
    cut into chunks, of which each two meet in one group. A pair is looked at where it first meets: if signatures agree
    well enough, whole sets decide. Only links that join what is still apart leave a group, so what is handed on grows with the
    documents and not with the pairs.
    """
    rows = rows.withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("band", "place", "id", "component", "n_shingles", "bands", "signature", "chunk", other)
    group = F.xxhash64("band", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("group")
    side = F.when(F.col("chunk") == F.col("other"), -1).otherwise(F.col("chunk")).alias("side")
    places = F.collect_list(F.struct(group, side, "place")).alias("places")
    wanted = stage(rows.groupBy("id", "component", "n_shingles").agg(places, F.first("bands").alias("bands"), F.first("signature").alias("signature")), "wanted")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")).join(broadcast_if_small(wanted, 100_000), "id")
    out = StructType([StructField("hashes", BinaryType())])
    kept = ["id", "component", "bands", "signature", "places"]
    sets = map_texts(texts, lambda: lambda texts: {"hashes": [shingles(x).tobytes() for x in texts]}, out, "t", kept)
    sets = sets.select("id", "component", "bands", "signature", "hashes", F.explode("places").alias("p"))
    sets = sets.select("id", "component", "bands", "signature", "hashes", "p.group", "p.side", "p.place")
    sets = sets.repartition("group").sortWithinPartitions("group", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            group = table.column("group").to_numpy()
            starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            found = [_links_of(table.slice(x, y - x)) for x, y in zip(starts, [*starts[1:], len(group)], strict=True)]
            links = np.concatenate([np.empty((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return sets.mapInArrow(run, "a long, b long")


def _links_of(group: pa.Table) -> np.ndarray:
    """Links that join components within one group of ``band_links``."""
    ids, root, side = (group.column(c).to_numpy().copy() for c in ("id", "component", "side"))
    if (root == root[0]).all():
        return np.empty((0, 2), np.int64)
    place = group.column("place")[0].as_py()
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    links = []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        j = j[(root[j] != root[i]) & ((side[j] < 0) | (side[j] != side[i])) & (100 * small >= PERCENT * large)]
        j = j[~(bands[j, :place] == bands[i, :place]).any(axis=1)]
        j = j[(signature[j] == signature[i]).sum(axis=1) >= LEAST_AGREEING]
        if not len(j):
            continue
        every = np.concatenate([sets[k] for k in j])
        at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
        common = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum([0, *sizes[j[:-1]]]))
        for k in j[100 * common >= PERCENT * (sizes[i] + sizes[j] - common)].tolist():
            if root[k] != root[i]:
                links.append((ids[i], ids[k]))
                root[root == root[k]] = root[i]
    return np.array(links, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles, component_id (smallest key reachable by links) and kept (component_id is the key itself).

    Two documents are linked if their sets of five-word shingles share 75 per cent of their union or more. Equal sets
    are one class first. In each band every class is compared with the smallest; of these candidates it takes the one
    that it shares most bands with, and the pair is confirmed on whole sets. Bands that still hold several components are
    then compared in full, in blocks that return no more links than documents. Nothing is dropped for being frequent.

    Null or empty texts and texts without words have no shingles, form components of their own and are kept. A
    null key gets a null component and is not kept. Keys are whole numbers; rows that repeat a key and text get equal results.
    Other columns are ignored; an empty table stays empty.
    """
    made = stage(sketches(docs, text, key).select(F.col(f"`{key}`").cast("long").alias("id"), "n_shingles", "set_a", "set_b", "bands", "signature"), "sketches")
    sets = made.where("id is not null and n_shingles > 0")
    same = ["set_a", "set_b", "n_shingles"]
    classes = stage(sets.groupBy(*same).agg(F.min("id").alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    in_bands = classes.select(F.col("first").alias("id"), F.posexplode("bands").alias("place", "band"))
    crowded = in_bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    shared = stage(in_bands.join(crowded, "band"), "bands")
    best = F.max(F.struct("n", (-F.col("hub")).alias("h")))
    nearest = shared.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n")).groupBy("id").agg(best.alias("x"))
    first = stage(confirmed(docs, stage(nearest.select(F.col("id").alias("a"), (-F.col("x.h")).alias("b")), "pairs"), text, key), "confirmed")
    known = stage(components(first), "components")
    at = shared.join(known.withColumnRenamed("node", "id"), "id", "left").select("band", "place", "id", "size", F.coalesce("component", "id").alias("component"))
    open_ = at.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    about = classes.select(F.col("first").alias("id"), "n_shingles", "bands", "signature")
    second = stage(band_links(docs, at.join(open_, "band").join(about, "id"), text, key), "links")
    found = stage(components(first.union(second)), "components").withColumnRenamed("node", "first")
    of_class = classes.select(*same, "first").join(found, "first", "left").select(*same, F.coalesce("component", "first").alias("component"))
    merged = made.select("id", *same).join(of_class, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return merged.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
