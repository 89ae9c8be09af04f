"""Best-fit packing of tokenised documents into sequences of bounded length by minimum bin slack."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortloom.llm.batches import BoundedCache, slices
from cohortloom.staging import broadcast_if_small, stage

#: Fixed pattern of the vocabulary: the parts of a word that are merged on their own.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WIDE = re.compile("[^\x00-\xff]")
CACHED_WORDS = 500_000
#: Pieces that one task numbers at most, within one length.
PIECES_PER_TASK = 250_000


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by a tokenizer that drops white space.

    The library encodes each distinct word once per worker. Words are cut at ASCII white space, and A-Z lower-cased
    where no combining character can follow them, as the file's own normaliser does. A printable Latin-1 word needs no further normalising but
    lower case, so its parts go straight to the library's merge model; any other word takes the library's whole
    way, and so does a text that holds a special string.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.parts = regex.compile(PARTS)
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.shown = {b: b if b in plain else next(others) for b in range(256)}
        self.words = BoundedCache(self._word, CACHED_WORDS)
        probe = "Ab  c\tÉ's 12!? Straße"
        if self.encode(probe) != self._whole(probe):
            raise ValueError("the vocabulary does not drop white space and lower-case")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isprintable() or max(text) > "\xff":
            return self._whole(text)
        ids = []
        for part in self.parts.findall(text.lower()):
            ids += [x.id for x in self.model.tokenize(part.encode().decode("latin-1").translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._whole(text)
        raw = text.encode()
        return b"".join(map(self.words.__getitem__, (raw if WIDE.search(text) else raw.lower()).split()))


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECE = StructType([
    StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()),
])


def token_pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length and CRC-32 of the ids of every document, each followed by ``end_id``.

    Documents of more than ``limit`` ids are cut into pieces of ``limit``; the last may be shorter. A null or empty
    text is one piece that holds ``end_id`` alone.
    """
    schema = StructType([docs.schema[key], *PIECE.fields])
    width, tail = 4 * limit, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, encode = to_arrow_schema(schema), word_ids(path).encode
        for batch in batches:
            for part in slices(batch, text):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, x in enumerate(part.column(text).to_pylist()):
                    raw = encode(x or "") + tail
                    for k, first in enumerate(range(0, len(raw), width)):
                        cut = raw[first : first + width]
                        rows.append(row)
                        piece.append(k)
                        start.append(first // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                columns = [part.column(key).take(pa.array(rows, pa.int64())).cast(wanted.field(0).type)]
                columns += [pa.array(x, f.type) for x, f in zip((piece, start, length, crc), list(wanted)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, as often as ``counts`` allows, whose sum is the largest that is at most ``room``.

    A bit per sum: bit s of ``reach[k]`` says whether the k longest lengths make the sum s. Read back from the
    shortest length, a sum keeps a short length only where the longer ones cannot make it alone.
    """
    parts, reach, mask = [], [1], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            parts.append((length, times))
            reach.append(reach[-1] | reach[-1] << (length * times) & mask)
            left, times = left - times, times * 2
    total = reach[-1].bit_length() - 1
    chosen: list[int] = []
    for k in range(len(parts), 0, -1):
        if not reach[k - 1] >> total & 1:
            length, times = parts[k - 1]
            chosen += [length] * times
            total -= length * times
    return chosen


def bin_patterns(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, number of equal bins), from the number of pieces of each length.

    Each bin starts with the longest length left and gets the combination that fills it best. The bin is repeated
    as long as its lengths last, so that the work depends on the number of distinct lengths alone.
    """
    left, bins = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, limit - longest)]
        left[longest] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in used.items())
        bins.append((sorted(chosen, reverse=True), times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset): places that pieces take by their rank."""
    taken: dict[int, int] = {}
    found: dict[int, list] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(pieces: DataFrame, limit: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be a staged table.

    Only the number of pieces per length (at most ``limit`` of them) reaches the driver, which finds the bins.
    A piece takes the place of its rank among those of its length; crowded lengths are numbered in parts by a
    hash of ``order``. Equal rows get places of their own, nulls in ``order`` come first, an empty
    table stays empty.
    """
    if {"__part", "__rank", "__before", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("pieces must not have columns of these names")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= limit for length in counts):
        raise ValueError("a piece must have 1 to limit ids")
    places = slots(bin_patterns(counts, limit))
    parts = {x: -(-n // PIECES_PER_TASK) for x, n in counts.items()}
    n_parts = F.create_map(*[F.lit(v).cast("long") for x in parts.items() for v in x])[F.col("length")] if parts else F.lit(1)
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*order), n_parts))
    numbered = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order)) - 1)
    if any(n > 1 for n in parts.values()):
        sizes = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        offsets = stage(sizes.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before")), "part_sizes")
        numbered = numbered.join(broadcast_if_small(offsets), ["length", "__part"])
    else:
        numbered = numbered.withColumn("__before", F.lit(0))
    names = pieces.columns
    numbered = numbered.select(*names, (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            by_length = np.argsort(length, kind="stable")
            found, first = np.unique(length[by_length], return_index=True)
            for x, rows in zip(found.tolist(), np.split(by_length, first[1:]), strict=True):
                table = places[x]
                at = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            columns = [batch.column(n).cast(wanted.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=wanted)

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Places of all documents in sequences of at most ``limit`` ids: ``key``, piece, start, length, ids_crc32,
    sequence_id and offset. Edge cases as in ``token_pieces`` and ``pack``."""
    pieces = stage(token_pieces(docs, path, limit, text=text, key=key), "pieces")
    return pack(pieces, limit, (key, "piece"))
