"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import functools
import hashlib
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortloom.llm.batches import BoundedCache, map_texts

SPACE = "▁"
CACHED_SEGMENTS = 600_000


class PieceCodec:
    """Merges the best-scored adjacent pair, leftmost on ties, until none is a piece of the vocabulary.

    No piece of such a vocabulary has a word before its space mark, and none holds a line feed, so that a text is
    encoded in segments that begin there. This is tested when the file is read. A segment is cut again between two
    characters that stand side by side in no piece, since no merge can join them. Each segment that is new to a
    worker is encoded by the agenda and held against the library; a difference stops the job.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self.library.get_piece_size())
        pieces = [self.library.id_to_piece(i) for i in size]
        special = {i for i in size if self.library.is_control(i) or self.library.is_unknown(i)}
        bytes_ = [i for i in size if self.library.is_byte(i)]
        if len(bytes_) != 256 or any(self.library.is_unused(i) for i in size):
            raise ValueError("the vocabulary needs a piece for each byte and no unused pieces")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces must not join words")
        self.scores = {p: (self.library.get_score(i), i) for i, p in enumerate(pieces) if i not in special and i not in set(bytes_)}
        self.byte_ids = [0] * 256
        for i in bytes_:
            self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.shown = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for byte, i in enumerate(self.byte_ids):
            self.shown[i] = bytes([byte])
        self.marked = {i for i, p in enumerate(pieces) if p.startswith(SPACE)}
        self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.cache = BoundedCache(self._unit, CACHED_SEGMENTS)
        self.segments = BoundedCache(self._segment, CACHED_SEGMENTS)
        self.runs = BoundedCache(lambda run: tuple(self.agenda(run)), CACHED_SEGMENTS)
        self.joined = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.fresh: list[tuple[str, list[int]]] = []
        if self.encode("a b\n") != self.library.encode("a b\n"):
            raise ValueError("the file's normaliser is not the plain one")

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment."""
        symbols: list[str | None] = list(segment)
        scores, n = self.scores, len(segment)
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                heap.append((-scores[pair][0], i, pair))
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in scores:
                    heappush(heap, (-scores[new][0], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in scores:
                    heappush(heap, (-scores[new][0], h, new))
        ids = []
        for symbol in symbols:
            if symbol is not None:
                known = scores.get(symbol)
                ids.extend([known[1]] if known else [self.byte_ids[b] for b in symbol.encode()])
        return ids

    def _segment(self, segment: str) -> tuple[str, bytes]:
        joined, first, ids = self.joined, 0, []
        for last in range(1, len(segment)):
            if segment[last - 1 : last + 1] not in joined:
                ids += self.runs[segment[first:last]]
                first = last
        ids += self.runs[segment[first:]]
        self.fresh.append((segment, ids))
        return ",".join(map(str, ids)), b"".join([self.shown[i] for i in ids])

    def _unit(self, unit: str) -> tuple[str, bytes]:
        return self._segment(unit if unit[:1] == "\n" else SPACE + unit)

    def verify(self) -> None:
        """Hold the segments that are new since the last call against the library, in one call."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return
        given = [s[1:].replace(SPACE, " ") if s[0] == SPACE else s for s, _ in fresh]
        lone = self.scores[SPACE][1]
        for (segment, ids), text, expected in zip(fresh, given, self.library.encode(given, num_threads=1), strict=True):
            if segment == SPACE:
                expected = [lone]
            elif segment[0] != SPACE:
                expected = expected[1:]
            if ids != expected:
                raise ValueError(f"the agenda and the library differ on {text[:80]!r}")

    def parts_of(self, text: str) -> list[tuple[str, bytes]]:
        """Ids as text and decoded bytes of each segment of a text."""
        if not text:
            return []
        cut = text.replace("\n", " \n")
        if cut[0] != " " and "  " not in cut and SPACE not in text:
            return list(map(self.cache.__getitem__, cut.split(" ")))
        return list(map(self.segments.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts_of(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first space mark goes, runs of byte pieces become characters."""
        raw = b"".join([self.shown[i] for i in ids])
        return (raw[1:] if ids and ids[0] in self.marked else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` (array of int) and ``decoded`` (text of these ids) of every text.

    Null and empty texts have no ids and decode to an empty text; equal rows are encoded each; other columns are
    ignored; an empty table gives an empty table. Rows stay where they are.
    """
    out = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def make():
        code = codec(path)

        def work(texts: list[str]) -> dict:
            ids = [code.encode(x) for x in texts]
            code.verify()
            return {"ids": ids, "decoded": [code.decode(x) for x in ids]}

        return work

    return map_texts(docs, make, out, text, list(keep))


def encoding_digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, number of ids, SHA-256 of the ids joined by commas and of the decoded text; edge cases as
    in ``encode_texts``."""
    out = StructType([
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ])

    def make():
        code = codec(path)

        def work(texts: list[str]) -> dict:
            found: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for x in texts:
                parts = code.parts_of(x)
                ids = ",".join([ids for ids, _ in parts]).encode()
                decoded = b"".join([raw for _, raw in parts])[1:]
                found["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
                found["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                found["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            code.verify()
            return found

        return work

    return map_texts(docs, make, out, text, list(keep))
