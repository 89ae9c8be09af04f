"""Token counts of byte-level vocabularies by pair merging on a heap and a linked list."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cohortloom.llm.batches import BoundedCache, map_texts

#: Fixed pattern of the vocabulary: where byte-level files of this kind cut a text before merging.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_UNITS = 600_000


class MergeCounter:
    """Number of tokens of a text: its bytes minus the merges that the vocabulary makes.

    Symbols are numbers: bytes first, then one for each merge, in order. A text without two neighbouring
    white-space characters is cut before each space and line feed, where no token spans, so that units can be cached.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        symbols = {shown: byte for byte, shown in enumerate(self._shown_bytes())}
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[symbols[left] << 20 | symbols[right]] = rank
            symbols.setdefault(left + right, 256 + rank)
        self.merged = [symbols["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.pieces = regex.compile(PIECES)
        self.double = regex.compile(r"\s\s")
        self.units = BoundedCache(self._unit, CACHED_UNITS)
        self.words = BoundedCache(self._word, CACHED_UNITS)

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable character that stands for each byte in such files."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def _word(self, word: str) -> int:
        """Pop the lowest-ranked pair, leftmost first, until no pair has a rank."""
        symbols = list(word.encode())
        n = count = len(symbols)
        if n < 2:
            return n
        ranks, merged = self.ranks, self.merged
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 20 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = merged[rank], -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 20 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] << 20 | symbols[i])) is not None:
                heappush(heap, r << 32 | h)
        return count

    def _pieces(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pieces.findall(text)))

    def _unit(self, unit: str) -> int:
        return self._pieces(unit if unit[:1] == "\n" else " " + unit)

    def plain(self, text: str) -> int:
        """Tokens of a text that holds no special string."""
        if not text:
            return 0
        if self.double.search(text):
            return self._pieces(text)
        first, *units = text.replace("\n", " \n").split(" ")
        return self._pieces(first) + sum(map(self.units.__getitem__, units))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token."""
        if self.cut is None or not any(x in text for x in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, bytes and tokens of every text, and whether the tokens exceed ``limit``.

    The counts are those of the vocabulary's own library without begin or end tokens. Rows stay where they are: no
    shuffle. Null and empty texts have no bytes and no tokens; equal rows are counted each; other columns
    are ignored, whatever their names; an empty table gives an empty table.
    """
    out = StructType([
        StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()),
    ])

    def make():
        count = counter(path).count

        def work(texts: list[str]) -> dict:
            tokens = [count(x) for x in texts]
            return {"n_bytes": [len(x.encode()) for x in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return work

    return map_texts(docs, make, out, text, list(keep))
