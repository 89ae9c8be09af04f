"""Passages of a benchmark in documents, found by an Aho-Corasick automaton over its words."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortloom.llm.batches import slices
from cohortloom.staging import stage

#: Words of a window, and bytes of item texts that one automaton is made of.
WINDOW, PART_BYTES = 10, 8 * 1024 * 1024
#: Bytes of a text to normalised ones: A-Z become lower case, what no word holds becomes a space.
NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[bytes]:
    """Words of a text in lower case, as UTF-8. No byte of a longer code point is below 128, so bytes do for code points."""
    return text.encode().translate(NORMAL).split()


class Windows:
    """Automaton over the windows of items: consecutive ``WINDOW`` words, or all words of a shorter item.

    Its symbols are words: each word of the items has a number, all others are 0, which no window holds.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words(text))
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                own = owners[ids[i : i + window]]
                if item is not None:
                    own.add(item)
        self.numbers = numbers
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, own in owners.items():
            self.automaton.add_word(ids, (len(ids), tuple(own)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """First and last word of each occurrence, in the order of the last, and the items with an occurring window."""
        firsts, lasts, items = [], [], set()
        if not self.empty and text:
            known = self.numbers.get
            ids = tuple([known(w, 0) for w in text])
            for last, (size, own) in self.automaton.iter(ids):
                firsts.append(last - size + 1)
                lasts.append(last)
                items.update(own)
        return firsts, lasts, items


def runs(firsts: list[int], lasts: list[int]) -> list[tuple[int, int]]:
    """Runs of words (first, last) that the occurrences cover; runs that touch or overlap are one."""
    found: list[tuple[int, int]] = []
    for first, last in sorted(zip(firsts, lasts, strict=True)):
        if found and first <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


def places(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) of runs of words in the original text."""
    starts, ends, out = {a for a, _ in found}, {b for _, b in found}, []
    for i, word in enumerate(WORD.finditer(text)):
        if i in starts:
            start = word.start()
        if i in ends:
            out.append((start, word.end()))
    return out


#: What a scan knows of a document: number of words, runs of hit words, their places in the text, and items.
FOUND = "struct<n_words:bigint,hits:array<struct<first:int,last:int>>,spans:string,items:array<string>>"


def _scan(rows: DataFrame, automaton, text: str, found: str) -> DataFrame:
    """``rows`` with the column ``found`` renewed: what it holds, and what the automaton finds in the whole text."""
    schema = rows.schema

    def joined(text: str, old: dict | None) -> dict:
        own = words(text)
        firsts, lasts, items = automaton.value.scan(own)
        if old is not None:
            firsts += [h["first"] for h in old["hits"]]
            lasts += [h["last"] for h in old["hits"]]
            items.update(old["items"])
        covered = runs(firsts, lasts)
        spans = ",".join(f"{a}:{b}" for a, b in places(text, covered)) if covered else ""
        hits = [{"first": a, "last": b} for a, b in covered]
        return {"n_words": len(own), "hits": hits, "spans": spans, "items": sorted(items, key=lambda i: i.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        at = wanted.get_field_index(found)
        for batch in batches:
            for part in slices(batch, text):
                new = [joined(t or "", old) for t, old in zip(part.column(text).to_pylist(), part.column(found).to_pylist(), strict=True)]
                columns = [pa.array(new, wanted.field(i).type) if i == at else part.column(i).cast(wanted.field(i).type) for i in range(len(wanted))]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return rows.mapInArrow(run, schema)


class _Automaton:
    """Built where it is first used: once per worker, from the items that were broadcast."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.items, self.window, self.made = items, window, None

    def __getstate__(self):
        return self.items, self.window, None

    def __setstate__(self, state):
        self.items, self.window, self.made = state

    def scan(self, text: list[bytes]):
        if self.made is None:
            self.made = Windows(self.items, self.window)
        return self.made.scan(text)


def benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Columns ``keep`` of every document, ``n_words``, ``hits`` (first and last word of each run of hit words), ``items`` and ``spans``.

    A document word is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or all of a
    shorter one. ``spans`` are the runs as code points of the original text (start:end, end exclusive). ``items`` are the ids of
    items with occurring windows, as text, in bytewise order, each once.

    The texts of the items become one automaton. Its size is bounded: beyond ``part_bytes`` of item texts the items are dealt by a
    hash into parts of about that size, and one scan follows the other in the same tasks; a longer item is a part of its own size.
    Documents do not move. Null texts have no words. Windows of an item without an id count as hit, but name no item. Repeated items count once.
    """
    items = stage(benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t")).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__t"), F.lit(None).cast(FOUND).alias("__found"))
    context = docs.sparkSession.sparkContext
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == part)
        listed = [(r["item"], r["t"]) for r in own.collect()]  # at most about ``part_bytes``
        rows = _scan(rows, context.broadcast(_Automaton(listed, window)), "__t", "__found")
    return rows.select(*[F.col(f"`{c}`") for c in keep], "__found.n_words", "__found.hits", "__found.spans", "__found.items")


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key``, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans of every document.

    The items' ids are sorted as text and joined by commas for the digest; without any it is that of the empty text. Repeated
    rows and null keys have rows of their own; other columns are ignored; an empty table stays empty, and without
    items no word is hit.
    """
    found = benchmark_passages(docs, benchmark, keep=(key,), **options)
    return found.select(
        F.col(f"`{key}`"), "n_words", n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "spans",
    )
