"""Language of a text by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortloom.llm.batches import map_texts, slices

#: Entries of a profile, and documents per language that a fit reads at most.
PROFILE_SIZE, FIT_DOCUMENTS = 300, 2000
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
MARK = ord("_")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three characters inside words, as numbers of 21 bits a character, and their counts.

    Words are runs of letters in lower case with a mark on either side.
    """
    words = LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = x[:-1] << 21 | x[1:]
    three = two[:-1] << 21 | x[2:]
    grams, counts = np.unique(np.concatenate([x[x != MARK], two, three[x[1:-1] != MARK]]), return_counts=True)
    return grams, counts


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first; ties by number."""
    grams, counts = ngram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: ``ranks[i, k]`` is the place of ``grams[i]`` in language k, ``size`` if absent."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list to each language; an absent n-gram costs ``size`` places."""
        places = np.full((len(own), len(self.languages)), self.size)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            known = self.grams[at] == own
            places[known] = self.ranks[at[known]]
        out = np.abs(places - np.arange(len(own))[:, None])
        return np.where(places == self.size, self.size, out).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """Nearest language and 1 minus its distance as a share of the largest possible one."""
        own = ranked(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        distance = self.distances(own)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(own)))


def held_out(key: str) -> Column:
    """Whether the key's CRC-32 as text leaves 1 when divided by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE_SIZE, per_language: int = FIT_DOCUMENTS) -> Profiles:
    """Profiles from whole texts of at most ``per_language`` labelled, not held-out documents of each language.

    The documents are those with the smallest hash of the key, so the choice does not depend on partitioning. What
    reaches the driver is ``size`` n-grams a language.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    rows = rows.where(~held_out("k") & F.col("l").isNotNull() & F.col("t").isNotNull()).withColumn("h", F.xxhash64("k"))
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), size)
    # a hash below this bound is held by about twice the documents asked for; the window then counts them out
    shares = F.create_map(*[F.lit(v) for x, n in totals.items() for v in (x, min(1.0, 2 * per_language / n + 1e-3))])
    near = rows.where(F.pmod("h", F.lit(1_000_003)) <= F.lit(1_000_003) * shares[F.col("l")])
    order = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1_000_003)), "h", "k")
    chosen = near.select("k", "l", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    sample = near.join(F.broadcast(chosen.select("k", "l").distinct()), ["k", "l"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                by: dict[str, list] = {}
                for language, x in zip(part.column("l").to_pylist(), part.column("t").to_pylist(), strict=True):
                    by.setdefault(language, []).append(ngram_counts(x))
                for language, found in by.items():
                    grams, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["l", "g", "n"])

    counted = sample.select("l", "t").mapInArrow(run, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g")) - 1).where(F.col("r") < size)
    found = top.select("l", "g", "r").collect()
    languages = sorted({r["l"] for r in found})
    grams = np.unique(np.array([r["g"] for r in found], np.int64))
    ranks = np.full((len(grams), len(languages)), size)
    for r in found:
        ranks[np.searchsorted(grams, r["g"]), languages.index(r["l"])] = r["r"]
    return Profiles(languages, grams, ranks, size)


def predict_languages(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (0 to 1) of every whole text; no shuffle.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Equal
    distances go to the first language by name. Equal texts get equal results; other columns are ignored.
    """
    out = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def make():
        def work(texts: list[str]) -> dict:
            found = [profiles.predict(x) for x in texts]
            return {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return work

    return map_texts(docs, make, out, text, list(keep))


def languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` of all documents, learned from those not held out."""
    found = predict_languages(docs, fit_profiles(docs, text, lang, key), text, (key,))
    return found.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "lang_pred", "score")
