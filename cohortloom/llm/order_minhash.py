"""Order MinHash fingerprints of texts, in column expressions alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortloom.llm.columns import let

#: Characters of a k-mer, components of a fingerprint, k-mers of a component, and elements taken from a long text on average.
K, COMPONENTS, PICKED, EXPECTED = 8, 64, 2, 800
#: Documents of one neighbour window and of one task, and the most windows.
WINDOW_DOCUMENTS, TASK_DOCUMENTS, MOST_BOUNDS = 500, 2_500, 131_072
#: An entry is one long: component in the highest bits, the rest of a hash, and a position in the text in the lowest.
POSITION_BITS, COMPONENT_BITS = 31, 6
HASH_BITS = -(1 << POSITION_BITS)
PLACE = ~HASH_BITS
WITHIN = (1 << (64 - COMPONENT_BITS)) - 1


def no_entries() -> Column:
    """An empty array whose type allows no nulls, so that arrays made with it are sorted as plain longs."""
    return F.slice(F.array(F.lit(0).cast("long")), 1, 0)


def limit_for(n: Column) -> Column:
    """Largest place within a component (hash and position) that about ``EXPECTED`` of n elements do not exceed; the largest of all for short texts."""
    share = (F.lit(float(EXPECTED)) / n * float(1 << (64 - COMPONENT_BITS - POSITION_BITS))).cast("long")
    return F.when(n <= EXPECTED, F.lit(WITHIN)).otherwise(F.shiftleft(share, POSITION_BITS) + F.lit(PLACE))


def kmers(text: Column, skip: Column | int = 0) -> Column:
    """Entries of the k-mers of a text in its order, but for the first ``skip``: the upper bits of a k-mer's hash, then its position.

    The text is read as four bytes per character, in which a k-mer is found without walking there; positions count these bytes.
    A text shorter than k is one k-mer.
    """
    skip = skip if isinstance(skip, Column) else F.lit(skip)

    def entry(part: Column, position: Column) -> Column:
        return F.xxhash64(part).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(position.cast("long"))

    def several(wide: Column) -> Column:
        starts = F.sequence(skip.cast("int") * 4 + 1, F.octet_length(wide) - (4 * K - 1), F.lit(4))
        return F.transform(starts, lambda i: entry(F.substr(wide, i, F.lit(4 * K)), i))

    wide = F.encode(text, "UTF-32")
    left = F.char_length(text) - skip
    return F.when(left >= K, let(wide, several)).when((F.char_length(text) > 0) & (skip == 0), F.array(entry(wide, F.lit(1)))).otherwise(no_entries())


def _again(x: Column, before: Column) -> Column:
    """Whether an entry's k-mer is that of the entry before it, of sorted entries; null for the first one, which has none."""
    return x <= before.bitwiseOR(F.lit(PLACE))


def _beside(entries: Column, body: Callable[[Column, Callable], Column], by: int = 1) -> Column:
    """``body`` of entries and of a function that gives the entry ``by`` places before a place."""
    shifted = F.concat(F.array_repeat(F.lit(None).cast("long"), by), entries)
    return let(shifted, lambda s: body(entries, lambda i: F.get(s, i)))


def low(ordered: Column, limit: Column) -> Column:
    """Of sorted ``kmers``, those of a place up to the limit, and all repeats."""
    kept = lambda most: _beside(ordered, lambda o, at: F.filter(o, lambda x, i: (x.bitwiseAND(F.lit(WITHIN)) <= most) | _again(x, at(i))))
    return let(limit, kept)


def repeats(found: Column, limit: Column) -> Column:
    """The entries of ``low`` that are not the first of their k-mer: one of a larger place is there for no other reason."""
    kept = lambda most: _beside(found, lambda o, at: F.filter(o, lambda x, i: (x.bitwiseAND(F.lit(WITHIN)) > most) | _again(x, at(i))))
    return let(limit, kept)


def _first(x: Column, before: Column) -> Column:
    return F.coalesce(x > before.bitwiseOR(F.lit(PLACE)), F.lit(True))


def firsts(found: Column, limit: Column) -> Column:
    """The other entries of ``low``, which are elements as they are."""
    kept = lambda most: _beside(found, lambda o, at: F.filter(o, lambda x, i: (x.bitwiseAND(F.lit(WITHIN)) <= most) & _first(x, at(i))))
    return let(limit, kept)


def _element(x: Column, number: Column) -> Column:
    """Element of a repeat: hash of the k-mer's hash and the occurrence number, and the position."""
    return F.xxhash64(x.bitwiseAND(F.lit(HASH_BITS)), number).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))


def _up_to(found: Column, limit: Column) -> Column:
    return let(limit, lambda most: F.filter(found, lambda x: x.bitwiseAND(F.lit(WITHIN)) <= most))


def seconds(again: Column, limit: Column) -> Column:
    """Elements of second occurrences, the first ones of each k-mer in ``repeats``, up to the limit."""
    own = _beside(again, lambda o, at: F.filter(o, lambda x, i: _first(x, at(i))))
    return _up_to(F.transform(own, lambda x: _element(x, F.lit(2))), limit)


def beyond(again: Column) -> Column:
    """The other entries of ``repeats``: third and further occurrences."""
    return _beside(again, lambda o, at: F.filter(o, lambda x, i: _again(x, at(i))))


def numbered(more: Column, limit: Column) -> Column:
    """Elements of third and further occurrences, which are ``more`` in the order of their k-mers, up to the limit."""
    run = lambda o, s, e: F.transform(F.slice(o, s + 1, e - s), lambda x, i: _element(x, i + 3))

    def runs(o: Column) -> Column:
        # places of the first entries of each k-mer
        starts = F.filter(F.transform(o, lambda x, i: F.when(_first(x, F.get(o, i - 1)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return let(starts, lambda b: F.flatten(F.transform(b, lambda s, j: run(o, s, F.coalesce(F.get(b, j + 1), F.size(o))))))

    return F.when(F.size(more) > 0, _up_to(let(more, runs), limit)).otherwise(no_entries())


def picked(elements: Column) -> Column:
    """The ``PICKED`` first elements of each component, of sorted elements."""
    return _beside(elements, lambda o, at: F.filter(o, lambda x, i: F.coalesce(x > at(i).bitwiseOR(F.lit(WITHIN)), F.lit(True))), PICKED)


def _component(x: Column) -> Column:
    return F.shiftright(x, 64 - COMPONENT_BITS) + COMPONENTS // 2


def _value(x: Column, y: Column) -> Column:
    """Hash of two elements in the order of the text, or of the only one."""
    p, q = (e.bitwiseAND(F.lit(PLACE)) for e in (x, y))
    a, b = (e.bitwiseAND(F.lit(HASH_BITS)) for e in (x, y))
    return F.pmod(F.when(y.isNull(), F.xxhash64(a)).when(p < q, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a)), F.lit(2**32 - 1))


def complete(picks: Column) -> Column:
    """Components that have all their picks: component in the upper half of a long, hash of its elements in the lower."""

    def entry(x: Column, y: Column) -> Column:
        # picks of a component stand together, and there are at most ``PICKED``
        found = F.when(y <= x.bitwiseOR(F.lit(WITHIN)), F.shiftleft(_component(x), 32) + _value(x, y))
        return F.coalesce(found, F.lit(-1).cast("long"))

    each = let(picks, lambda o: F.transform(o, lambda x, i: let(F.get(o, i + 1), lambda y: entry(x, y))))
    return F.filter(F.transform(each, lambda x: F.coalesce(x, F.lit(-1).cast("long"))), lambda x: x >= 0)


def filled(done: Column, every: Column) -> Column:
    """``done`` with each lacking component: the ``PICKED`` first of ``every`` element by a hash salted with the component, in the order of the text."""

    def salted(c: Column) -> Column:
        hashed = F.transform(every, lambda x: F.xxhash64(c, x.bitwiseAND(F.lit(HASH_BITS))).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))
        value = let(F.sort_array(hashed), lambda o: _value(F.get(o, F.lit(0)), F.get(o, F.lit(1))))
        return F.coalesce(F.shiftleft(c, 32) + value, F.lit(0).cast("long"))

    components = F.transform(done, lambda x: F.shiftright(x, 32))
    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(COMPONENTS - 1).cast("long")), components)
    return F.sort_array(F.concat(done, F.transform(lacking, salted)))


def shown(parts: Column) -> Column:
    """Text of a fingerprint: number and hash of each component, as one hexadecimal number, in order."""
    return F.lower(F.array_join(F.transform(parts, lambda x: F.hex(x)), " "))


def likeness(a: Column, b: Column) -> Column:
    """Share of components that agree; 1 for two texts without characters, 0 if one has some."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def add_fingerprint(rows: DataFrame, found: str, name: str) -> DataFrame:
    """Column ``name``: the components of a text, of which column ``found`` holds all ``kmers``.

    A k-mer's first occurrence has its hash, a further one the hash of the k-mer's hash and the occurrence number, so any of them is as likely to be
    low. Entries sort by component, hash and position as plain longs. One pass over the sorted entries keeps the low and the repeated ones;
    only repeats are numbered. Of a long text only elements with low hashes are taken, as the smallest of each component have;
    wherever a component lacks ``PICKED`` of them, all are. Components that still lack some, as in short texts, pick from all
    elements by a hash of their own, so every text with characters fills all components.
    """
    n, no_limit = F.size(found), F.lit(WITHIN)
    rows = rows.withColumn("__ordered", F.sort_array(F.col(found))).withColumn("__limit", limit_for(n))

    def with_elements(rows: DataFrame, limit: Column, needed: Column | None, to: str) -> DataFrame:
        """Sorted elements up to a limit, for the rows that need them."""
        only = (lambda c: c) if needed is None else (lambda c: F.when(needed, c).otherwise(no_entries()))
        rows = rows.withColumn("__low", only(low(F.col("__ordered"), limit)))
        rows = rows.withColumn("__again", only(repeats(F.col("__low"), limit)))
        rows = rows.withColumn("__more", only(beyond(F.col("__again"))))
        first = firsts(F.col("__low"), limit)
        return rows.withColumn(to, only(F.sort_array(F.concat(first, seconds(F.col("__again"), limit), numbered(F.col("__more"), limit)))))

    rows = with_elements(rows, F.col("__limit"), None, "__some")
    rows = rows.withColumn("__picked", picked(F.col("__some")))
    rows = rows.withColumn("__lacks", F.size("__picked") < COMPONENTS * PICKED)
    rows = with_elements(rows, no_limit, F.col("__lacks") & (n > EXPECTED), "__every")
    whole = F.when(n > EXPECTED, F.col("__every")).otherwise(F.col("__some"))
    rows = rows.withColumn("__every", F.when(F.col("__lacks"), whole).otherwise(no_entries()))
    rows = rows.withColumn("__picked", F.when(F.col("__lacks") & (n > EXPECTED), picked(F.col("__every"))).otherwise(F.col("__picked")))
    rows = rows.withColumn("__done", complete(F.col("__picked")))
    lacking = (n > 0) & (F.size("__done") < COMPONENTS)
    rows = rows.withColumn(name, F.when(lacking, filled(F.col("__done"), F.col("__every"))).otherwise(F.col("__done")))
    return rows.drop("__ordered", "__limit", "__low", "__again", "__more", "__some", "__every", "__picked", "__lacks", "__done")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``components`` (component in the upper half of a long, hash in the lower) of every whole text; no shuffle.

    Null and empty texts have no components. Equal texts have equal ones.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    rows = rows.withColumn("__kmers", kmers(F.col("__t")))
    return add_fingerprint(rows, "__kmers", "components").drop("__t", "__kmers")


def _bounds(ids: DataFrame) -> tuple[list, int]:
    """Ids that end the neighbour windows, in order; the largest id is the last. At most ``MOST_BOUNDS``. And the number of rows."""
    n = ids.count()
    count = max(1, min(MOST_BOUNDS, math.ceil(n / WINDOW_DOCUMENTS)))
    shares = [(i + 1) / count for i in range(count)]
    row = ids.agg(F.percentile_approx("id", shares, 100 * count if count < 1000 else 4 * count).alias("b"), F.max("id").alias("m")).first()
    return sorted({*(row["b"] or []), *([row["m"]] if row["m"] is not None else [])}), n


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, Window]:
    """Rows of ``docs`` (key, text) in windows by descending key, each ending with the next window's first document.

    Columns ``id``, ``t``, ``window`` and ``guest`` (a document lent by the next window; it is in its own as well). The
    last document is followed by the first. Keys are whole numbers. One shuffle of the texts, into a task per ``TASK_DOCUMENTS``; a window holds about
    ``WINDOW_DOCUMENTS`` rows, or a ``MOST_BOUNDS``-th of the table if that is more (760 MB of 100 TB), and one task needs to hold no more than that.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be a whole number")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    bounds, n = _bounds(rows.select("id"))
    kind = rows.schema["id"].dataType.simpleString()
    step = max(1, math.isqrt(len(bounds)))
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    every, some = (listed(bounds), listed(bounds[::step])) if bounds else (F.array().cast(f"array<{kind}>"),) * 2
    # the number of bounds below an id, found in every step-th bound and then in the stretch after it
    coarse = F.greatest(F.size(F.filter(some, lambda x: x < F.col("id"))) - 1, F.lit(0)) * step
    below = coarse + F.size(F.filter(F.slice(every, coarse + 1, F.lit(step)), lambda x: x < F.col("id")))
    rows = rows.withColumn("window", below)
    lends = F.col("id") == F.get(every, F.col("window"))
    to = F.when(F.col("window") + 1 < max(1, len(bounds)), F.col("window") + 1).otherwise(0)
    places = F.when(lends, F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("g")), F.struct(to.alias("w"), F.lit(True).alias("g"))))
    alone = F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("g")))
    rows = rows.select("id", "t", F.explode(F.coalesce(places, alone)).alias("p")).select("id", "t", F.col("p.w").alias("window"), F.col("p.g").alias("guest"))
    # small as the shuffle is, the work is not: tasks by documents, not by bytes
    rows = rows.repartition(max(1, min(len(bounds), math.ceil(n / TASK_DOCUMENTS))), "window")
    return rows, Window.partitionBy("window").orderBy("guest", F.desc_nulls_last("id"), F.xxhash64("t"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is the beginning of the next document.

    ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The next document is the
    one with the next smaller key; the last is followed by the first; equal keys follow each other by their
    text's hash, null keys come last, and a single document follows itself. Null texts are empty. A text without
    characters has an empty fingerprint, which is like another such one only. An empty table stays empty.
    """
    rows, order = with_next(docs, text, key)
    n = F.char_length("t")
    part = F.floor(n / 3).cast("int")
    rows = rows.withColumn("head", F.left(F.lead("t").over(order), part))
    rows = rows.withColumn("edited", F.concat(F.left("t", n - part), F.coalesce(F.col("head"), F.lit(""))))
    rows = rows.withColumn("kmers", kmers(F.col("t")))
    # the edit has the k-mers of what it keeps, and those that touch its new end
    seam = F.greatest(n - part - (K - 1), F.lit(0))
    rows = rows.withColumn("edited_kmers", F.concat(F.slice("kmers", F.lit(1), seam), kmers(F.col("edited"), seam)))
    rows = add_fingerprint(rows, "kmers", "own")
    rows = add_fingerprint(rows, "edited_kmers", "other")
    rows = rows.select("id", "window", "guest", "t", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "other")
    rows = rows.withColumn("following", F.lead("own").over(order)).where(~F.col("guest"))
    return rows.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
