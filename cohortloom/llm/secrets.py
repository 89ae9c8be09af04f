"""Secrets in texts by patterns and by sliding-window entropy, in column expressions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.columns import let

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of at least the wanted length: shorter ones would be dropped anyway, and none of these can begin inside one.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_ASSIGNED = 12

#: Candidates of the entropy scan: per class its characters, the shortest run, the window and the bits that a window needs.
CLASSES = {
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 20, 3.7),
    "hexadecimal": ("0123456789ABCDEF", 24, 24, 3.0),
}
#: Candidates that are no secrets: without a digit or a letter, UUIDs, dates and versions, words joined by signs or numbered.
ALLOWED = (
    r"[A-Za-z+/_-]+", r"[0-9+/_-]+", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_+-]{0,12}", r"(?:[A-Z]?[a-z]{2,}[+/_-])+[A-Za-z]*[0-9]{0,4}", r"[A-Za-z][a-z]+[0-9]{1,4}",
    r"(?:[A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}",
)
REPEATED = r"^(.{1,8})\1{2,}.{0,7}$"
BLOCK = 64


def running_totals(values: Column) -> Column:
    """Sums of the entries before each entry of an array of longs; blocks keep the work near linear in its size."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def totals(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        before = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        within = lambda i: total(F.slice(v, i - i % BLOCK + 1, i % BLOCK))
        return let(before, lambda s: F.transform(v, lambda _, i: F.get(s, F.floor(i / BLOCK).cast("int")) + within(i)))

    return let(values, totals)


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost, non-overlapping matches as structs of start, end (code points) and the text of ``group``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    picked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # the stretch before a match and the match follow each other through the text
    steps = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), picked.alias("part")),
        lambda x: F.struct(
            F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["hit"]).cast("long").alias("hit"), x["part"].alias("part")
        ),
    )
    return F.slice(steps, 1, F.size(whole))


def spans(steps: Column) -> Column:
    """Start, end and part of each match from the lengths of stretches and matches."""
    before = running_totals(F.transform(steps, lambda x: x["gap"] + x["hit"]))
    return F.transform(
        F.arrays_zip(steps.alias("s"), before.alias("b")),
        lambda x: F.struct(
            (x["b"] + x["s"]["gap"]).alias("start"), (x["b"] + x["s"]["gap"] + x["s"]["hit"]).alias("end"), x["s"]["part"].alias("part")
        ),
    )


SPANS = "array<struct<start:bigint,end:bigint,part:string>>"


def entropy(part: Column, characters: str, window: int) -> Column:
    """Largest Shannon entropy in bits of the windows of a string.

    Counts per character and the sum of c * log2(c) are carried from one character to the next: the one that
    enters adds a step of that sum, the one that leaves takes a step away.
    """
    bits = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    place = lambda i: F.instr(F.lit(characters), F.substr(part, i, F.lit(1)))
    counted = lambda counts, at: F.coalesce(F.get(counts, at - 1), F.lit(0))

    def move(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == at - 1, c + by).otherwise(c))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i > window, place(i - window)).otherwise(F.lit(0))
        less = F.when(i > window, F.get(bits, counted(acc["counts"], left)) - F.get(bits, counted(acc["counts"], left) - 1)).otherwise(0.0)
        fewer = F.when(i > window, move(acc["counts"], left, -1)).otherwise(acc["counts"])
        enters = place(i)
        more = F.get(bits, counted(fewer, enters) + 1) - F.get(bits, counted(fewer, enters))
        total = acc["total"] - less + more
        return F.struct(
            move(fewer, enters, 1).alias("counts"), total.alias("total"),
            F.when((i >= window) & (total < acc["least"]), total).otherwise(acc["least"]).alias("least"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(characters)).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least")
    )
    least = F.aggregate(F.sequence(F.lit(1), F.char_length(part)), start, step, lambda acc: acc["least"])
    return F.lit(math.log2(window)) - least / window


def random_looking(candidates: Column, name: str) -> Column:
    """Candidates of a class that no allowed form explains and of which some window has the bits wanted."""
    characters, _, window, bits = CLASSES[name]
    allowed = "^(?:" + "|".join(ALLOWED) + ")$"
    explained = lambda x: x["part"].rlike(allowed) | x["part"].rlike(REPEATED)
    return F.filter(F.filter(candidates, lambda x: ~explained(x)), lambda x: entropy(x["part"], characters, window) >= bits)


def listed(found: Column) -> Column:
    """``kind:start:end`` of structs (start, kind number, end) in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``found`` (array of start, kind number, end in order) and ``base`` (the same of patterns alone).

    Entropy spans that touch a pattern's span are left out. Null and empty texts have no spans. Every text is read
    whole and stays in its row: no shuffle; equal rows get equal results; other columns are ignored.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    patterns = {"assign": (ASSIGN, 1), "access": (ACCESS, 0), "hex": (HEX, 0)}
    for name, (characters, least, _, _) in CLASSES.items():
        inside = "[" + "".join("\\" + c if c in "-/+" else c for c in characters) + "]"
        patterns[name] = (f"(?<!{inside}){inside}{{{least},}}", 0)
    none = F.array().cast("array<struct<gap:bigint,hit:bigint,part:string>>")
    rows = rows.select("*", *[
        F.when(F.col("__t").rlike(p), matches(F.col("__t"), p, group)).otherwise(none).alias(f"__{kind}") for kind, (p, group) in patterns.items()
    ]).drop("__t")
    empty = F.array().cast(SPANS)
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], *[
        F.when(F.size(f"__{kind}") > 0, spans(F.col(f"__{kind}"))).otherwise(empty).alias(f"__{kind}") for kind in patterns
    ])
    rows = rows.withColumn("__assign", F.filter("__assign", lambda x: F.char_length(x["part"]) >= LEAST_ASSIGNED))

    def numbered(kind: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    rows = rows.withColumn("base", F.concat(*[numbered(k, F.col(f"__{k}")) for k in BASE_KINDS]))
    for name in CLASSES:
        apart = lambda base, x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        rows = rows.withColumn(f"__{name}", let(F.col("base"), lambda base: F.filter(f"__{name}", lambda x: apart(base, x))))
        rows = rows.withColumn(f"__{name}", F.when(F.size(f"__{name}") > 0, random_looking(F.col(f"__{name}"), name)).otherwise(empty))
    added = F.array_distinct(F.concat(*[numbered("entropy", F.col(f"__{name}")) for name in CLASSES]))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("found"))


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, number of spans of each pattern, digest of these spans and the list of all; see ``scan``."""
    rows = scan(docs, text, keep)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def mask(docs: DataFrame, text: str = "text", label: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``label``; spans that overlap are replaced together.

    Null texts stay null; rows and columns, whatever their names, stay as they are otherwise.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scanned = scan(docs.select(whole.alias("__doc"), F.col(f"`{text}`").alias("__text")), "__text", ("__doc",))
    # spans in order: one that begins inside the last joins it
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["end"]),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    merged = F.aggregate("found", F.array().cast("array<struct<start:bigint,end:bigint>>"), step)
    rows = scanned.select("__doc", F.when(F.size("found") > 0, merged).alias("__m"))
    t = F.col("__doc")[text]

    def pieces(m: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)
        return F.transform(m, lambda x, i: F.concat(F.substr(t, (end(i) + 1).cast("int"), (x["start"] - end(i)).cast("int")), F.lit(label)))

    rest = F.substr(t, (F.element_at("__m", -1)["end"] + 1).cast("int"), F.char_length(t))
    masked = F.when(F.col("__m").isNotNull(), F.concat(F.array_join(let(F.col("__m"), pieces), ""), rest)).otherwise(t)
    return rows.select(*[masked.alias(c) if c == text else F.col("__doc")[c].alias(c) for c in docs.columns])
