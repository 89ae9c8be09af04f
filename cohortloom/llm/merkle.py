"""Merkle manifest of a table: leaf hashes, roots and a proof for every row, by nested rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.staging import broadcast_if_bytes, scratch, stage

#: Nodes of a run, and rank digits that one block groups away: a block holds at most 8 ** 4 nodes.
FAN, DIGITS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its number of UTF-8 bytes, a colon and its text; ``-`` for null."""

    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[shown(v) for v in values])


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0 by ``order``, nulls first) and ``n``, the number of rows of their group.

    The rows are dealt by ranges of group and order, so a large group lies in many ranges. A row's rank is its place within
    its range, and the rows of the group in earlier ranges. ``rows`` is read twice and should be staged.
    """
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the lower 33 bits of the id count the rows of a task
    placed = placed.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__at"))
    placed = stage(placed, "ranges")
    same = [F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`")) for g in group]
    counts = placed.groupBy(*group, "__range").agg(F.count("*").alias("__own"), F.min("__at").alias("__first"))
    # a group has one row per range here
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    counts = counts.select(
        *group, "__range", (F.coalesce(F.sum("__own").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__own").over(whole).alias("n")
    )
    counts = broadcast_if_bytes(stage(counts, "counts"))
    both = placed.alias("l").join(counts.alias("r"), reduce(lambda x, y: x & y, same, F.col("l.__range") == F.col("r.__range")))
    return both.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("__at") + F.col("__shift")).alias("rank"), F.col("r.n").alias("n"))


def nest(nodes: DataFrame, group: Sequence[str], payload: str) -> DataFrame:
    """Blocks of a level: group, ``n`` (blocks of the group), ``rank``, ``hash`` and ``node`` (the nested children).

    ``nodes``: group, n, rank, hash and a struct ``payload``. The last digits of the rank become columns; one digit after the other is
    grouped away, its nodes being put into an array and hashed, as long as the group has more than one node at that level.
    All groupings keep the division by group and block, so rows move once.
    """
    digits = [f"__d{i}" for i in range(DIGITS)]
    rows = nodes.select(
        *group, "n", F.shiftright("rank", 3 * DIGITS).alias("__block"),
        *[F.shiftright("rank", 3 * i).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", payload).alias("node"),
    )
    rows = rows.repartition(*group, "__block")
    for i, digit in enumerate(digits):
        left = digits[i + 1:]
        rows = rows.groupBy(*group, "n", "__block", *left).agg(F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "node"))).alias("children"))
        hashes = F.transform("children", lambda c: c["node"]["hash"])
        several = F.col("n") > FAN**i
        hashed = F.when(several, F.sha2(F.array_join(hashes, ""), 256)).otherwise(F.element_at(hashes, 1))
        children = F.transform("children", lambda c: c["node"])
        rows = rows.select(*group, "n", "__block", *left, F.struct(hashed.alias("hash"), children.alias("children")).alias("node"))
    size = FAN**DIGITS
    return rows.select(
        *group, F.floor((F.col("n") + (size - 1)) / size).cast("long").alias("n"), F.col("__block").alias("rank"), F.col("node.hash").alias("hash"),
        F.col("n").alias("inner_n"), F.col("node").alias("node"),
    )


def unfold(blocks: DataFrame, group: Sequence[str], carried: Sequence[str], payload: str) -> DataFrame:
    """The nodes of the blocks again: group, rank, hash, payload, the carried columns, and ``steps`` with those of the block put before.

    A step holds the siblings of a node, joined, to its left and right; levels at which a group has one node have no step.
    """
    rows = blocks.select(*group, *carried, "steps", "inner_n", F.col("rank").alias("__rank"), "node")
    for i in reversed(range(DIGITS)):
        children = F.col("node.children")

        def placed(child: Column, at: Column) -> Column:
            hashes = F.transform(children, lambda c: c["hash"])
            step = F.struct(
                F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"), F.array_join(F.slice(hashes, at + 2, F.lit(FAN)), "").alias("right")
            )
            return F.struct(child.alias("node"), step.alias("step"), at.alias("at"))

        rows = rows.select("*", F.explode(F.transform(children, placed)).alias("__c"))
        steps = F.when(F.col("inner_n") > FAN**i, F.concat(F.array("__c.step"), F.col("steps"))).otherwise(F.col("steps"))
        rows = rows.select(
            *group, *carried, steps.alias("steps"), "inner_n", (F.col("__rank") * FAN + F.col("__c.at")).alias("__rank"), F.col("__c.node").alias("node")
        )
    return rows.select(*group, *carried, "steps", F.col("__rank").alias("rank"), F.col("node.hash").alias("hash"), F.col(f"node.{payload}").alias(payload))


def meet(blocks: DataFrame, paths: DataFrame, group: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Blocks with what was found for their hash above them: one grouping of both, without a join."""
    void = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    below = blocks.select(*group, "rank", "inner_n", "node", *[void(paths, c) for c in (*carried, "steps")])
    above = paths.select(*group, "rank", void(blocks, "inner_n"), void(blocks, "node"), *carried, "steps")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("inner_n", "node", *carried, "steps")]
    return below.unionByName(above).groupBy(*group, "rank").agg(*first)


def tree(nodes: DataFrame, group: Sequence[str], payload: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks from the bottom, and the tops: group and ``hash``, one row per group."""
    levels, state = [], nodes
    while True:
        blocks = stage(nest(state, group, payload), "blocks")
        levels.append(blocks)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= 1:
            return levels, blocks.select(*group, "hash")
        # the next level carries no payload but the place of a block
        state = blocks.select(*group, "n", "rank", "hash", F.struct(F.col("rank").alias("at")).alias(payload))


def descend(levels: list[DataFrame], tops: DataFrame, group: Sequence[str], carried: Sequence[str], payload: str) -> DataFrame:
    """Nodes below ``tops`` (group, carried, steps), with the steps from each of them up."""
    paths = tops.select(*group, F.lit(0).cast("long").alias("rank"), *carried, "steps")
    for blocks in reversed(levels):
        nodes = unfold(meet(blocks, paths, group, carried), group, carried, payload)
        paths = nodes.select(*group, "rank", *carried, "steps")
    return nodes


def proofs(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """All columns of ``leaves`` (group, hash and any others but ``rank``, ``n``, ``steps``, ``root``, ``subroot``) with the group's ``subroot``, the ``root`` and ``steps``.

    The leaves of a group stand in the given order (nulls first) and are joined in runs of ``FAN`` up to its subroot; subroots
    stand in the order of their group and are joined likewise. ``steps`` go from the leaf to the root; folding them gives the root.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    extra = [c for c in leaves.columns if c not in (group, "hash")]
    with scratch() as kept:
        places = ranked(stage(leaves, "leaves"), [group], order)
        levels, tops = tree(places.select(group, "n", "rank", "hash", F.struct(*[F.col(f"`{c}`") for c in extra]).alias("payload")), [group], "payload")
        # one row per group; the constant makes them one group
        heads = stage(tops.select(F.lit(1).alias("all"), F.col(group).alias("head"), "hash"), "heads")
        upper, root = tree(
            ranked(heads, ["all"], ["head"]).select("all", "n", "rank", "hash", F.struct("head").alias("payload")), ["all"], "payload"
        )
        subroots = descend(upper, root.select("all", F.col("hash").alias("root"), none.alias("steps")), ["all"], ["root"], "payload")
        subroots = subroots.select(F.col("payload.head").alias(group), F.col("hash").alias("subroot"), "root", "steps")
        kept += levels + [stage(subroots, "subroots")]
    nodes = descend(levels, kept[-1], [group], ["subroot", "root"], "payload")
    return nodes.select(F.col(group), "hash", *[F.col(f"payload.`{c}`").alias(c) for c in extra], "subroot", "root", "steps")


def proof_hash(steps: Column) -> Column:
    """Hash of the siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Where 3 divides the crc32 of the decimal key, the root is folded from a leaf whose text has its A-Z in lower case; such a row
    is verified only if that changes nothing. Null fields hash as ``-``. A null group stands first; so does a null key, whose row is
    never tampered with. Rows of one key stand in the order of their leaves, so repeated rows have leaves of their own. A single
    row has no siblings: its leaf is the root and its proof hashes the empty text. Other columns are ignored; an empty
    table stays empty. Texts are read once and do not move; a block holds at most 4096 rows' hashes.
    """
    column = lambda c: F.col(f"`{c}`")
    changed = [F.translate(column(f), UPPER, LOWER) if f == text else column(f) for f in fields]
    hit = F.coalesce(F.crc32(column(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        column(group).alias("grp"), leaf_hash([column(f) for f in fields]).alias("hash"), column(key).alias("key"),
        F.when(hit, leaf_hash(changed)).alias("tampered"),
    )
    found = proofs(leaves, "grp", ["key", "hash"])
    fold = folded(F.coalesce("tampered", "hash"), F.col("steps"))
    return found.select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), fold.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
