"""Row and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.constants import BLOCK_PATTERNS, EXPOSURE_CATEGORIES
from cohortloom.functions import order_key
from cohortloom.staging import broadcast_if_small


def drop_incomplete(
    df: DataFrame,
    columns: str | Sequence[str] = "CFDRIGHT",
    observation: Observation | None = None,
) -> DataFrame:
    """Rows that have a value in every listed column.

    Pass an ``Observation`` to learn ``n_removed`` from whichever job runs the table, without
    a counting job of its own.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"column {c!r} not found")
    if observation is not None:
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        df = df.observe(observation, F.count_if(missing).alias("n_removed"))
    return df.dropna(how="any", subset=columns)


def drop_incomplete_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``drop_incomplete`` over the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def keep_first(df: DataFrame, columns: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Project to ``keep`` then ``columns``; unknown names and repeats are left out."""
    wanted = dict.fromkeys(c for c in [*(keep or []), *columns] if c in df.columns)
    return df.select(*wanted)


def dictionary_variables(dictionary: DataFrame, categories: Iterable[str] = EXPOSURE_CATEGORIES) -> DataFrame:
    """Distinct variables of the dictionary that belong to one of the categories."""
    for c in ("var", "category"):
        if c not in dictionary.columns:
            raise KeyError(f"the dictionary needs a column {c!r}")
    return dictionary.where(F.col("category").isin(*categories)).select("var").distinct()


def select_by_dictionary(
    tables: Mapping[str, DataFrame],
    keep: Sequence[str] | None = None,
    categories: Iterable[str] = EXPOSURE_CATEGORIES,
) -> DataFrame:
    """Columns of ``tables["main"]`` whose category in ``tables["description"]`` is listed."""
    if "main" not in tables or "description" not in tables:
        raise KeyError("tables 'main' and 'description' are needed")
    main = tables["main"]
    # Only names that are columns of the main table come back: a bounded list.
    named = dictionary_variables(tables["description"], categories).where(F.col("var").isin(*main.columns))
    chosen = {row["var"] for row in named.collect()}
    return keep_first(main, [c for c in main.columns if c in chosen], keep)


def select_long_by_dictionary(
    measures: DataFrame,
    dictionary: DataFrame,
    categories: Iterable[str] = EXPOSURE_CATEGORIES,
    variable: str = "variable",
) -> DataFrame:
    """Long measure table restricted to variables of the categories."""
    chosen = broadcast_if_small(dictionary_variables(dictionary, categories).withColumnRenamed("var", variable))
    return measures.join(chosen, variable, "left_semi")


def pattern_blocks(
    columns: Iterable[str], patterns: Mapping[str, Sequence[str]] = BLOCK_PATTERNS
) -> dict[str, list[str]]:
    """Blocks of column names: a block takes each name that contains any of its patterns."""
    columns = list(columns)
    blocks = {block: [c for c in columns if any(p in c for p in texts)] for block, texts in patterns.items()}
    return {block: names for block, names in blocks.items() if names}


def assign_blocks(
    measures: DataFrame,
    patterns: Mapping[str, Sequence[str]] = BLOCK_PATTERNS,
    variable: str = "variable",
) -> DataFrame:
    """Long measure table with a ``block`` column, a row for each block its variable is in.

    The patterns become one expression, so that the step is narrow: no join, no shuffle.
    """
    tags = []
    for block, texts in patterns.items():
        hit = F.lit(False)
        for text in texts:
            hit = hit | F.contains(F.col(variable), F.lit(text))
        tags.append(F.when(hit, F.lit(block)))
    return measures.withColumn("block", F.explode(F.array_compact(F.array(*tags))))


def exposures(columns: Iterable[str], *roles: Iterable[str]) -> list[str]:
    """Names in input order that play none of the given roles."""
    taken = {name for role in roles for name in role}
    return [c for c in columns if c not in taken]


def drop_long_roles(measures: DataFrame, roles: DataFrame, variable: str = "variable") -> DataFrame:
    """Long measure table without the variables listed in ``roles``."""
    return measures.join(broadcast_if_small(roles.select(variable).distinct()), variable, "left_anti")


def sample_variables(variables: DataFrame, n: int | None, seed: int = 42, variable: str = "variable") -> DataFrame:
    """Seeded choice of ``n`` distinct variables; all of them when ``n`` is none."""
    distinct = variables.select(variable).distinct()
    if n is None:
        return distinct
    return distinct.orderBy(order_key(seed, F.col(variable)), variable).limit(n)


def sample_names(names: Sequence[str], n: int | None, seed: int = 42) -> list[str]:
    """The same choice over column names."""
    import hashlib

    if n is None or n >= len(names):
        return list(names)
    ranked = sorted(names, key=lambda name: (hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), name))
    return ranked[:n]
