"""Shared folder for tables that a job needs more than once.

A staged table is written once and read back, so that it survives lost executors and
cuts the lineage of iterative jobs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = root
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/cohortloom/{app}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles inside is deleted with its end, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Nothing reads the shuffles of the write again, so they go with it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    if _scopes:
        _scopes[-1].append(staged)
    return staged


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables staged inside are deleted at the end, but for those that are put into the list that it gives.

    Results that leave the scope must be staged, since what they are made of goes.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        made = _scopes.pop()
        paths = {t._staged_path for t in kept}
        discard(*[t for t in made if t._staged_path not in paths])
        if _scopes:
            _scopes[-1].extend(t for t in made if t._staged_path in paths)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, such as the last step's state.

    Only the very tables that ``stage`` returned are deleted; others are left alone.
    """
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path is not None:
            spark = table.sparkSession
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for ``df`` only when a count proves it to be small.

    Beyond the bound the table is returned as it is and the join shuffles. Call this on
    staged tables or on small aggregates: the count runs ``df`` up to ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def broadcast_if_bytes(df: DataFrame, max_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """Broadcast hint for ``df`` only when the size of its values, as measured, is within ``max_bytes``.

    Texts and arrays count with what they hold (as JSON for nested values), numbers and the row itself with 8 bytes. Call
    this on staged tables or on small aggregates: measuring runs ``df``.
    """
    def size(field) -> Column:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 8
        if kind in ("array", "struct", "map", "variant"):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
        return F.lit(8)

    total = df.select(F.sum(sum((size(f) for f in df.schema.fields), F.lit(8)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df
