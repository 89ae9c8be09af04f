"""Reading cohort files and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortloom.constants import (
    ID_COLUMN,
    MISSING_TOKENS,
    RAW_FILES,
    RAW_FOLDER,
    ROW_NUMBER_COLUMN,
    WAVE_COLUMNS,
)
from cohortloom.functions import number_of, parse_measure
from cohortloom.operators.moments import sum_vectors
from cohortloom.staging import stage


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def join_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _unparsed(raw: DataFrame, columns: Sequence[str], tokens: Sequence[str]) -> list[float]:
    """Number of present values per column that are no number."""
    if not columns or raw.isEmpty():
        return [0.0] * len(columns)

    def odd(text: Column) -> Column:
        return F.when(~F.trim(text).isin(*tokens) & number_of(text).isNull(), F.lit(1.0)).otherwise(F.lit(0.0))

    found = raw.select(F.transform(F.array(*[F.col(f"`{c}`") for c in columns]), odd).alias("vec"))
    return sum_vectors(found, []).first()["vec"]


def parse_text_table(
    raw: DataFrame,
    id_column: str = ID_COLUMN,
    id_type: str = "bigint",
    text_columns: Iterable[str] | None = None,
    tokens: Iterable[str] = MISSING_TOKENS,
) -> DataFrame:
    """Turn an all-text table into measures, missing tokens becoming NULL.

    ``text_columns`` names the columns that stay text. When it is not given, one pass over
    the table finds them: a column stays text if any of its present values is no number. Its plan is the same for any number
    of columns, and a task holds one number per column.
    """
    tokens = tuple(tokens)
    measures = [c for c in raw.columns if c != id_column]
    if text_columns is None:
        text_columns = [c for c, n in zip(measures, _unparsed(raw, measures, tokens), strict=True) if n > 0]
    text_columns = set(text_columns)
    parsed = []
    for c in raw.columns:
        if c == id_column:
            parsed.append(F.col(f"`{c}`").cast(id_type).alias(c))
        elif c in text_columns:
            parsed.append(F.when(~F.trim(F.col(f"`{c}`")).isin(*tokens), F.col(f"`{c}`")).alias(c))
        else:
            parsed.append(parse_measure(F.col(f"`{c}`"), tokens).alias(c))
    return raw.select(*parsed)


def read_cohort(
    spark: SparkSession,
    path: str,
    id_column: str = ID_COLUMN,
    schema: StructType | str | None = None,
    drop: Sequence[str] = (),
    tokens: Iterable[str] = MISSING_TOKENS,
    **parse_options,
) -> DataFrame:
    """One CSV file or folder of CSV files. With a schema nothing is inferred.

    Without one, the text is parsed once into a staged table, from which types are found and columns are read; it lives
    as long as the shared folder.
    The schema's columns are found by their names in the header, in any order; missing tokens become NULL
    in text and numbers alike.
    """
    raw = spark.read.option("header", True).csv(path)
    if schema is None:
        return parse_text_table(stage(raw.drop(*drop), "text"), id_column, tokens=tokens, **parse_options)
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    absent = [f.name for f in fields if f.name not in raw.columns]
    if absent:
        raise KeyError(f"columns {absent} not found in {path}")
    tokens = tuple(tokens)

    def typed(f):
        kind, text = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            return parse_measure(text, tokens).cast(f.dataType).alias(f.name)
        value = F.when(~F.trim(text).isin(*tokens), text if kind == "string" else F.trim(text))
        return value.try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in fields if f.name not in drop])


def load_cohort(
    spark: SparkSession,
    folder: str | None = None,
    file_names: Sequence[str] | None = None,
    **read_options,
) -> dict[str, DataFrame]:
    """Tables ``data_1``, ``data_2``, ... in file order; no file is read unless all exist."""
    folder = RAW_FOLDER if folder is None else folder
    file_names = RAW_FILES if file_names is None else file_names
    paths = [join_path(folder, name) for name in file_names]
    for path in paths:
        if not _exists(spark, path):
            raise FileNotFoundError(f"cohort file {path} not found")
    tables = {}
    for position, path in enumerate(paths, start=1):
        header = spark.read.option("header", True).csv(path).columns
        if ROW_NUMBER_COLUMN not in header:
            raise KeyError(f"column {ROW_NUMBER_COLUMN} not found in {path}")
        tables[f"data_{position}"] = read_cohort(spark, path, drop=[ROW_NUMBER_COLUMN], **read_options)
    return tables


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", file_format: str = "parquet") -> None:
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def write_datasets(
    df: DataFrame,
    path: str,
    id_column: str = ID_COLUMN,
    dataset_column: str = "dataset",
    mode: str = "errorifexists",
    file_format: str = "parquet",
) -> None:
    """One folder per completed dataset, id and wave first.

    The rows arrive already spread over tasks; every task writes into each dataset it holds,
    so no dataset passes through a single task.
    """
    first = [id_column, *[c for c in WAVE_COLUMNS if c in df.columns]]
    rest = [c for c in df.columns if c not in first and c != dataset_column]
    writer = df.select(dataset_column, *first, *rest).write.mode(mode).partitionBy(dataset_column)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def write_results(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Result tables of a model or a network, each as Parquet below ``folder``."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(join_path(folder, name))


def read_results(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(join_path(folder, name)) for name in names}
