"""Arrow batches in, Arrow batches out, and bounded caches that live as long as a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Code points that Python handles at a time; a batch of rows is cut so that long texts do not add up.
BATCH_CHARS = 4_000_000


class BoundedCache(dict):
    """Results by key, at most ``limit`` of them: it changes how long a job takes, never what it returns.

    When half the limit is reached the entries become the older half; a key found there comes forward again.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.half, self.older = compute, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``most`` bytes together; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], out: StructType, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and what a function of a list of texts returns for them.

    ``make`` runs once per task and returns that function; its result maps the names of the new columns to
    lists. Null texts reach it as empty strings.
    """
    schema = StructType([df.schema[name] for name in keep] + out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                new = work([x or "" for x in part.column(text).to_pylist()])
                columns = [part.column(name).cast(wanted.field(name).type) for name in keep]
                columns += [pa.array(new[f.name], type=wanted.field(f.name).type) for f in out.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    chosen = [F.col(f"`{name}`") for name in dict.fromkeys([*keep, text])]
    return df.select(*chosen).mapInArrow(run, schema)
