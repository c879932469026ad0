"""Arrow maps: rows of a task in slices of bounded size, columns in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handed to Python at once are cut so that they stay below this.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to about SLICE_BYTES, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * SLICE_BYTES / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column whose rows are equally long."""
    if not len(column):
        return np.empty((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def arrow_map(df: DataFrame, rows_of: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """mapInArrow: rows_of gets a slice and returns equally long columns by name."""
    spark_schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows_of(batch)
            columns = [out[f.name] for f in arrow_schema]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)],
                schema=arrow_schema,
            )

    return df.mapInArrow(run, spark_schema)
