"""Feature arrays, and partial sums of them computed batch by batch inside each partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.schemas import quoted


def features_array(cols: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(f"cast({quoted(c)} as double)" for c in cols) + ")")


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one width as a matrix; missing entries become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1)


def partial_sums(
    df: DataFrame, fold: Callable[[np.ndarray, pa.RecordBatch], dict], schema: str, vector: str = "_x"
) -> DataFrame:
    """One table of partial sums per partition.

    ``fold`` maps the matrix and the batch to arrays keyed by name, which add up over batches.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = fold(matrix_of(batch.column(batch.schema.get_field_index(vector))), batch)
            total = part if total is None else {n: total[n] + part[n] for n in total}
        if total is not None:
            size = next(iter(total.values())).size
            index = pa.array(np.arange(size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [index, *[pa.array(total[n].ravel()) for n in names[1:]]], names=names
            )

    return df.mapInArrow(run, schema)
