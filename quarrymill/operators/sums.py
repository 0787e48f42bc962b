"""Sums of matrices that every task fills for its own rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_sums(data: DataFrame, rows: int, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """A rows x size matrix to which ``add(matrix, batch)`` added every batch: one matrix a task, added up by cell
    in the shuffle. The matrix reaches the driver, so its shape must not depend on the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, size))
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        for r in np.flatnonzero(total.any(axis=1)):
            cells = np.flatnonzero(total[r])
            columns = [pa.array(np.full(len(cells), r), pa.int32()), pa.array(cells, pa.int64()), pa.array(total[r, cells], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "cell", "value"])

    out = np.zeros((rows, size))
    got = data.mapInArrow(run, "row int, cell long, value double").groupBy("row", "cell").agg(F.sum("value").alias("value")).toPandas()
    out[got["row"].to_numpy(), got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column of equal lengths as a matrix; nulls in lists become NaN."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)
