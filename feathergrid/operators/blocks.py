"""Sums of whole arrays: every task adds up its rows in numpy and hands on one array per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes in a batch; called with None it returns the task's ``{key: array}``.
Adder = Callable[[pa.RecordBatch | None], dict[int, np.ndarray] | None]


def array_sums(df: DataFrame, make: Callable[[], Adder]) -> dict[int, np.ndarray]:
    """The arrays of all tasks added up by key.

    ``make()`` starts a task.  Keys and widths must not grow with the rows: the
    driver gets one array per key.  The arrays of a key, one per task, meet in one
    group; many keys spread over many tasks.  They are really added: whole numbers
    stay whole, which a mean times its weight (``Summarizer.sum``) does not promise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = make()
        for batch in batches:
            if batch.num_rows:
                add(batch)
        for key, sums in (add(None) or {}).items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], names=["key", "sums"]
            )

    parts = df.mapInArrow(run, "key int, sums array<double>").groupBy("key").agg(F.collect_list("sums").alias("parts"))
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    total = parts.select("key", F.aggregate(rest, F.element_at("parts", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("sums"))
    return {r["key"]: np.array(r["sums"], dtype=np.float64) for r in total.collect()}


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls, all lists of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
