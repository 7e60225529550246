"""Sums of long vectors that tasks make, in two levels of bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 12
FIRST = 64
SCHEMA = "slice int, task long, blob binary"


def emit(vector: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """A task's vector in slices; slices of zeros stay behind."""
    rows = [(i, vector[a : a + SLICE].tobytes()) for i, a in enumerate(range(0, len(vector), SLICE)) if vector[a : a + SLICE].any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([task] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "task", "blob"])


def total(parts: DataFrame, size: int, dtype=np.float64) -> np.ndarray:
    """The sum of all tasks' vectors; `size` is a constant of the caller, whatever the data."""

    def add(table: pa.Table) -> pa.Table:
        out = np.sum([np.frombuffer(x.as_buffer(), dtype) for x in table["blob"]], axis=0, dtype=dtype)
        return pa.table({"slice": table["slice"][:1], "task": pa.array([0], pa.int64()), "blob": pa.array([out.tobytes()], pa.binary())})

    some = parts.withColumn("_g", F.pmod(F.xxhash64("task"), F.lit(FIRST))).groupBy("slice", "_g").applyInArrow(add, SCHEMA)
    out = np.zeros(size, dtype)
    for row in some.groupBy("slice").applyInArrow(add, SCHEMA).collect():
        piece = np.frombuffer(row["blob"], dtype)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(piece)] = piece
    return out
