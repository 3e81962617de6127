"""Rows of vectors as bytes, checked once for all operators on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of the vectors, of equally frequent ones the largest; 0 without vectors. A row per length reaches the driver."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return found["d"] if found else 0


def matrices(batch: pa.RecordBatch, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch whose vector has d entries, all of them finite numbers, and these vectors as doubles."""
    lists = batch.column(column)
    at = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == d)
    flat = lists.take(pa.array(at)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(at), d)
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


def as_bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def from_bytes(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def summed(parts: DataFrame) -> np.ndarray:
    """Adds up rows (k, value), k from 0, counted in each task first: a row for each k reaches the driver."""
    rows = parts.groupBy("k").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(rows.num_rows, rows.column("value").to_numpy().dtype)
    out[rows.column("k").to_numpy()] = rows.column("value").to_numpy()
    return out


def sums(df: DataFrame, values, kind: str) -> np.ndarray:
    """values(batch), arrays of equal length, added up over all batches of df: each task sends one row for each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = values(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "value"])

    return summed(df.mapInArrow(add, f"k long, value {kind}"))
