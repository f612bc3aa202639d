"""Integer vectors: which rows take part, and exact sums of squares and products over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Integer components are below this in magnitude, so that 100 times a sum of 1024 products fits in 64 bits.
LIMIT = 1 << 22


def integer_rows(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """(vec_id, *columns, x): each component of embedding as floor(scale * component), component as double.

    Vectors that are null or hold a null or non-finite component take no part, nor do those with an integer
    of LIMIT or more, nor those of another length than most rows have (the longer of two that are as
    frequent). The table is written once.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    rows = vectors.where("embedding is not null").where(~F.exists("embedding", bad))
    rows = rows.select("vec_id", *columns, F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    rows = rows.where(~F.exists("x", lambda c: F.abs(c) >= LIMIT)).withColumn("x", F.col("x").cast("array<int>"))
    rows = save(rows, "vectors")
    common = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (common["length"] if common else 0))


def stacked(column) -> np.ndarray:
    """A pandas column of arrays as a matrix of 64-bit integers."""
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where all sums fit in their 53 bits, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 52 else a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b, exactly."""
    return (a * a).sum(axis=1)[:, None] - 2 * products(a, b) + (b * b).sum(axis=1)[None, :]
