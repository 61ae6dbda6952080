"""Shared by the vector operators: usable vectors, their lengths, and runs of equal values in sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def marked(vectors: DataFrame) -> DataFrame:
    """All rows as (id, v, n, label if there is one): v is null where the vector or the id is null, the vector is zero, or a component is null or
    not finite; n is the length. Components stay float where the input's are, and are double otherwise."""
    kind = vectors.schema["embedding"].dataType
    small = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    cols = [F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if small else "array<double>").alias("v")]
    if "label" in vectors.columns:
        cols.append(F.col("label").cast("long").alias("label"))
    inf = float("inf")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = vectors.select(*cols).withColumn("v", F.when(good, F.col("v")))
    return rows.withColumn("n", F.size("v"))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows of marked() that have a vector."""
    return marked(vectors).filter("v is not null")


def lengths(rows: DataFrame) -> list[int]:
    """The lengths that occur: vectors are only compared with those of their own length."""
    return sorted(r["n"] for r in rows.select("n").distinct().collect())


def key(*more: str):
    """96 bits that stand for a vector (and more columns): equal vectors are compared once."""
    return F.struct(F.xxhash64("v", *more).alias("x"), F.hash("v", *more).alias("y"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix of its own component type."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0), flat.dtype)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times a power of two each, so that no square overflows or vanishes; cosines stay as they are."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def lists(m: np.ndarray) -> pa.ListArray:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def runs(batches, col: str = "unit"):
    """(value, part of a batch) for each run of equal values of `col` in sorted Arrow batches; a run that spans batches comes in several parts."""
    for b in batches:
        if b.num_rows:
            v = b.column(col).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield v[a], b.slice(a, z - a)


def groups(batches, col: str = "unit"):
    """(value, table) for each run of equal values of `col` in sorted Arrow batches, whole; for runs of bounded size only."""
    own, held = None, []
    for value, part in runs(batches, col):
        if held and value != own:
            yield own, pa.Table.from_batches(held)
            held = []
        own = value
        held.append(part)
    if held:
        yield own, pa.Table.from_batches(held)
