"""Corpus-wide lookups of window hashes in packed form.

Documents are dealt into batches by ranges of doc_id (a batch is one Spark partition), and hashes into as many buckets. A batch sends each
bucket one row with its distinct hashes as bytes, the bucket answers each batch with one byte string, and the batch recomputes its hashes in the
same order to read the answer. So a hash costs its few bytes once per batch, however often a hot passage repeats in it, and no task holds more
than a batch or a bucket. Batches grow with the square root of the corpus, so a packet stands for PACKET bytes of text or more and the number of
packets is in proportion to the corpus: 4 MB batches up to 27 GB, 25 MB at 1 TB, 250 MB at 100 TB.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import shuffle_partitions

_NO_ID = -(1 << 63)
PACKET = 640


def row_id(col: str = "doc_id") -> Column:
    """The id as a long; null is before all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_NO_ID))


def batches(docs: DataFrame, least_bytes: int = 4 << 20) -> tuple[int, np.ndarray]:
    """Number of batches and the first doc_id of each but the first. A small corpus is dealt over the shuffle partitions, in batches of 128 kB or more."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    size = max(least_bytes, int((PACKET * total) ** 0.5))
    n = max(1, -(-total // size), min(shuffle_partitions(docs.sparkSession), total >> 17))
    if n == 1:
        return 1, np.zeros(0, np.int64)
    at = [k / n for k in range(1, n)]
    ids = docs.select(row_id().alias("d")).agg(F.percentile_approx("d", at, 100 * n)).first()[0]
    return n, np.array(ids, np.int64)


def batch_of(splits: np.ndarray, col: Column, mark: Column | None = None) -> Column:
    """The batch of an id. With a mark (a 64-bit hash), the rows of an id that fills several batches are dealt over them by ranges of it: batches then
    follow the order of (id, mark)."""

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, ids.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("int")
    def find_both(ids: pd.Series, marks: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(splits, ids.to_numpy(), side=s) for s in ("left", "right"))
        share = ((marks.to_numpy() >> 11) + (1 << 52)) / float(1 << 53)
        return pd.Series((low + (share * (high - low + 1)).astype(np.int64)).astype(np.int32))

    if not len(splits):
        return F.lit(0)
    return find(col) if mark is None else find_both(col, mark)


def freed(body):
    """body (rows -> batches) that gives its memory back to the system when a partition ends: idle workers of earlier stages stay alive beside the working ones."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from body(rows)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


def table_of(rows: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(rows)
    return pa.Table.from_batches(got) if got else None


def split_by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets in a sorted array of bucket numbers: the buckets that occur, and n + 1 offsets."""
    bounds = np.searchsorted(bucket, np.arange(n + 1))
    return np.flatnonzero(np.diff(bounds)), bounds

