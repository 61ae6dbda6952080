"""Shared pieces: written intermediate tables, distributed components, byte and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in a local session only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="advertlake-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, and a lost executor loses none of it. The shuffle files of the write are
    dropped as soon as it has ended; the table goes with the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/advertlake-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the smallest node reachable.

    Alternates "large star" and "small star": each node hooks its neighbours to the smallest
    neighbour, which leaves a star per component after about log(n) rounds. A round groups by node
    with a min (partial sums before the shuffle) and never gathers a neighbour list; the minima go back to the edges
    of a hot node as in spread_join. Ends when a round changes nothing; raises if max_rounds is given and does not suffice.
    """
    e = written(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before, edges_now = None, e.count()
    for done in count():
        if done == max_rounds:
            raise RuntimeError(f"connected_components: still changing after {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_minima(both, low, edges_now).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            _with_minima(large, low2, edges_now)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*")
        )
        small = small.toDF("a", "b").filter("a <> b").distinct()
        e = written(small)
        now = tuple(
            e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if now == before or not now[0]:
            break
        before, edges_now = now, now[0]
    stars = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


#: A key with more rows than this is joined by itself.
HEAVY = 100_000


def _with_minima(edges: DataFrame, low: DataFrame, n: int, heavy: int = HEAVY, small: int = 200_000) -> DataFrame:
    """edges (a, b) join low (a, m, n: how many edges a has), of at most n rows."""
    if n <= small:
        return edges.join(F.broadcast(low.drop("n")), "a")
    low = written(low)
    return _joined_apart(edges, low.drop("n"), "a", low.filter(F.col("n") > heavy).select("a"))


def spread_join(rows: DataFrame, known: DataFrame, on: str, heavy: int = HEAVY, small: int = 200_000) -> DataFrame:
    """rows left join known (one row for each value of `on`), where one value may hold a third of all rows. known is written and counted: up to `small`
    rows are broadcast; of more, those of the values that more than `heavy` rows have (at most one in `heavy` rows) are broadcast, and the others are joined by
    a shuffle, so no task gets more than a bounded number of rows of one value."""
    known = written(known)
    if known.count() <= small:
        return rows.join(F.broadcast(known), on, "left")
    hot = written(rows.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select(on))
    return _joined_apart(rows, known, on, hot)


def _joined_apart(rows: DataFrame, known: DataFrame, on: str, hot: DataFrame) -> DataFrame:
    if hot.isEmpty():
        return rows.join(known, on, "left")
    hot = F.broadcast(hot.withColumnRenamed(on, "_hot"))
    own = known.join(hot, known[on].eqNullSafe(hot["_hot"]), "left_semi")
    light = rows.join(hot, rows[on].eqNullSafe(hot["_hot"]), "left_anti").join(known, on, "left")
    return light.unionByName(rows.join(hot, rows[on].eqNullSafe(hot["_hot"]), "left_semi").join(F.broadcast(own), on, "left"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that end a word: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _TABLES:
        if len(_TABLES) > 12:
            _TABLES.clear()
        _TABLES[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _TABLES[size]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64((1 << 31) - 1)
_LOW, _SLICE = np.uint64(31), 1 << 17
#: Bases that generate the whole group modulo the prime, and a value of each byte, for two polynomial hashes that share nothing with those modulo 2**64.
_GENERATORS = (7, 1_220_703_125)
_BYTES = np.random.default_rng(31).integers(1, (1 << 31) - 1, (2, 256)).astype(np.uint64)
_PRIME_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _PRIME) + (x >> _LOW)
    x = (x & _PRIME) + (x >> _LOW)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least n of each, by doubling."""
    size = 1 << max(10, (n + 1).bit_length())
    if (base, size) not in _PRIME_TABLES:
        both = []
        for b in (base, pow(base, -1, int(_PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, _folded(p * np.uint64(pow(b, len(p), int(_PRIME))))])
            both.append(p)
        if len(_PRIME_TABLES) > 4:
            _PRIME_TABLES.clear()
        _PRIME_TABLES[base, size] = (both[0], both[1])
    return _PRIME_TABLES[base, size]


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (bytes) of each word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    space = np.ones(len(text) + 2, bool)
    np.take(_SPACE, np.frombuffer(text, np.uint8), out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: start and end (bytes) and two 64-bit hashes of its words. The second hash comes from two polynomials modulo a prime, the first from these
    and one modulo 2**64, so words that are built to collide in the one do not in the other. Texts are hashed 128 kB at a time, short ones
    together, long ones in slices (a longer word as a whole), so that the tables of powers stay small."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _SLICE:
            yield from _hashes_of_all(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    yield from _hashes_of_all(held)


def _hashes_of_all(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    whole = b" ".join(texts)
    b, (start, end) = np.frombuffer(whole, np.uint8), word_places(whole)
    cuts = [0, *(np.flatnonzero(np.diff(start // _SLICE)) + 1).tolist(), len(start)]
    parts = [_hashes_of(b, start[i:j], end[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    none = np.zeros(0, np.uint64)
    first, second = (np.concatenate([none, *[p[k] for p in parts]]) for k in range(2))
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    at = np.searchsorted(start, offsets)
    for k in range(len(texts)):
        own = slice(at[k], at[k + 1])
        yield start[own] - offsets[k], end[own] - offsets[k], first[own], second[own]


def _hashes_of(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = b[start[0] : end[-1]]
    start, end = start - start[0], end - start[0]
    s, both = np.zeros(len(b) + 1, np.uint64), []
    for base, values in zip(_GENERATORS, _BYTES, strict=True):
        up, down = _prime_powers(base, max(len(b), _SLICE))
        v = values[b]
        v *= up[: len(b)]
        high = v >> _LOW
        v &= _PRIME
        v += high
        np.cumsum(v, out=s[1:])
        both.append(_folded(_folded(s[end] - s[start]) * down[start]))
    second = mix(both[0] | both[1] << _LOW) + (end - start).astype(np.uint64) * _ODD
    up, down = powers(max(len(b), _SLICE))
    v = b.astype(np.uint64)
    v += np.uint64(1)
    v *= up[: len(b)]
    np.cumsum(v, out=s[1:])
    return mix((s[end] - s[start]) * down[start] ^ second), mix(second)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k consecutive word hashes (none if there are fewer)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=s[1:])
    return mix((s[k:] - s[:-k]) * down[: n - k + 1])


def ranked(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df with the gapless 0-based position of each row in the given order. No window over all rows: rows are range-partitioned
    and sorted, and only the row counts of the partitions (at most spark.sql.shuffle.partitions numbers) are summed up in one place."""
    low = (1 << 33) - 1  # monotonically_increasing_id(): partition above, row of the partition in the lower 33 bits
    n = shuffle_partitions(df.sparkSession)
    s = written(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(low))})
    )
    counts = {r["_part"]: r["count"] for r in s.groupBy("_part").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(counts, default=0) + 1)])
    return s.withColumn(name, F.element_at(starts, F.col("_part") + 1) + F.col("_row")).drop("_part", "_row")
