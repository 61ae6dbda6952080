"""A stream of the lines that are appended to the files of a folder: whole lines only, each once, with its file and place.

The offset is one number of bytes per file, always behind a line's end, so a batch that runs again reads the same bytes, and a file may grow, or a new one
appear, between any two batches. Files are taken in the order of their names. A batch plans at most `limit` bytes (more if one line is longer); its
ranges are cut into partitions of `chunk` bytes, which the executors read. Files only grow: one that got shorter than what was read stops the stream.

A batch costs its two logs and a job, however small it is. Several tails of one folder (lanes) share that cost: each file is cut into ranges of at most `limit`
bytes that depend on its content only, the ranges are dealt in turn, and each lane is a stream with its own checkpoint, whose batches keep the limit.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, value string"
_BLOCK = 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Range(InputPartition):
    """The lines that start in [start, end) of a file; the first byte of `begin` starts a line."""

    def __init__(self, file: str, begin: int, start: int, end: int):
        super().__init__(0)
        self.file, self.begin, self.start, self.end = file, begin, start, end


def line_end(read, start: int, limit: int, size: int) -> int:
    """The greatest end of a line in (start, start + limit], else the first one behind it, else start. read(at, n) gives bytes."""
    top = min(size, start + limit)
    at = top
    while at > start:
        low = max(start, at - _BLOCK)
        cut = read(low, at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    while top < size:
        part = read(top, min(_BLOCK, size - top))
        cut = part.find(b"\n")
        if cut >= 0:
            return top + cut + 1
        top += len(part)
    return start


class TailReader(DataSourceStreamReader):
    lane = None

    def __init__(self, options: dict):
        self.folder, self.limit, self.chunk = options["path"].rstrip("/"), int(options.get("limit", 64 << 20)), int(options.get("chunk", 8 << 20))
        self.log, self.planned = options.get("log"), None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _known(self) -> dict:
        """What has been planned: by this reader, else by the newest entry of the query's offset log (option log: its checkpoint folder)."""
        if self.planned is None and self.log:
            where, base = _opened(f"{self.log.rstrip('/')}/offsets")
            found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
            names = [f for f in found if f.base_name.isdigit()]
            if names:
                with where.open_input_stream(max(names, key=lambda f: int(f.base_name)).path) as f:
                    self.planned = self._checked(json.loads(f.read().decode().strip().split("\n")[-1]))
        return self.planned or {}

    def _checked(self, offset: dict) -> dict:
        if offset.get("lane") != self.lane:
            raise RuntimeError(f"the checkpoint is of lane {offset.get('lane')}, not {self.lane}")
        return offset["files"]

    def _infos(self, where: fs.FileSystem, base: str) -> list[fs.FileInfo]:
        found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)

    def latestOffset(self) -> dict:
        where, base = _opened(self.folder)
        planned, left = dict(self._known()), self.limit
        for info in self._infos(where, base):
            start = planned.get(info.base_name, 0)
            if info.size < start:
                raise RuntimeError(f"{info.base_name} is shorter than what was read of it")
            if info.size > start and left > 0:
                with where.open_input_file(info.path) as f:
                    end = line_end(lambda at, n, f=f: f.read_at(n, at), start, left, info.size)
                left -= end - start
                if end > start:
                    planned[info.base_name] = end
        self.planned = planned
        return {"files": planned}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begun, wanted, out = self._checked(start), self._checked(end), []
        self.planned = max(self.planned or {}, wanted, key=lambda f: sum(f.values()))
        for name, stop in sorted(wanted.items()):
            begin = begun.get(name, 0)
            out += [Range(name, begin, at, min(stop, at + self.chunk)) for at in range(begin, stop, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, base = _opened(self.folder)
        with where.open_input_file(f"{base}/{partition.file}") as raw:
            f, at = io.BufferedReader(raw, 1 << 20), partition.start
            if at > partition.begin:  # the line that is under way here belongs to the part before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            places, values, size = [], [], 0
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                places.append(at)
                values.append(line[:-1].decode("utf-8", "replace"))
                at, size = at + len(line), size + len(line)
                if size > 4 << 20:
                    yield self._batch(partition.file, places, values)
                    places, values, size = [], [], 0
            if places:
                yield self._batch(partition.file, places, values)

    @staticmethod
    def _batch(file: str, places: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(places)), pa.array(places, pa.int64()), pa.array(values)], ["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class LaneReader(TailReader):
    """One lane of several: it reads every `lanes`-th range of a file. A range ends where a tail with this limit would cut a file that is already there, so
    all lanes find the same ones at any time; only the last range of a file may still grow. The offset holds per file the number and the start of a
    range and how far it is planned. A batch takes whole ranges, one of a file, while they fit."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.lane, self.idle = [int(options["lane"]), int(options["lanes"])], {}

    def initialOffset(self) -> dict:
        return {"files": {}, "lane": self.lane}

    def _next(self, f, name: str, state: list[int], size: int) -> tuple[int, int, list[int]] | None:
        """Start and end of the first unread range of this lane, and the state behind it."""
        (number, cut, at), (lane, lanes) = state, self.lane
        while (end := line_end(lambda at, n: f.read_at(n, at), cut, self.limit, size)) > cut:
            full = size - cut >= self.limit
            if (number + crc32(name.encode())) % lanes == lane and end > at:
                return at, end, [number + 1, end, end] if full else [number, cut, end]
            if not full:
                break
            number, cut, at = number + 1, end, end
        return None

    def latestOffset(self) -> dict:
        where, base = _opened(self.folder)
        planned, left = dict(self._known()), self.limit
        for info in self._infos(where, base):
            name, state = info.base_name, planned.get(info.base_name, [0, 0, 0])
            if info.size < state[2]:
                raise RuntimeError(f"{name} is shorter than what was read of it")
            if info.size == self.idle.get(name, 0):  # nothing was found for this lane, and the file has not grown
                continue
            with where.open_input_file(info.path) as f:
                found = self._next(f, name, state, info.size)
            if found is None:
                self.idle[name] = info.size
                continue
            start, end, state = found
            if end - start > left and left < self.limit:
                break
            planned[name], left = state, left - (end - start)
            if left <= 0:
                break
        self.planned = planned
        return {"files": planned, "lane": self.lane}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        where, base = _opened(self.folder)
        begun, wanted, out = self._checked(start), self._checked(end), []
        self.planned = max(self.planned or {}, wanted, key=lambda f: sum(s[2] for s in f.values()))
        for name, upto in sorted(wanted.items()):
            state = begun.get(name, [0, 0, 0])
            if state[2] >= upto[2]:
                continue
            with where.open_input_file(f"{base}/{name}") as f:
                while state[2] < upto[2]:
                    found = self._next(f, name, state, f.size())
                    if found is None:
                        raise RuntimeError(f"{name} is shorter than what was planned of it")
                    begin, stop, state = found
                    stop = min(stop, upto[2])  # a range that grew since
                    out += [Range(name, begin, at, min(stop, at + self.chunk)) for at in range(begin, stop, self.chunk)]
        return out


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return LaneReader(self.options) if "lanes" in self.options else TailReader(self.options)


def tail(spark: SparkSession, folder: str, checkpoint: str, limit: int = 64 << 20, chunk: int = 8 << 20, lane: tuple[int, int] | None = None) -> DataFrame:
    """The stream of (file, at, value) of a folder, or of one lane (number, lanes) of it, for a query whose checkpointLocation is `checkpoint`."""
    spark.dataSource.register(Tail)
    lines = spark.readStream.format("line_tail").option("path", folder).option("log", checkpoint).option("limit", limit).option("chunk", chunk)
    return (lines.option("lane", lane[0]).option("lanes", lane[1]) if lane else lines).load()


def to_batches(lines: DataFrame, out: str, checkpoint: str):
    """Starts a query that writes each batch as its own partition, overwriting it when it runs again after a failure."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def to_lanes(spark: SparkSession, folder: str, out: str, checkpoint: str, lanes: int, limit: int = 64 << 20, chunk: int = 8 << 20) -> list:
    """Starts `lanes` queries that together write each line of a folder once, as lane and batch. A checkpoint keeps its number of lanes."""
    queries = []
    try:
        for k in range(lanes):
            own = f"{checkpoint}/lane={k}"
            queries.append(to_batches(tail(spark, folder, own, limit, chunk, (k, lanes)), f"{out}/lane={k}", own))
    except BaseException:
        for q in queries:
            q.stop()
        raise
    return queries


def handoff_scan(lines: DataFrame, cursor: tuple[str, int], window_end: Column | None, now: Column, lag_s: int = 3600, window_s: int = 86_400) -> DataFrame:
    """One row over the lines (file, at, seen) of a hand-off folder: in_window, the lines seen in the window before window_end (null where no line is so old
    that the window is covered), and pending, the lines behind the cursor that have waited longer than the lag. Lines without a time are left out."""
    end = F.lit(None).cast("timestamp") if window_end is None else window_end
    start = F.timestamp_seconds(F.unix_seconds(end) - window_s)
    name, at = cursor
    behind = (F.col("file") > name) | ((F.col("file") == name) & (F.col("at") >= at))
    got = lines.filter("seen is not null").agg(
        F.count_if((F.col("seen") > start) & (F.col("seen") <= end)).alias("inside"), F.coalesce(F.bool_or(F.col("seen") <= start), F.lit(False)).alias("covered"),
        F.count_if(behind & (F.unix_micros(now) - F.unix_micros("seen") > lag_s * 1_000_000)).alias("pending"),
    )
    return got.select(F.when(F.col("covered"), F.col("inside")).alias("in_window"), "pending")
