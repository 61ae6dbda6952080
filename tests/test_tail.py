"""The tail of a folder of line files over growth, half-written lines, kills and restarts."""

import os
import random

import pytest

from advertlake.streaming import tail as T


def _read(spark, out):
    if not os.path.isdir(out):
        return []
    return [(r.file, r.at, r.value) for r in spark.read.parquet(out).collect()]


def _expected(folder):
    want = []
    for name in sorted(os.listdir(folder)):
        at = 0
        for line in open(os.path.join(folder, name), "rb").read().split(b"\n")[:-1]:
            want.append((name, at, line.decode("utf-8", "replace")))
            at += len(line) + 1
    return want


@pytest.mark.parametrize("limit", [300, 1 << 20])
def test_no_line_is_lost_or_read_twice(spark, tmp_path, limit):
    rng = random.Random(limit)
    folder, out, chk = (str(tmp_path / n) for n in ("lines", "out", "chk"))
    os.mkdir(folder)
    for round_ in range(4):
        for name in [f"d-{round_}.jsonl", "d-0.jsonl"]:  # a new file, and late growth of the first one
            with open(os.path.join(folder, name), "ab") as f:
                for _ in range(40):
                    f.write(rng.choice([b"", "é€\U0001f600".encode(), b"\xff", b"x" * rng.randrange(120)]) + b"\n")
                f.write(b"half a line")  # it is continued by the next round
        q = T.to_batches(T.tail(spark, folder, chk, limit, 64), out, chk)
        try:
            if round_ % 2:
                q.processAllAvailable()
        finally:
            q.stop()  # on even rounds in the middle of the work
    q = T.to_batches(T.tail(spark, folder, chk, limit, 64), out, chk)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(_read(spark, out)) == sorted(_expected(folder))
    assert len(os.listdir(out)) > (4 if limit == 300 else 0)


def test_a_file_that_got_shorter_stops_the_stream(tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\n")
    r = T.TailReader({"path": str(tmp_path)})
    assert r.latestOffset() == {"files": {"a": 8}}
    (tmp_path / "a").write_bytes(b"one\n")
    with pytest.raises(RuntimeError):
        r.latestOffset()


def test_line_ends():
    data = b"ab\n" + b"c" * 200_000 + b"\nd"
    read = lambda at, n: data[at : at + n]
    assert T.line_end(read, 0, 10, len(data)) == 3 and T.line_end(read, 3, 10, len(data)) == 200_004 and T.line_end(read, 200_004, 10, len(data)) == 200_004
    assert T.line_end(read, 0, 1 << 20, len(data)) == 200_004


def _stretches(folder, limit):
    """Where a tail with this limit cuts each whole file."""
    out = {}
    for name in os.listdir(folder):
        data, cuts = open(os.path.join(folder, name), "rb").read(), [0]
        while (end := T.line_end(lambda at, n: data[at : at + n], cuts[-1], limit, len(data))) > cuts[-1]:
            cuts.append(end)
        out[name] = set(zip(cuts, cuts[1:]))
    return out


def test_lanes_share_the_batches_and_keep_the_limit(spark, tmp_path):
    folder, out, chk = (str(tmp_path / n) for n in ("lines", "out", "chk"))
    os.mkdir(folder)
    for name in ("a", "b", "c"):
        with open(os.path.join(folder, name), "wb") as f:
            f.writelines(b"%s %d\n" % (name.encode(), i) for i in range(400))
    queries = T.to_lanes(spark, folder, out, chk, 4, 300, 128)
    try:
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    assert sorted(_read(spark, out)) == sorted(_expected(folder))
    sizes = {(r.lane, r.batch): r.size for r in spark.read.parquet(out).selectExpr("lane", "batch", "octet_length(value) + 1 AS size").groupBy("lane", "batch").sum("size").toDF("lane", "batch", "size").collect()}
    ranges = sum(map(len, _stretches(folder, 300).values()))
    assert max(sizes.values()) <= 300 and len(sizes) >= ranges - 3  # the last range of a file may share a batch
    assert {lane for lane, _ in sizes} == {0, 1, 2, 3} and max(batch for _, batch in sizes) < ranges / 4 + 3


def test_lanes_over_growth_and_restarts(spark, tmp_path):
    rng = random.Random(20)
    folder, out, chk = (str(tmp_path / n) for n in ("lines", "out", "chk"))
    os.mkdir(folder)
    for round_ in range(3):
        for name in [f"d-{round_}.jsonl", "d-0.jsonl"]:
            with open(os.path.join(folder, name), "ab") as f:
                for _ in range(40):
                    f.write(rng.choice([b"", "é€\U0001f600".encode(), b"\xff", b"x" * rng.randrange(120), b"y" * 700]) + b"\n")
                f.write(b"half a line")
        queries = T.to_lanes(spark, folder, out, chk, 3, 300, 64)
        try:
            if round_:
                for q in queries:
                    q.processAllAvailable()
        finally:
            for q in queries:
                q.stop()  # on the first round in the middle of the work
    assert sorted(_read(spark, out)) == sorted(_expected(folder))


@pytest.mark.parametrize("seed", range(20))
def test_ranges_of_lanes_at_any_moment(tmp_path, seed):
    """Lanes that look at different times, lose their reader or repeat a batch read each line once."""
    rng = random.Random(seed)
    lanes, limit = rng.choice([2, 3, 7]), rng.choice([1, 50, 300])
    new = lambda k: T.LaneReader({"path": str(tmp_path), "limit": limit, "chunk": 64, "lane": k, "lanes": lanes})
    readers, got = [new(k) for k in range(lanes)], []
    at = [r.initialOffset() for r in readers]

    def turn(k):
        end = readers[k].latestOffset()
        if end == at[k]:
            return False
        parts = readers[k].partitions(at[k], end)
        if rng.random() < 0.3:  # the file grows and the batch runs again, in a new reader
            with open(tmp_path / rng.choice("ab"), "ab") as f:
                f.write(b"z" * rng.randrange(80) + b"\n" * rng.randrange(2))
            readers[k] = new(k)
            again = readers[k].partitions(at[k], end)
            assert [vars(p) for p in again] == [vars(p) for p in parts]
        rows = [(b["file"][i].as_py(), b["at"][i].as_py(), b["value"][i].as_py()) for p in parts for b in readers[k].read(p) for i in range(b.num_rows)]
        assert rows and (len(rows) == 1 or sum(len(v) + 1 for _, _, v in rows) <= limit)
        got.extend(rows)
        at[k] = end
        return True

    for _ in range(60):
        with open(tmp_path / rng.choice("ab"), "ab") as f:
            f.write(b"".join(rng.choice([b"\n", b"x" * rng.randrange(90) + b"\n", b"part"]) for _ in range(rng.randrange(6))))
        turn(rng.randrange(lanes))
    while any([turn(k) for k in range(lanes)]):
        pass
    assert sorted(got) == sorted(_expected(tmp_path)) and got


def test_a_lane_refuses_another_number_of_lanes(tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\n")
    reader = lambda lanes: T.LaneReader({"path": str(tmp_path), "lane": 0, "lanes": lanes})
    two = reader(2)
    with pytest.raises(RuntimeError):
        reader(3).partitions(two.initialOffset(), two.latestOffset())
    with pytest.raises(RuntimeError):
        T.TailReader({"path": str(tmp_path)}).partitions({"files": {}}, two.latestOffset())
