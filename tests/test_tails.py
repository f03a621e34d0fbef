"""Tails of growing files, as a batch and as a stream, and the order of rows of several files."""

import random

from tidewell.sources import readers, tails


def _expected(files, offsets):
    out = set()
    for path, data in files.items():
        start = offsets.get(path, 0)
        at = start if start <= data.rfind(b"\n") + 1 else 0
        for line in data[at:].split(b"\n")[:-1]:
            out.add((path, at, line.decode("utf-8", "replace"), at + len(line) + 1))
            at += len(line) + 1
    return out


def _grown(pick, data):
    pieces = [b"", b"\n", b"one", "\u00e9\u00e9n\n".encode(), b"\xff\xfe broken\n", b"x" * 200, b"end\n" * 30]
    return data + b"".join(pick.choice(pieces) for _ in range(pick.randint(0, 12)))


def test_tails_by_file(spark, tmp_path):
    pick, files, offsets = random.Random(31), {}, {}
    for step in range(4):
        for k in range(step + 2):
            path = tmp_path / f"{k}.jsonl"
            data = b"anew\n" if step == 3 and k == 0 else _grown(pick, files.get(str(path), b""))
            path.write_bytes(data)
            files[str(path)] = data
        (tmp_path / "other.txt").write_text("no\n")
        rows = tails.tail(spark, str(tmp_path), offsets)
        got = {tuple(r) for r in rows.collect()}
        assert got == _expected(files, offsets)
        offsets = tails.next_offsets(rows, offsets)
    assert tails.tail(spark, str(tmp_path), offsets).collect() == []


def test_ranges_meet_without_gaps(tmp_path, monkeypatch):
    pick = random.Random(32)
    monkeypatch.setattr(tails, "BLOCK", 7)
    for k in range(60):
        path = tmp_path / f"{k}.jsonl"
        path.write_bytes(_grown(pick, b""))
        end = tails.ends({"path": str(path)})
        want = _expected({str(path): path.read_bytes()}, {})
        for each in (1, 3, 10, 1000):
            got = [tuple(row.values()) for r in tails.ranges({}, end, each) for b in tails.read_range(r) for row in b.to_pylist()]
            assert len(got) == len(set(got)) and set(got) == want


def test_tails_as_a_stream_that_restarts(spark, tmp_path):
    pick, files, folder = random.Random(33), {}, tmp_path / "in"
    folder.mkdir()
    for _ in range(3):
        for k in range(3):
            data = _grown(pick, files.get(str(folder / f"{k}.jsonl"), b""))
            (folder / f"{k}.jsonl").write_bytes(data)
            files[str(folder / f"{k}.jsonl")] = data
        made = tails.tail_stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = made.option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
    got = spark.read.schema(tails.SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _expected(files, {})


def test_rows_of_several_files_in_order(spark, tmp_path):
    line = '{"time":"t","id":"%s","event":"worked"}\n'
    sizes = {"a": 3, "b": 4000, "c": 40, "d": 2500}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(line % f"{name}{k:05d}" for k in range(n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")  # files are split, and small ones share a task
    try:
        rows = readers.usage(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set(key, before)
    assert [r.id for r in rows] == [f"{name}{k:05d}" for name, n in sizes.items() for k in range(n)]
    assert len({r.seq for r in rows}) == len(rows) and {r.machine.rsplit("/", 1)[1] for r in rows} == {f"{n}.jsonl" for n in sizes}
