"""Logs that grow, as a data source: what stands after a byte of each file, in whole lines.

An offset is a map from file to byte. It names the end of the last whole line, so a line that is still being written waits.
Byte ranges are dealt to tasks, which read theirs only; bytes are cut and counted as bytes and decoded line by line,
with a mark for what isn't UTF-8. Files lie where Arrow's file systems reach them (local, HDFS, S3, GCS, Azure).

``spark.dataSource.register(Tails)``, then ``spark.read.format("tails").option("path", ...)`` or ``spark.readStream``.
Options: ``path`` (a folder or a file), ``suffix`` (of files to read, ``.jsonl``), ``offsets`` (a JSON map, batch only),
``rangeBytes`` (of a task, 64 MB).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at long, line string, upto long"
BLOCK = 1 << 16
BATCH_ROWS = 4096


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from byte ``start`` on and before ``end``; ``end`` is the end of a line or lies
    within the file."""

    path: str
    start: int
    end: int
    first: bool  # whether ``start`` is where a line begins


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def whole_lines(path: str, size: int) -> int:
    """The byte after the last whole line."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def sizes(path: str, suffix: str) -> dict[str, int]:
    """The files under a path and their bytes."""
    system, inner = _open(path)
    found = system.get_file_info(inner)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return {head + i.path: i.size for i in infos if i.type == fs.FileType.File and (i.path.endswith(suffix) or i is found)}


def ends(options: dict) -> dict[str, int]:
    return {p: whole_lines(p, n) for p, n in sizes(options["path"], options.get("suffix", ".jsonl")).items()}


def ranges(start: dict[str, int], end: dict[str, int], each: int) -> list[Range]:
    """What was added, in pieces; a file that got shorter is read anew."""
    out = []
    for path in sorted(end):
        low = start.get(path, 0)
        low = low if low <= end[path] else 0
        out += [Range(path, k, min(k + each, end[path]), k == low) for k in range(low, end[path], each)]
    return out


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    system, inner = _open(r.path)
    rows: list[tuple[int, str, int]] = []

    def batch() -> pa.RecordBatch:
        at, lines, upto = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([r.path] * len(rows)), pa.array(at, pa.int64()), pa.array(lines), pa.array(upto, pa.int64())], names=["path", "at", "line", "upto"])

    with system.open_input_file(inner) as f:
        at, kept = r.start, b""
        if not r.first:  # the line that a range cuts belongs to the range where it begins
            at -= 1
        f.seek(at)
        skip = not r.first
        while at < r.end:
            block = f.read(BLOCK)
            if not block:
                break
            *lines, kept = (kept + block).split(b"\n")
            for line in lines:
                if not skip and at < r.end:
                    rows.append((at, line.decode("utf-8", "replace"), at + len(line) + 1))
                    if len(rows) == BATCH_ROWS:
                        yield batch()
                        rows.clear()
                skip = False
                at += len(line) + 1
    if rows:
        yield batch()


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        return ranges(json.loads(self.options.get("offsets", "{}")), ends(self.options), int(self.options.get("rangebytes", 64 << 20))) or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(self.options)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, int(self.options.get("rangebytes", 64 << 20)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        """Nothing to tidy: files are others' to write and remove."""


class Tails(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tails"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def tail(spark: SparkSession, path: str, offsets: dict[str, int] | None = None, suffix: str = ".jsonl") -> DataFrame:
    """``path, at, line, upto``: the whole lines after the given byte of each file (all of files that aren't named or got
    shorter), with the bytes where a line begins and where the next one does."""
    spark.dataSource.register(Tails)
    return spark.read.format("tails").option("path", path).option("suffix", suffix).option("offsets", json.dumps(offsets or {})).load()


def tail_stream(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """The same as a stream; its checkpoint holds the offset of each file."""
    spark.dataSource.register(Tails)
    return spark.readStream.format("tails").option("path", path).option("suffix", suffix).load()


def next_offsets(lines: DataFrame, before: dict[str, int] | None = None) -> dict[str, int]:
    """The offsets to go on from: one for each file, as many as the driver lists anyway."""
    return (before or {}) | {r["path"]: r["upto"] for r in lines.groupBy("path").agg(F.max("upto").alias("upto")).collect()}
