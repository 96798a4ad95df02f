"""Logs and page archives of lines that grow in place, as a data source for batches and streams.

A file stream takes each file once, so it misses what is appended to one it has seen. Here an
offset is the number of bytes read of each file, always at the end of a line; a batch or a
trigger is cut into ranges of bytes, and a line belongs to the range in which its first byte
lies. So a file of any size is read by many tasks, a restart goes on behind the last line
that was processed, and no line is read twice.

Defined results: a line counts once its end is there, in batches and streams alike, so a
record that is being written is left for later; bytes that are no UTF-8 become U+FFFD; files
whose names begin with ``_`` or ``.`` are none of the log; a file that has become shorter than
what was read of it fails the stream, one that is gone is forgotten. An offset has one number a
file: rotate logs by size, not by record. A task holds one block and one line at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, OUT = "growing_lines", "file string, at bigint, value string"
BLOCK, RANGE = 1 << 20, 64 << 20  #: bytes read at once; bytes of a task


@dataclass
class Range(InputPartition):
    """Lines of ``file`` that begin in [start, end); its complete lines end at ``stop``."""

    file: str
    start: int
    end: int
    stop: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"file:/+|/", path)
    return (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(path)


def _complete(store: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last complete line of a file ends, looking back no further than ``known``."""
    with store.open_input_file(path) as f:
        hi = size
        while hi > known:
            lo = max(hi - BLOCK, known)
            at = f.read_at(hi - lo, lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return known


def lines(f, start: int, end: int, stop: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lines that begin in [start, end) with their places, a block's at a time."""
    place = max(start - 1, 0)  # with the byte before, which tells whether a line begins at start
    begun_before = start > 0
    f.seek(place)
    left, parts = stop - place, []
    while left > 0 and (block := f.read(min(BLOCK, left))):
        left -= len(block)
        first, *more = block.split(b"\n")
        parts.append(first)
        if not more:
            continue
        found = []
        for line in (b"".join(parts), *more[:-1]):
            if not begun_before and place < end:
                found.append((place, line))
            begun_before = False
            place += len(line) + 1
        parts = [more[-1]]
        if found:
            yield found
        if place >= end:
            return


class _Ranges:
    """What readers of batches and streams share: the files, and ranges of them."""

    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.ends: dict[str, int] = {}

    def latest(self) -> dict[str, int]:
        """Bytes of complete lines by file. A file's end is sought from where it was last found."""
        store, root = _store(self.path)
        now = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "_.":
                known = self.ends.get(info.path, 0)
                now[info.path] = _complete(store, info.path, info.size, known) if info.size >= known else info.size
        self.ends = now
        return now

    def cut(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        found = []
        for file, hi in sorted(end.items()):
            lo = start.get(file, 0)
            if hi < lo:
                raise ValueError(f"{file} is shorter than what was read of it")
            found += [Range(file, a, min(a + self.range, hi), hi) for a in range(lo, hi, self.range)]
        return found

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            for found in lines(f, partition.start, partition.end, partition.stop):
                text = [line.decode("utf-8", "replace") for _, line in found]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(found)), pa.array([at for at, _ in found], pa.int64()), pa.array(text, pa.string())], names=["file", "at", "value"])


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.cut({}, self.latest())


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.cut(start, end)


class GrowingLines(DataSource):
    """Options: path, a folder with its scheme; rangeBytes, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return OUT

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _records(lines_: DataFrame, schema: str | None) -> DataFrame:
    if schema is None:
        return lines_
    record = F.from_json("value", schema)
    return lines_.where(F.trim("value") != "").select(record.alias("r")).select("r.*")


def _asked(spark: SparkSession, source, path: str, range_bytes: int):
    spark.dataSource.register(GrowingLines)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return source.format(NAME).option("path", full).option("rangeBytes", range_bytes).load()


def read(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """All complete lines below ``path`` (file, at, value), or with a schema their JSON records; blank lines are no records."""
    return _records(_asked(spark, spark.read, path, range_bytes), schema)


def follow(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The same as a stream, of what is there and of what is appended."""
    return _records(_asked(spark, spark.readStream, path, range_bytes), schema)
