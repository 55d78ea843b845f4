"""A data source of the records of large JSON arrays, in byte ranges: one file is as many tasks as it has ranges."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; bytes that are read at once behind a range until its last record ends; bytes that a record's start may take.
RANGE, BEHIND, START = 64 << 20, 1 << 20, 4096
#: Tasks up to which each range is one of its own; with more ranges, a task takes several, one after the other.
TASKS = 1000
SCHEMA = "path string, start bigint, record string"
_TYPES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("record", pa.string())])


@dataclass
class Ranges(InputPartition):
    """Stretches of files (path, start, end, size of the file), each of which is read in ranges."""

    parts: list[tuple[str, int, int, int]]


class JsonRecords(DataSource):
    """Rows (path, start, record): the text of each object of an array of objects, and the byte at which it starts.

    Options: path (a folder, looked through with its subfolders), files (a pattern of names), keys (names with commas between
    them: every record's first key is one of these, and no object within a record has one of them first), bytes of a range.
    A record belongs to the range in which it starts, and its text ends where the next one starts. A range is a task; if these
    would be more than some TASKS, a task takes several ranges, 64 MB in all at most, and holds one at a time. Files may be in
    any store that Arrow's file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.files, self.size = options["path"], options.get("files", "*"), int(options.get("bytes", RANGE))
        keys = "|".join(re.escape(k.strip()) for k in options["keys"].split(","))
        self.pattern = rb'\{\s*"(?:' + keys.encode() + rb')"\s*:'

    def partitions(self) -> list[Ranges]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = store.get_file_info(root)
        listed = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in listed if f.is_file and fnmatch.fnmatch(f.base_name, self.files) and not f.base_name.startswith(("_", "."))]
        ranges = [(f, at, min(at + self.size, f.size)) for f in files for at in range(0, f.size, self.size)]
        most = min(RANGE, sum(f.size for f in files) // TASKS) if len(ranges) > TASKS else 0  # bytes of a task
        tasks, room = [], 0
        for f, at, end in ranges:
            if not tasks or room < end - at:
                tasks.append(Ranges([]))
                room = most
            parts = tasks[-1].parts
            if parts and parts[-1][0] == f.path:
                parts[-1] = (f.path, parts[-1][1], end, f.size)  # the next one of the same file
            else:
                parts.append((f.path, at, end, f.size))
            room -= end - at
        return tasks

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path, start, end, size in part.parts:
            with store.open_input_file(path) as f:
                for a in range(start, end, self.size):
                    yield from self._records(f, path, a, min(a + self.size, end), size)

    def _records(self, f: pa.NativeFile, path: str, start: int, end: int, size: int) -> Iterator[pa.RecordBatch]:
        """The records that start in one range."""
        pattern = re.compile(self.pattern)
        data = f.read_at(min(end + START, size) - start, start)
        starts = [m.start() for m in pattern.finditer(data) if start + m.start() < end]
        if not starts:
            return
        # behind the range to where its last record ends: the start of the next one, or the end of the file
        at = starts[-1] + 1
        while (after := pattern.search(data, at)) is None and start + len(data) < size:
            at = max(at, len(data) - START)
            data += f.read_at(min(BEHIND, size - start - len(data)), start + len(data))
        ends = [*starts[1:], after.start() if after else len(data)]
        for k in range(0, len(starts), 1000):
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[k : k + 1000], ends[k : k + 1000])]
            last = k + 1000 >= len(starts) and after is None
            texts = [t if last and i == len(texts) - 1 else t.rstrip().removesuffix(",").rstrip() for i, t in enumerate(texts)]
            if last:
                texts[-1] = _first_value(texts[-1])
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array([start + a for a in starts[k : k + 1000]], pa.int64()), pa.array(texts)], schema=_TYPES)


def _first_value(text: str) -> str:
    """The object at the start of a text, without what closes the array and stands behind it; the text itself if it is none."""
    try:
        return text[: json.JSONDecoder().raw_decode(text)[1]]
    except ValueError:
        return text


def read_records(spark: SparkSession, path: str, files: str, keys: tuple[str, ...], schema: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Records of JSON arrays, parsed, with path as a last column; and those that can't be (path, start, record)."""
    spark.dataSource.register(JsonRecords)
    raw = spark.read.format("json_records").option("files", files).option("keys", ",".join(keys)).option("bytes", str(size)).load(path)
    parsed = raw.withColumn("r", F.from_json("record", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*", "path").drop("_bad"), parsed.where(bad).select("path", "start", "record")
