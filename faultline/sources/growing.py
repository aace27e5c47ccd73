"""Text logs that are followed while they grow.

A streaming source whose offset is a byte position per file. Each trigger lists the folder, takes every file
up to the end of its last whole line, and reads what was added since, cut into ranges that
tasks read side by side. A line is read once, however often its file grows in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from faultline.functions.text import strip
from faultline.schema import TEXT_EXTENSIONS

# Bytes that one task reads of a file, that are read at once, and that a look for the last line end goes back by.
SPLIT_BYTES, READ_BYTES, TAIL_BYTES = 64 << 20, 4 << 20, 64 << 10
# Tasks of a trigger, about, before their ranges get wider than asked for, up to SPLIT_BYTES.
TASKS = 256
SCHEMA = "source_file string, position long, value string"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it: a mount, or a scheme that Arrow knows."""
    return fs.FileSystem.from_uri(folder)


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; lines that begin in it are its own."""

    file: str
    start: int
    end: int
    floor: int  # where reading began: a range that starts there starts with a line
    stop: int  # end of the last whole line


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("path", folder)``: SCHEMA, one row per whole line.

    Options: ``extensions`` (comma-joined), ``split_bytes`` (more if a trigger has much to read). Every file below the folder has an entry in the
    offset, so logs should be moved away once they are done with. A file shorter than what was read of
    it was begun anew and is read from its start. A line without a line end waits until it has one.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        extensions = self.options.get("extensions", ",".join(TEXT_EXTENSIONS)).split(",")
        return GrowingReader(self.options["path"], extensions, int(self.options.get("split_bytes", SPLIT_BYTES)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str, extensions: Sequence[str], split_bytes: int):
        self.folder, self.split_bytes = folder, split_bytes
        self.wanted = re.compile(r".*\.(" + "|".join(map(re.escape, extensions)) + ")", re.IGNORECASE | re.DOTALL)
        # Sizes at the last look, and the line ends found then; only files that changed are opened.
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = file_system(self.folder)
        found, ends = {}, {}
        for file in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if file.type == fs.FileType.File and self.wanted.fullmatch(file.base_name):
                size, end = self.seen.get(file.path, (-1, 0))
                if file.size != size:
                    end = line_end(system, file.path, file.size, end if 0 <= size < file.size else 0)
                found[file.path] = (file.size, end)
                ends[file.path] = end
        self.seen = found
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        floors = {file: start.get(file, 0) if start.get(file, 0) <= stop else 0 for file, stop in end.items()}
        fresh = sum(stop - floors[file] for file, stop in end.items())
        width = max(self.split_bytes, min(SPLIT_BYTES, fresh // TASKS))
        return [
            Range(file, at, min(at + width, stop), floors[file], stop)
            for file, stop in sorted(end.items())
            for at in range(floors[file], stop, width)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        with system.open_input_file(partition.file) as file:
            for positions, lines in lines_of(file, partition):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.file] * len(lines), pa.string()),
                        pa.array(positions, pa.int64()),
                        pa.array([line.decode("utf-8", "replace") for line in lines], pa.string()),
                    ],
                    names=["source_file", "position", "value"],
                )


def line_end(system: fs.FileSystem, path: str, size: int, floor: int) -> int:
    """The position after the last line end below ``size``; ``floor``, itself one, if none stands behind it."""
    with system.open_input_file(path) as file:
        end = size
        while end > floor:
            start = max(floor, end - TAIL_BYTES)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return floor


def lines_of(file, part: Range) -> Iterator[tuple[list[int], list[bytes]]]:
    """Positions and bytes of the lines that begin in a range, without their line ends."""
    at, rest = part.start, b""
    if part.start > part.floor:
        # The line that reaches into the range belongs to the one before: go on after its end.
        at, found = part.start - 1, -1
        while at < part.stop and found < 0:
            file.seek(at)
            chunk = file.read(min(READ_BYTES, part.stop - at))
            found = chunk.find(b"\n")
            at += found + 1 if found >= 0 else len(chunk)
    file.seek(at)
    begin = at
    while begin < part.end:
        chunk = file.read(min(READ_BYTES, part.stop - at))
        if not chunk:
            return
        at += len(chunk)
        whole = (rest + chunk).split(b"\n")
        rest = whole.pop()
        positions, lines = [], []
        for line in whole:
            if begin >= part.end:
                break
            positions.append(begin)
            lines.append(line)
            begin += len(line) + 1
        if lines:
            yield positions, lines


def follow_text(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = TEXT_EXTENSIONS,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Raw rows of text logs that grow in place, each whole line once, and each with its byte position.

    ``folder`` must be a mount that all executors share or a scheme that Arrow knows.
    """
    spark.dataSource.register(GrowingFiles)
    lines = (
        spark.readStream.format("growing_files")
        .option("path", folder)
        .option("extensions", ",".join(extensions))
        .option("split_bytes", split_bytes)
        .load()
    )
    text = lines.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")
    return text.select(
        "source_file",
        F.lit(None).cast("long").alias("line_number"),
        F.col("value").alias("line"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        F.lit(None).cast("map<string,double>").alias("seconds"),
        F.lit(None).cast("string").alias("raw"),
        F.lit(None).cast("string").alias("reason"),
        "position",
    )
