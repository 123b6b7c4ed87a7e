"""A streaming source of text files that grow: appended lines, rotation, truncation.

Progress is a byte position for each file, known by its inode, so a file that
is renamed keeps its place, a new file under an old name starts anew, and a
file that is shorter than its position was truncated and starts anew, too. Only
whole lines are taken; the rest waits for its line end. Positions are the
query's checkpoint, so a restart goes on where the last batch ended.

Ranges of bytes are read by executors, which must reach the files: on one
machine, as a log sidecar does, or in a mounted folder. Folders in stores, where
files don't grow, are what follow.follow_lines is for.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

FORMAT = "growing_lines"
SCHEMA = "file string, position long, raw string"
#: Bytes of a file that one task reads, about.
CHUNK = 32 << 20
BLOCK = 1 << 16
BATCH_LINES = 8192

#: inode -> (path, position)
Marks = dict[str, list]


@dataclass
class Range(InputPartition):
    """Lines of the file that start at a byte from at (after the first line end there, unless at is a line's start) to before upto."""

    path: str
    inode: str
    at: int
    upto: int
    whole: bool


def complete_end(path: str) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def positions(pattern: str) -> Marks:
    """Where whole lines end now, in each file of the pattern."""
    out: Marks = {}
    for path in sorted(glob.glob(pattern)):
        try:
            if os.path.isfile(path):
                out[str(os.stat(path).st_ino)] = [path, complete_end(path)]
        except OSError:  # it went meanwhile
            continue
    return out


def began(start: Marks, inode: str, end: int) -> int:
    """Where reading goes on, in a file whose lines end at end."""
    at = start[inode][1] if inode in start else 0
    return at if at <= end else 0


def located(path: str, inode: str) -> str | None:
    """The file's path, which may have changed since it was seen."""
    folder = os.path.dirname(path) or "."
    for candidate in (path, *(e.path for e in os.scandir(folder))):
        try:
            if str(os.stat(candidate).st_ino) == inode:
                return candidate
        except OSError:
            continue
    return None


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    """(file, position, raw) of a range; nothing if the file is gone."""
    path = located(part.path, part.inode)
    if path is None:
        return
    with open(path, "rb") as f:
        if not part.whole and part.at:
            f.seek(part.at - 1)
            f.readline()  # the line of the range before, or just its end
        else:
            f.seek(part.at)
        while (at := f.tell()) < part.upto and (line := f.readline()).endswith(b"\n"):
            text = line[:-1].removesuffix(b"\r").decode("utf-8", "replace")
            yield part.path, at, text.removeprefix("﻿") if at == 0 else text


class _Ranges(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern, self.chunk = options["path"], int(options.get("bytesPerTask", CHUNK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return positions(self.pattern)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for inode, (path, upto) in end.items():
            first = began(start, inode, upto)
            out += [Range(path, inode, at, min(upto, at + self.chunk), at == first) for at in range(first, upto, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        for row in lines_of(partition):
            rows.append(row)
            if len(rows) == BATCH_LINES:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    files, places, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["file", "position", "raw"])


class _Limited(SimpleDataSourceStreamReader):
    """So many lines a batch, read by the driver; with a trigger each second a limit of lines per second."""

    def __init__(self, options: dict):
        self.pattern, self.most = options["path"], int(options["linesPerTrigger"])

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for inode, (path, upto) in positions(self.pattern).items():
            at = began(start, inode, upto)
            for row in lines_of(Range(path, inode, at, upto, True)) if len(rows) < self.most else ():
                if len(rows) == self.most:
                    break
                rows.append(row)
                at = None
            else:
                end[inode] = [path, upto if at is None or at == upto else at]
                continue
            end[inode] = [path, row[1]]  # the first line that isn't taken
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for inode, (path, upto) in end.items():
            yield from lines_of(Range(path, inode, began(start, inode, upto), upto, True))


class GrowingLines(DataSource):
    """Options: path (a glob of files), bytesPerTask, linesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self.options.get("linesPerTrigger"):
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader with a line limit"})
        return _Ranges(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Limited(dict(self.options))
