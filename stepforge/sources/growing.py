"""A streaming source of files that grow line by line, such as journals: each line comes once, when it is complete.

Spark's own file source reads a file once; this one keeps how far each file has been read, in bytes, as the stream's offset, so
that a restarted stream goes on where its last committed trigger ended.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads: larger additions are divided among tasks, and smaller ones share one, up to so many files.
SPLIT, FILES = 64 << 20, 256
#: Bytes that are searched for a line's end at once, and lines in a batch of rows.
BLOCK, ROWS = 64 << 10, 4096
SCHEMA = "file string, start long, raw string"


@dataclass
class Piece:
    """The lines of a file that begin within [start, end); `first` is where the addition begins, at a line's start, or -1 for a file that is gone."""

    file: str
    first: int
    start: int
    end: int


@dataclass
class Pack(InputPartition):
    pieces: list[Piece]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class GrowingLines(DataSource):
    """Options: path, a folder; pattern, which names in it count (*.jsonl); split, the bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options["path"], self.options.get("pattern", "*.jsonl"), int(self.options.get("split", SPLIT)))


class Reader(DataSourceStreamReader):
    """An offset is {file: bytes up to the end of its last complete line}: some tens of bytes a file, which is named from the folder on.

    A file that has become shorter was replaced, and is read from its start; one that was replaced by a longer one can't be told from one that grew.
    """

    def __init__(self, path: str, pattern: str, split: int):
        self.path, self.pattern, self.split = path, pattern, split
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, folder = opened(self.path)
        found = {}
        for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern):
                size, end = self.seen.get(x.path, (0, 0))
                if size != x.size:
                    end = last_line_end(store, x.path, end if x.size > size else 0, x.size)
                found[x.path] = x.size, end
        self.seen = found
        return {path.removeprefix(f"{folder.rstrip('/')}/"): end for path, (_, end) in sorted(found.items()) if end}

    def pieces(self, start: dict, end: dict) -> Iterator[Piece]:
        folder = opened(self.path)[1].rstrip("/")
        whole = lambda x: {path if path.startswith(f"{folder}/") else f"{folder}/{path}": at for path, at in x.items()}
        start, end = whole(start), whole(end)
        for path, to in end.items():
            at = start.get(path, 0)
            first = at if at <= to else 0
            yield from (Piece(path, first, a, min(a + self.split, to)) for a in range(first, to, self.split))
        yield from (Piece(path, -1, -1, -1) for path in start if path not in end)

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        out, held = [], 0
        for p in self.pieces(start, end):
            if not out or held + p.end - p.start > self.split or len(out[-1].pieces) == FILES:
                out.append(Pack([]))
                held = 0
            out[-1].pieces.append(p)
            held += p.end - p.start
        return out

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for p in partition.pieces:
            yield from self.lines(store, p)

    def lines(self, store: fs.FileSystem, p: Piece) -> Iterator[pa.RecordBatch]:
        if p.first < 0:
            yield batch_of(p.file, [-1], [None])
            return
        with io.BufferedReader(store.open_input_file(p.file), BLOCK) as f:
            at = p.start
            if at > p.first:  # a line that begins before belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            starts, lines = [], []
            while at < p.end and (line := f.readline()):
                starts.append(at)
                lines.append(line.rstrip(b"\n").decode("utf-8", "replace"))
                at += len(line)
                if len(lines) == ROWS:
                    yield batch_of(p.file, starts, lines)
                    starts, lines = [], []
            if lines:
                yield batch_of(p.file, starts, lines)

    def commit(self, end: dict) -> None:
        pass


def batch_of(file: str, starts: list[int], lines: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], ["file", "start", "raw"])


def last_line_end(store: fs.FileSystem, path: str, low: int, size: int) -> int:
    """The end of the last complete line before `size`; `low`, the end of an earlier one, if none has been completed since."""
    with store.open_input_file(path) as f:
        while size > low:
            begin = max(low, size - BLOCK)
            f.seek(begin)
            if (found := f.read(size - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            size = begin
    return low


def growing_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """A stream of (file, start, raw): the lines of the files under a folder, each once; start is where it begins in its file.

    A file that is gone gives a row with -1 and null; one of its name that comes later is read from its start.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(path=path, pattern=pattern, split=str(split)).load()
