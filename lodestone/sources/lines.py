"""Logs of lines as a data source of their own: files are cut by byte ranges, each read once, and a line's place is its offset.

A range holds the lines that begin in it, so every line is read by one task, whatever the ranges. Lines are numbered by their
byte: `seq` is the offset in the concatenation of all files, in order of the given paths and of names, which takes no counting.
A line over the limit is an error that names the file and the place. As a stream, a batch takes the lines that have ended since the
one before; a line without its end waits."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "lodestone_lines"
SCHEMA = "seq long, file string, at long, value string"
_ARROW = pa.schema([("seq", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])

SPLIT_BYTES = 64 << 20  # of a range
MOST_BYTES = 64 << 20  # of a line
_CHUNK = 1 << 20
_ROWS = 10_000
_BATCH_BYTES = 8 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `start` or later and before `end`; `base`: the bytes of all files before it."""

    file: str
    start: int
    end: int
    base: int = 0


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """The files of each path, by name, with their sizes. Names that begin with a dot or an underscore are no logs."""
    out = []
    for path in paths:
        fs, place = _opened(path)
        scheme = path.partition("://")[0] + "://" if "://" in path else ""
        info = fs.get_file_info(place)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if f.is_file and not any(p[:1] in "._" for p in f.path[len(place) :].strip("/").split("/"))]
        out += [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: f.path)]
    return out


def _chunks(file: pa.NativeFile, at: int) -> Iterator[bytes]:
    file.seek(at)
    while data := file.read(_CHUNK):
        yield data


def lines_of(r: Range, most: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range."""
    fs, place = _opened(r.file)
    with fs.open_input_file(place) as file:
        # From the byte before the range on, the first line end shows where its first line begins.
        at, held, skipping = max(r.start - 1, 0), b"", r.start > 0
        for data in _chunks(file, at):
            held += data
            parts = held.split(b"\n")
            held = parts.pop()
            for line in parts:
                if not skipping:
                    if at >= r.end:
                        return
                    _check(r.file, at, len(line), most)
                    yield at, line
                skipping, at = False, at + len(line) + 1
            if skipping:  # the rest of a line of another range need not be kept
                at, held = at + len(held), b""
                if at >= r.end:
                    return
            elif at >= r.end:
                return
            else:
                _check(r.file, at, len(held), most)
        if held and not skipping and at < r.end:
            yield at, held


def _check(file: str, at: int, size: int, most: int) -> None:
    if size > most:
        raise ValueError(f"{file}: the line at byte {at} is longer than {most} bytes")


def _batches(r: Range, most: int) -> Iterator[pa.RecordBatch]:
    places, values, size = [], [], 0
    for at, line in lines_of(r, most):
        if not line.strip():
            continue
        places.append(at)
        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
        size += len(line)
        if len(places) == _ROWS or size > _BATCH_BYTES:
            yield _batch(r, places, values)
            places, values, size = [], [], 0
    if places:
        yield _batch(r, places, values)


def _batch(r: Range, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.base + at for at in places], pa.int64()), pa.array([r.file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], schema=_ARROW)


class _Options:
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.most = int(options.get("mostBytes", MOST_BYTES))

    def cut(self, file: str, start: int, end: int, base: int) -> list[Range]:
        return [Range(file, at, min(at + self.split, end), base) for at in range(start, end, self.split)]


class LineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for file, size in listed(self.options.paths):
            out += self.options.cut(file, 0, size, base)
            base += size + 1
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.most) if partition.file else iter(())


class LineStreamReader(DataSourceStreamReader):
    """Offsets are the ends of the last whole lines of each file."""

    def __init__(self, options: dict) -> None:
        self.options = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {file: end for file, size in listed(self.options.paths) if (end := self._whole(file, size))}

    def _whole(self, file: str, size: int) -> int:
        fs, place = _opened(file)
        with fs.open_input_file(place) as f:
            at = size
            while at:
                start = max(0, at - _CHUNK)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                if size - start > self.options.most:
                    _check(file, start, size - start, self.options.most)
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, size in sorted(end.items()) for r in self.options.cut(file, start.get(file, 0), size, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.most)

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:  # noqa: ANN001
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStreamReader:  # noqa: ANN001, N802
        return LineStreamReader(self.options)


def _set(reader, paths: str | list[str], split_bytes: int, most_bytes: int):
    whole = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return reader.format(NAME).option("paths", whole).option("splitBytes", str(split_bytes)).option("mostBytes", str(most_bytes))


def read_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(seq, value): the lines of logs, files or folders, without blank ones. seq follows the order of paths, names and lines."""
    spark.dataSource.register(LineSource)
    return _set(spark.read, paths, split_bytes, most_bytes).load().select("seq", "value")


def stream_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, at, value): the lines of growing logs as a stream, each once its line end is there."""
    spark.dataSource.register(LineSource)
    return _set(spark.readStream, paths, split_bytes, most_bytes).load().select("file", "at", "value")
