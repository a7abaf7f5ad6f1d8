"""Raw scenes as Spark formats: spark.read.format("houses").load(path), and the same for readers of one's own.

The path may be a folder, a file or a glob in any store that pyarrow.fs knows. There is a
partition a file, and a plain file is split by bytes as well: a split begins after the
first line end past its start. Lines are read as they come, a batch at a time.
"""

from __future__ import annotations

import fnmatch
import gzip
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a plain file that one task reads, and lines of a batch.
SPLIT, LINES = 64 << 20, 1024


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder, or those that a path's last part matches."""
    where, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.File:
        return where, [info]
    folder, pattern = (inside, "*") if info.type == fs.FileType.Directory else posixpath.split(inside)
    found = [f for f in where.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return where, sorted(found, key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    """Bytes of a file from start on (end: None for all of a gzipped one), and how many lines stand before them."""

    path: str
    start: int
    end: int | None
    line: int

    def __post_init__(self) -> None:
        self.value = (self.path, self.start)


class HouseReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.size = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        where, files = _files(self.root)
        out = []
        for f in files:
            if f.path.endswith(".gz"):
                out.append(Split(f.path, 0, None, 0))
                continue
            at, line = 0, 0
            while at < f.size or not at:
                end = min(f.size, at + self.size)
                out.append(Split(f.path, at, end, line))
                line += _lines_begun(where, f.path, at, end) if end < f.size else 0
                at = end
                if not f.size:
                    break
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        where = _files(self.root)[0]
        stem = unquote(posixpath.basename(partition.path)).removesuffix(".gz").removesuffix(".jsonl")
        ids, values, number = [], [], partition.line
        with where.open_input_stream(partition.path, compression=None) if partition.end is None else where.open_input_file(partition.path) as raw:
            for line in _lines(raw, partition):
                ids.append(f"{stem}:{number}")
                values.append(line)
                number += 1
                if len(ids) == LINES:
                    yield _batch(ids, values)
                    ids, values = [], []
        if ids:
            yield _batch(ids, values)


def _batch(ids: list[str], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.decode(errors="replace") for v in values], pa.string())], names=["scene_id", "value"])


def _lines_begun(where: fs.FileSystem, path: str, start: int, end: int) -> int:
    """Lines that begin in a range of bytes; a line begins after a line end, the first one at 0."""
    n = int(start == 0)
    with where.open_input_file(path) as f:
        f.seek(max(0, start - 1))
        left = end - 1 - max(0, start - 1)
        while left > 0 and (part := f.read(min(left, 1 << 20))):
            n += part.count(b"\n")
            left -= len(part)
    return n


def _lines(raw: pa.NativeFile, split: Split) -> Iterator[bytes]:
    """The lines that begin in a split."""
    if split.end is None:
        for line in gzip.GzipFile(fileobj=raw):
            yield line.rstrip(b"\r\n")
        return
    at = max(0, split.start - 1)
    raw.seek(at)
    rest, skip = b"", split.start > 0
    while part := raw.read(1 << 20):
        pieces = (rest + part).split(b"\n")
        for piece in pieces[:-1]:
            if skip:
                skip = False
            elif at < split.end:
                yield piece.rstrip(b"\r")
            at += len(piece) + 1
            if at >= split.end:
                return
        rest = pieces[-1]
    if rest and not skip and at < split.end:
        yield rest.rstrip(b"\r")


class HouseSource(DataSource):
    """Format "houses": (scene_id, value), a house record a line; options path and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "houses"

    def schema(self) -> str:
        return "scene_id string, value string"

    def reader(self, schema) -> HouseReader:
        return HouseReader(dict(self.options))


#: Formats by name; add one's own DataSource.
FORMATS: list[type[DataSource]] = [HouseSource]


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in FORMATS:
        spark.dataSource.register(source)
