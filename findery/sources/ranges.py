"""Text files read by planned byte ranges.

Spark's own text scan cuts files into splits that depend on the size of the cluster, so a second scan may cut
elsewhere. Here the ranges follow from file sizes and one parameter alone: any number of scans agree on the
place of every line, nothing has to be stored between them, and a lost task reads its range again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a planned range.
RANGE_BYTES = 64 << 20
#: Bytes read at once.
READ_BYTES = 4 << 20
SCHEMA = "path string, block long, seq long, offset long, n_bytes long, value string"
#: Endings of files that are read as a whole.
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


@dataclass(frozen=True)
class Range(InputPartition):
    """Lines that begin in ``length`` bytes from ``start`` on; a negative length reads to the end."""

    path: str
    start: int
    length: int


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path and the path inside it; raises where Arrow knows none for the scheme."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:"):]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def readable(path: str) -> bool:
    """Whether tasks can open files of this store themselves."""
    try:
        store, inside = file_system(path)
        return store.get_file_info(inside).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, by path; names with _ or . in front are hidden, as for Spark."""
    store, inside = file_system(path)
    top = store.get_file_info(inside)
    if top.type == fs.FileType.File:
        return [(top.path, top.size)]
    files = store.get_file_info(fs.FileSelector(inside, recursive=True))
    shown = []
    for f in files:
        below = f.path[len(inside):].strip("/").split("/")
        hidden = any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in below)
        if f.type == fs.FileType.File and f.size and not hidden:
            shown.append((f.path, f.size))
    return sorted(shown)


def planned(files: list[tuple[str, int]], range_bytes: int) -> list[Range]:
    out = []
    for path, size in files:
        if os.path.splitext(path)[1] in PACKED:
            out.append(Range(path, 0, -1))
        else:
            out += [Range(path, start, range_bytes) for start in range(0, size, range_bytes)]
    return out


def lines_of(stream, start: int, length: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(offset of the first, lines) in order: all lines whose first byte lies in the range."""
    at, skipping = (start - 1, True) if start else (0, False)  # the line before ends at or behind start - 1
    if at:
        stream.seek(at)
    end, held = (start + length if length >= 0 else None), []
    while end is None or skipping or at < end:
        data = stream.read(read_bytes)
        cut = data.rfind(b"\n")
        if data and cut < 0:
            held.append(data)
            continue
        whole = b"".join(held) + (data[:cut] if data else b"")
        lines = whole.split(b"\n") if data or held else []
        held = [data[cut + 1:]] if data[cut + 1:] else []
        if lines and skipping:
            at, skipping = at + len(lines.pop(0)) + 1, False
        if lines:
            offsets = at + np.cumsum([0] + [len(x) + 1 for x in lines])
            keep = len(lines) if end is None else int(np.searchsorted(offsets[:-1], end, "left"))
            if keep:
                yield at, lines[:keep]
            at = int(offsets[-1])
        if not data:
            return


class TextRanges(DataSource):
    """Lines with their path, range (``block``), number in it (``seq``), byte offset and bytes with line end.

    Option ``rangeBytes`` is the size of a range. Files must not change while scans of them are compared.
    """

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        return planned(listed(self.path), self.range_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = file_system(self.path)
        packing = PACKED.get(os.path.splitext(partition.path)[1])
        opened = store.open_input_stream(partition.path, compression=packing) if packing else store.open_input_file(partition.path)
        with opened as stream:
            seq = 0
            for first, lines in lines_of(stream, partition.start, partition.length):
                sizes = np.array([len(x) + 1 for x in lines], np.int64)
                n = len(lines)
                try:
                    value = pa.array(lines, pa.binary()).cast(pa.string())
                except pa.ArrowInvalid:  # not UTF-8
                    value = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n, pa.string()), pa.array(np.full(n, partition.start)), pa.array(seq + np.arange(n)),
                     pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes), value],
                    names=["path", "block", "seq", "offset", "n_bytes", "value"])
                seq += n


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(TextRanges)
    return spark.read.format("text_ranges").option("rangeBytes", range_bytes).load(path)
