"""Text files that grow while they are read, as a stream of lines: register it and read the format ``growing_lines``.

    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").load("/logs")   # job_id, line_at, line

Offsets are bytes per file. A line belongs to the range of bytes that holds its line end, so a line still being written
comes when it is complete, and every line comes once, whatever the triggers. ``line_at`` is the byte where the
line begins: it orders a file's lines and never changes, and no line before it has to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PART_BYTES = 64 << 20  # of new text in one task
CHUNK_BYTES = 1 << 20


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class GrowingLines(DataSource):
    """Options: ``path`` (a folder, searched with its subfolders), ``suffix`` (default ``.log``), ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "job_id string, line_at bigint, line string"

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".log")
        self.part_bytes = int(options.get("partbytes", options.get("partBytes", PART_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Size of every file; the driver holds one number for each, and reads none."""
        store, root = _store(self.folder)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for path, size in sorted(end.items()):
            at = start.get(path, 0)
            if size < at:
                raise ValueError(f"{path} has shrunk from {at} to {size} bytes; only files that grow can be followed")
            parts += [Part(path, s, min(s + self.part_bytes, size)) for s in range(at, size, self.part_bytes)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        job = partition.path.rsplit("/", 1)[-1].removesuffix(self.suffix)
        with store.open_input_file(partition.path) as file:
            begin = _line_start(file, partition.start)
            file.seek(begin)
            rest, at = [], begin  # pieces of a line whose end is still to come
            position = begin
            while position < partition.end:
                chunk = file.read(min(CHUNK_BYTES, partition.end - position))
                if not chunk:
                    break
                position += len(chunk)
                *whole, last = chunk.split(b"\n")
                if not whole:
                    rest.append(last)
                    continue
                whole[0] = b"".join([*rest, whole[0]])
                starts, lines = [], []
                for line in whole:
                    starts.append(at)
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                rest = [last]
                yield pa.RecordBatch.from_arrays([pa.array([job] * len(lines)), pa.array(starts, pa.int64()), pa.array(lines)], ["job_id", "line_at", "line"])

    def commit(self, end: dict) -> None:
        pass


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line begins that byte ``at`` is in: behind the last line end before it."""
    while at > 0:
        low = max(0, at - CHUNK_BYTES)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0
