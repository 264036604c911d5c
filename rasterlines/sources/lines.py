"""Lines of bounded length, in batches and as a stream.

``spark.read.format("bounded_lines").option("max_bytes", n).load(path)`` gives path,
start (offset of the line in its file), value (bytes) and too_large.  Files are cut
by byte ranges of ``split_bytes``; a line belongs to the range in which it begins.
A line of more than ``max_bytes`` is read past in pieces and flagged, its value
null, so no line takes more memory than that.  One carriage return before the
line feed goes; what a file ends with without a line feed is a line as it is.
Files whose names begin with ``_`` or ``.`` are left out, as elsewhere in Spark.

As a stream, each file is read once, when it is first seen: it has to be whole by then.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start bigint, value binary, too_large boolean"
_PIECE = 1 << 18
_BATCH_BYTES, _BATCH_ROWS = 1 << 22, 1 << 14


# Bytes of a task at most that takes several ranges, and tasks that a read is dealt to about.
_TASK_BYTES, _TASKS = 1 << 27, 256


class Splits(InputPartition):
    """Byte ranges that one task reads, one after the other."""

    def __init__(self, splits: list):
        self.splits = splits


class Split(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def lines_of(stream, start: int, end: int, most: int, piece: int = _PIECE) -> Iterator[tuple[int, bytes | None, bool]]:
    """(start, value, too_large) of the lines that begin in [start, end) of a seekable stream."""
    # The byte before tells whether a line begins at the start.
    at = max(start - 1, 0)
    stream.seek(at)
    inside, begin, kept, large = start == 0, start, bytearray(), False
    while begin < end:
        block = stream.read(piece)
        if not block:
            if inside and at > begin:
                yield begin, None if large else bytes(kept), large
            return
        k = 0
        while True:
            n = block.find(b"\n", k)
            stop = len(block) if n < 0 else n
            if inside and not large:
                if len(kept) + stop - k > most:
                    large = True
                    kept.clear()
                else:
                    kept += block[k:stop]
            if n < 0:
                break
            if inside:
                yield begin, None if large else bytes(kept[:-1] if kept.endswith(b"\r") else kept), large
                kept.clear()
                large = False
            inside, begin, k = True, at + n + 1, n + 1
            if begin >= end:
                return
        at += len(block)
        if not inside and at >= end:  # one line lies over the whole range
            return


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Files:
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("max_bytes", 1 << 20))
        self.size = int(options.get("split_bytes", 1 << 27))
        if self.most < 0 or self.size < 1:
            raise ValueError("max_bytes must be 0 or more and split_bytes 1 or more")

    def found(self) -> dict[str, int]:
        """Sizes of the files at or below the path."""
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        every = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in ("_", ".") for x in posixpath.relpath(p, root).split("/")) and p != root
        return {f.path: f.size for f in every if f.is_file and not hidden(f.path)}

    def splits(self, files: dict[str, int]) -> list[Split]:
        return [Split(p, a, min(a + self.size, n)) for p, n in sorted(files.items()) for a in range(0, n, self.size)]

    def tasks(self, files: dict[str, int]) -> list[Splits]:
        """The ranges, dealt to tasks: small ranges share one, so that their number doesn't grow with the input."""
        most = min(_TASK_BYTES, sum(files.values()) // _TASKS)
        groups, size = [], 0
        for split in self.splits(files):
            if not groups or size + split.end - split.start > most:
                groups.append([])
                size = 0
            groups[-1].append(split)
            size += split.end - split.start
        return [Splits(g) for g in groups]

    def read_all(self, task: Splits) -> Iterator[pa.RecordBatch]:
        for split in task.splits:
            yield from self.read(split)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        with system.open_input_file(split.path) as stream:
            rows, size = [], 0
            for row in lines_of(stream, split.start, split.end, self.most):
                rows.append(row)
                size += len(row[1] or b"")
                if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield self._batch(split.path, rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(split.path, rows)

    @staticmethod
    def _batch(path: str, rows: list) -> pa.RecordBatch:
        start, value, large = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(start, pa.int64()), pa.array(value, pa.binary()), pa.array(large)], ["path", "start", "value", "too_large"])


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.files = _Files(options)

    def partitions(self):
        return self.files.tasks(self.files.found()) or [Splits([])]

    def read(self, partition):
        yield from self.files.read_all(partition)


class LinesStreamReader(DataSourceStreamReader):
    """Offsets are the files seen so far, with their sizes."""

    def __init__(self, options):
        self.files = _Files(options)

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return self.files.found()

    def partitions(self, start, end):
        return self.files.tasks({p: n for p, n in end.items() if p not in start})

    def read(self, partition):
        yield from self.files.read_all(partition)


class BoundedLines(DataSource):
    @classmethod
    def name(cls):
        return "bounded_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LinesReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return LinesStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoundedLines)
