"""Growing log files, read from where the last read ended (data source ``log_tail``).

A line belongs to the byte range its line feed lies in; its beginning is found by looking backwards from the
range. So any cut of a file into ranges gives every complete line once, a half-written last line waits until its line
feed comes, and the size of a file at the last listing is all a cursor has to hold.

As a batch source it reads all files below a folder, as a stream what was added since the last batch: a file that
became shorter is read again from its start, a compressed one (a snapshot) whenever it changed. Only files of the
wanted suffix are opened. The offset of a stream has path, size and time of change of every file, so it grows with
the number of files.
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

from usagelens import fixed
from usagelens.sources.files import drop_sync_conflicts, new_or_changed_files

SCHEMA = "path string, tool string, block long, pos long, after long, value string"
WANTED = r"(?i)\.jsonl(\.(zst|zstd))?$"
COMPRESSED = re.compile(r"(?i)\.(zst|zstd)$")
#: bytes of a file that one task reads
SPLIT_BYTES = 64 << 20
#: bytes that are held at once
BLOCK_BYTES = 4 << 20

_ARROW = pa.schema(
    [("path", pa.string()), ("tool", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("after", pa.int64()), ("value", pa.string())]
)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_logs(folder: str, wanted: str = WANTED) -> dict[str, list[int]]:
    """Size and time of change (ms) of every wanted file below a folder; copies of file synchronisers are left out."""
    system, root = _opened(folder)
    entries = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {
        e.path: [e.size, (e.mtime_ns or 0) // 1_000_000]
        for e in entries
        if e.type == fs.FileType.File and re.search(wanted, e.path) and not re.search(fixed.SYNC_CONFLICT_PATTERN, e.path)
    }


@dataclass
class Span(InputPartition):
    """The bytes of a file in which the line feeds of the wanted lines lie."""

    path: str
    start: int
    stop: int


def spans(path: str, start: int, stop: int, split: int = SPLIT_BYTES) -> list[Span]:
    """Cuts of a file's new bytes; a compressed file is one span."""
    if COMPRESSED.search(path):
        return [Span(path, 0, stop)]
    return [Span(path, at, min(at + split, stop)) for at in range(start, stop, split)]


def new_spans(old: dict[str, list[int]], now: dict[str, list[int]], split: int = SPLIT_BYTES) -> list[Span]:
    """What has to be read after ``old`` to know ``now``; both map paths to size and time of change."""
    found = []
    for path, (size, changed) in sorted(now.items()):
        before = old.get(path)
        if COMPRESSED.search(path):
            found += spans(path, 0, size) if before != [size, changed] else []
        else:
            start = before[0] if before and before[0] <= size else 0
            found += spans(path, start, size, split)
    return found


def _line_start(file: pa.NativeFile, at: int) -> int:
    """Beginning of the line that byte ``at`` belongs to, looking backwards."""
    while at > 0:
        low = max(0, at - BLOCK_BYTES // 64)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def _complete(blocks: Iterator[bytes], start: int, rest: list | None = None) -> Iterator[list[tuple[int, bytes]]]:
    """(position, line) of complete lines, block by block; what follows the last line feed goes to ``rest``."""
    held, at = [], start
    for block in blocks:
        cut = block.rfind(b"\n")
        if cut < 0:
            held.append(block)
            continue
        lines, found = b"".join([*held, block[:cut]]).split(b"\n"), []
        for line in lines:
            found.append((at, line))
            at += len(line) + 1
        held = [block[cut + 1 :]]
        yield found
    if rest is not None:
        rest.append((at, b"".join(held)))


def _blocks(file, length: int | None = None) -> Iterator[bytes]:
    left = length
    while left is None or left > 0:
        block = file.read(BLOCK_BYTES if left is None else min(BLOCK_BYTES, left))
        if not block:
            return
        left = None if left is None else left - len(block)
        yield block


def read_span(span: Span, tool: str) -> Iterator[pa.RecordBatch]:
    """The lines of a span with their positions. A file that is gone by now has none."""
    system, path = _opened(span.path)
    try:
        file = system.open_input_file(path)
    except FileNotFoundError:
        return
    with file:
        if COMPRESSED.search(path):
            import zstandard

            rest: list[tuple[int, bytes]] = []
            with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as text:
                for lines in _complete(_blocks(text), 0, rest):
                    yield _rows(span, tool, lines)
            # a snapshot is not continued: its last line may do without a line feed
            yield _rows(span, tool, [line for line in rest if line[1].rstrip().endswith(b"}")])
            return
        start = _line_start(file, span.start)
        file.seek(start)
        for lines in _complete(_blocks(file, span.stop - start), start):
            yield _rows(span, tool, lines)


def _rows(span: Span, tool: str, lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(lines)
    text = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line in lines]
    columns = [
        pa.array([span.path] * n, pa.string()),
        pa.array([tool] * n, pa.string()),
        pa.array([span.start] * n, pa.int64()),
        pa.array([at for at, _ in lines], pa.int64()),
        pa.array([at + len(line) + 1 for at, line in lines], pa.int64()),
        pa.array(text, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Reader:
    def __init__(self, options: dict) -> None:
        self.folder, self.tool = options["path"], options["tool"]
        self.wanted = options.get("wanted", WANTED)
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.version = int(options.get("version", 0))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from read_span(partition, self.tool)


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Span]:
        return new_spans({}, list_logs(self.folder, self.wanted), self.split)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets hold the normaliser's version too: after a new one everything is read again."""

    def initialOffset(self) -> dict:  # noqa: N802 - the data source interface
        return {"version": self.version, "files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": self.version, "files": list_logs(self.folder, self.wanted)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return new_spans(start["files"] if start["version"] == end["version"] else {}, end["files"], self.split)


class LogTail(DataSource):
    """Options: path (a folder), tool, and split_bytes, wanted (suffix pattern) and version where needed."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def read_tail(spark: SparkSession, folder: str, tool: str, **options: str) -> DataFrame:
    """All complete lines below a folder as (path, tool, block, pos, after, value)."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").options(tool=tool, **options).load(folder)


def stream_tail(spark: SparkSession, folder: str, tool: str, **options: str) -> DataFrame:
    """The lines that are added below a folder, as a stream of the same columns."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(tool=tool, **options).load(folder)


def read_changed(files: DataFrame, ledger: DataFrame, version: int, whole: bool = False, split: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the files that are new or changed since ``ledger`` (path, size, mtime_ms, version), from their cursors.

    Files that became shorter, that an older normaliser read or that are compressed are read from their start, and
    with ``whole`` all changed ones. The spans are rows, dealt to tasks; nothing of an unchanged file is opened.
    """
    known = ledger.select("path", F.col("size").alias("read"), F.col("version").alias("read_by"))
    changed = new_or_changed_files(drop_sync_conflicts(files), ledger, version).join(known, "path", "left")
    packed = F.col("path").rlike(COMPRESSED.pattern)
    again = F.col("restart") | packed | F.lit(whole) | (F.coalesce("read_by", F.lit(version)) != version)
    start = F.when(again, 0).otherwise(F.coalesce("read", F.lit(0)))
    step = F.when(packed, F.greatest("size", F.lit(1))).otherwise(split)
    cuts = changed.select("path", "tool", "size", start.cast("long").alias("start"), step.cast("long").alias("step")).filter("size > start")
    dealt = cuts.select(
        "path", "tool", "size", "step", F.explode(F.sequence("start", F.col("size") - 1, "step")).alias("start")
    ).select("path", "tool", "start", F.least("size", F.col("start") + F.col("step")).alias("stop"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for lines in read_span(Span(row["path"], row["start"], row["stop"]), row["tool"]):
                    yield lines

    return dealt.repartition(F.col("path"), F.col("start")).mapInArrow(read, SCHEMA)
