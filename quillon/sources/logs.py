"""Job logs as a data source: rolled zstd segments and the live file, read by byte offset and written in two phases.

    logs.lines(spark, folder, since=0)          a stream of complete lines with their byte offsets
    logs.roll(lines, folder, most_bytes)        stamped lines as segments, all of them or none

A log is a folder of archives `<start>-<end>.ndjson.zst` and `live.ndjson`, which begins where the last archive ends. Offsets
count the bytes of the whole log, so they stay true when the live file is rolled: a range of bytes is looked up in
whatever file holds it when it is read. A last line without its end is held back until its writer has finished it.
Folders may be on any file system that Arrow reaches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillon.session import on_workers

LIVE, STAGING = "live.ndjson", "_staging-"
_ARCHIVE = re.compile(r"(\d+)-(\d+)\.ndjson\.zst")
#: Bytes of a read, and lines of a batch.
BLOCK, BATCH = 1 << 20, 4096


@dataclass(frozen=True)
class Segment:
    """A file of a log, and the bytes of the log that it holds."""

    start: int
    end: int
    path: str
    packed: bool


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def segments(folder: str) -> list[Segment]:
    """The files of a log, oldest first. Two archives of one begin are one, written again."""
    system, path = opened(folder)
    files = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    found = {int(m[1]): Segment(int(m[1]), int(m[2]), f.path, True) for f in files if (m := _ARCHIVE.fullmatch(f.base_name))}
    out = [found[k] for k in sorted(found)]
    base = out[-1].end if out else 0
    return out + [Segment(base, base + f.size, f.path, False) for f in files if f.base_name == LIVE]


def complete_end(folder: str) -> int:
    """The offset after the last complete line of a log."""
    system, _ = opened(folder)
    files = segments(folder)
    if not files:
        return 0
    last = files[-1]
    if last.packed:
        return last.end
    with system.open_input_file(last.path) as f:
        end = min(f.size(), last.end - last.start)
        while end:
            begin = max(0, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return last.start + begin + at + 1
            end = begin
    return last.start


def read_lines(folder: str, start: int, end: int, known: Sequence[Segment] | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); whole lines, also where the last ends beyond.

    known: the archives that hold these bytes, if the caller has looked them up, which spares the list of the folder."""
    system, _ = opened(folder)
    for s in segments(folder) if known is None else known:
        low, high = max(start, s.start), min(end, s.end)
        if low >= high:
            continue
        behind = max(low - 1, s.start)  # the byte before tells whether a line begins at low
        if s.packed:
            stream = pa.CompressedInputStream(system.open_input_stream(s.path, compression=None), "zstd")
            skip = behind - s.start
            while skip:
                skip -= len(stream.read(min(skip, BLOCK)))
        else:
            stream = system.open_input_file(s.path)
            stream.seek(behind - s.start)
        with stream:
            at, rest = behind, b""
            drop = behind < low  # the line that the byte before low is in
            while at < high:
                block = stream.read(BLOCK)
                if not block:
                    break
                rest += block
                *whole, rest = rest.split(b"\n")
                for line in whole:
                    if not drop and low <= at < high:
                        yield at, line
                    drop = False
                    at += len(line) + 1


def append_live(folder: str, text: str) -> None:
    """Appends text to the live file of a log, as the job that owns it does: a part of a line counts once its end is there."""
    system, path = opened(folder)
    name = f"{path}/{LIVE}"
    before = b""
    if system.get_file_info(name).type == fs.FileType.File:
        with system.open_input_stream(name, compression=None) as f:
            before = f.read()  # a live file is rolled before it is large
    with system.open_output_stream(name, compression=None) as f:
        f.write(before + text.encode())


class Lines(InputPartition):
    """A range of bytes, with the archives that hold it; a range of the live file has none, for it may be rolled before it is read."""

    def __init__(self, start: int, end: int, known: tuple[Segment, ...] | None = None) -> None:
        super().__init__((start, end))
        self.start, self.end, self.known = start, end, known


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.since, self.size = int(options.get("since", "0")), int(options.get("partitionbytes", str(16 << 20)))

    def initialOffset(self) -> dict:
        return {"offset": self.since}

    def latestOffset(self) -> dict:
        return {"offset": max(self.since, complete_end(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        """Archives one after the other up to `size` bytes, each as a whole, for it is packed so; the live file in pieces."""
        out: list[Lines] = []
        held: list[Segment] = []
        for s in segments(self.folder):
            low, high = max(start["offset"], s.start), min(end["offset"], s.end)
            if low >= high:
                continue
            if held and (not s.packed or high - max(start["offset"], held[0].start) > self.size):
                out.append(Lines(max(start["offset"], held[0].start), held[-1].end, tuple(held)))
                held = []
            if s.packed:
                held.append(s)
            else:
                out += [Lines(k, min(k + self.size, high)) for k in range(low, high, self.size)]
        if held:
            out.append(Lines(max(start["offset"], held[0].start), min(end["offset"], held[-1].end), tuple(held)))
        return out or [Lines(0, 0, ())]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1].decode() for h in held], pa.string())], ["position", "value"])

        for line in read_lines(self.folder, partition.start, partition.end, partition.known):
            held.append(line)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is given up: a log is kept by its owner."""


@dataclass
class Written(WriterCommitMessage):
    """Segments that a task has staged: where they are, and their names."""

    files: list[tuple[str, str]]
    end: int


class SegmentWriter(DataSourceArrowWriter):
    """Writes lines sorted by (segment, offset) as staged files; they get their names when all tasks have ended.

    A task that is tried again stages files of its own; those of the try that failed are never named, and go with the
    staging folder. So readers, who look for names, see all segments of a write or none that was not committed.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.staging = options["path"], STAGING + uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.folder)
        system.create_dir(f"{path}/{self.staging}", recursive=True)
        files: list[tuple[str, str]] = []
        now, out, start, end, name = None, None, 0, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                files.append((name, f"{start:020d}-{end:020d}.ndjson.zst"))

        for batch in iterator:
            for segment, offset, line in zip(*(batch.column(c).to_pylist() for c in ("segment", "offset", "line")), strict=True):
                if segment != now or out is None:
                    close()
                    now, start, end, name = segment, offset, offset, f"{self.staging}/{uuid.uuid4().hex}"
                    out = pa.CompressedOutputStream(system.open_output_stream(f"{path}/{name}", compression=None), "zstd")
                data = f"{line}\n".encode()
                out.write(data)
                end += len(data)
        close()
        return Written(files, end)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        for m in messages:
            for staged, name in m.files if m else []:
                system.move(f"{path}/{staged}", f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_log"

    def schema(self) -> str:
        return "position long, value string"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    on_workers(spark)
    spark.dataSource.register(LogSource)
    return spark


def lines(spark: SparkSession, folder: str, since: int = 0, partition_bytes: int = 16 << 20) -> DataFrame:
    """The complete lines of a log from a byte offset on, as a stream: position (where a line begins), value."""
    return _registered(spark).readStream.format("job_log").option("since", since).option("partitionbytes", partition_bytes).load(folder)


def roll(stamped: DataFrame, folder: str, most_bytes: int = 4 << 20) -> int:
    """Writes stamped lines (offset, line) as zstd segments; returns the offset after the last line, 0 for none.

    A segment holds the lines that begin within most_bytes. Segments are dealt to tasks, and a task holds one line at a time.
    A write that fails leaves no segment that a reader would see.
    """
    _registered(stamped.sparkSession)
    cut = stamped.select(F.floor(F.col("offset") / most_bytes).cast("long").alias("segment"), F.col("offset").cast("long").alias("offset"), "line")
    cut = cut.repartition("segment").sortWithinPartitions("segment", "offset")
    cut.write.format("job_log").mode("append").save(folder)
    return max((s.end for s in segments(folder) if s.packed), default=0)
