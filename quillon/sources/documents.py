"""One large JSON document as many splits: an object of lists, read from blocks of bytes and written as a folder of parts.

A document is a file, or a folder whose files, in the order of their names, are its text one after the other. Where an element of a list
begins follows from what is before it: whether a string is open, and how many brackets. A block of bytes is a function of these two, for either
answer to the first; so blocks are scanned side by side, a running count over blocks (one row each) tells each its begin, and then each block reads the
elements that begin in it, the last one to its end. No task holds more than a block and an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import schemas
from quillon.session import on_workers, scratch
from quillon.sources.logs import opened

#: Bytes of a block, bytes before a list in which its name is looked for, and bytes read at once behind a block.
BLOCK, BACK, MORE = 4 << 20, 4096, 1 << 16
#: Blocks that a task reads, about, one after the other; and elements that a task sorts at most, about, where a document is written.
TASK, ROWS = 4, 250_000
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
_QUOTE, _ESCAPE = 0x22, 0x5C


class Text:
    """The bytes of a document over its files."""

    def __init__(self, path: str) -> None:
        self.system, inner = opened(path)
        info = self.system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else self.system.get_file_info(fs.FileSelector(inner))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        ends = np.cumsum([f.size for f in files]).tolist()
        self.files = [(end - f.size, end, f.path) for f, end in zip(files, ends, strict=True)]
        self.size = ends[-1] if ends else 0

    def read(self, begin: int, end: int) -> bytes:
        out = []
        for low, high, path in self.files:
            a, b = max(begin, low), min(end, high)
            if a < b:
                with self.system.open_input_file(path) as f:
                    out.append(f.read_at(b - a, a - low))
        return b"".join(out)

    def escaped_at(self, at: int) -> bool:
        """Whether the byte at a place comes after an odd number of backslashes."""
        run = 0
        while at and self.read(at - 1, at) == b"\\":
            at, run = at - 1, run + 1
        return run % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that open or close a string; escaped tells of the first byte."""
    plain = np.where(data != _ESCAPE, np.arange(len(data)), -1)
    before = np.r_[-1, np.maximum.accumulate(plain)[:-1]]  # the last byte before that is no backslash
    run = np.arange(len(data)) - 1 - before + np.where(before < 0, int(escaped), 0)
    return (data == _QUOTE) & (run % 2 == 0)


def _brackets(data: np.ndarray) -> np.ndarray:
    return np.isin(data, (0x7B, 0x5B)).astype(np.int64) - np.isin(data, (0x7D, 0x5D))


def scanned(text: Text, begin: int, end: int) -> tuple[int, int, int]:
    """What a block does: whether it changes from inside to outside of a string (1 or 0), and by how much it changes the number of open
    brackets if it begins outside of a string, and if inside."""
    data = np.frombuffer(text.read(begin, end), np.uint8)
    quotes = _quotes(data, text.escaped_at(begin))
    odd, step = (np.cumsum(quotes) - quotes) % 2 == 1, _brackets(data)
    return int(quotes.sum()) % 2, int(step[~odd].sum()), int(step[odd].sum())


def _levels(data: np.ndarray, escaped: bool, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each byte the brackets that are open before it and its own step (0 inside of strings); and whether the last leaves a string open."""
    quotes = _quotes(data, escaped)
    step = np.where((np.cumsum(quotes) - quotes + inside) % 2 == 0, _brackets(data), 0)
    return depth + np.cumsum(step) - step, step, (inside + int(quotes.sum())) % 2


def borders_in(text: Text, begin: int, end: int, inside: int, depth: int) -> list[tuple[int, str | None]]:
    """Where lists of the outermost object begin in a block, with their names, and where they end, with none."""
    data = np.frombuffer(text.read(begin, end), np.uint8)
    before, step, _ = _levels(data, text.escaped_at(begin), inside, depth)
    starts = (np.flatnonzero((before == 1) & (step == 1) & (data == 0x5B)) + begin).tolist()
    ends = (np.flatnonzero((before == 2) & (step == -1) & (data == 0x5D)) + begin).tolist()
    return [(p, m[1].decode()) for p in starts if (m := _NAME.search(text.read(max(0, p - BACK), p)))] + [(p, None) for p in ends]


def elements_in(text: Text, begin: int, end: int, inside: int, depth: int) -> Iterator[tuple[int, str]]:
    """Where elements (objects) of such lists begin in a block, and their text."""
    raw = text.read(begin, end)
    data = np.frombuffer(raw, np.uint8)
    before, step, inside = _levels(data, text.escaped_at(begin), inside, depth)
    starts = np.flatnonzero((before == 2) & (step == 1) & (data == 0x7B))
    ends = np.flatnonzero((before == 3) & (step == -1) & (data == 0x7D))
    ends = ends[np.searchsorted(ends, starts[0]) :] if len(starts) else ends[:0]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=False):
        yield begin + a, raw[a : b + 1].decode()
    if len(starts) > len(ends):  # the last one goes on behind the block
        held, at, depth = [raw[int(starts[-1]) :]], end, int(before[-1] + step[-1])
        while at < text.size:
            more = text.read(at, min(at + MORE, text.size))
            level, own, inside = _levels(np.frombuffer(more, np.uint8), text.escaped_at(at), inside, depth)
            closed = np.flatnonzero((level == 3) & (own == -1))
            if len(closed):
                held.append(more[: int(closed[0]) + 1])
                break
            held.append(more)
            depth, at = int(level[-1] + own[-1]), at + len(more)
        yield begin + int(starts[-1]), b"".join(held).decode()


def elements(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The elements of all lists of a document: list (its name), position (where the element begins), value (its text)."""
    on_workers(spark)
    size = Text(path).size
    count = -(-size // block)
    tasks = max(1, -(-count // TASK))
    blocks = spark.range(0, count, 1, tasks).select((F.col("id") * block).alias("begin"), F.least((F.col("id") + 1) * block, F.lit(size)).alias("end"))

    def each(work: object, names: list[str], types: list[pa.DataType]) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text = Text(path)
            for batch in batches:
                for row in batch.to_pylist():
                    out = list(work(text, row))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return run

    number, word = pa.int64(), pa.string()
    effect = lambda text, r: [(r["begin"], r["end"], *scanned(text, r["begin"], r["end"]))]
    done = blocks.mapInArrow(each(effect, ["begin", "end", "flips", "outside", "inside"], [number] * 5), "begin long, end long, flips long, outside long, inside long")
    ahead = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    state = done.withColumn("in", F.coalesce(F.sum("flips").over(ahead), F.lit(0)) % 2)
    state = state.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in") == 0, F.col("outside")).otherwise(F.col("inside"))).over(ahead), F.lit(0))).select("begin", "end", "in", "depth")
    state = state.repartition(tasks, "begin")  # the running count leaves all blocks to one task
    named = lambda text, r: borders_in(text, r["begin"], r["end"], r["in"], r["depth"])
    found = lambda text, r: elements_in(text, r["begin"], r["end"], r["in"], r["depth"])
    lists = state.mapInArrow(each(named, ["position", "list"], [number, word]), "position long, list string")
    ranges = lists.withColumn("upto", F.lead("position").over(Window.orderBy("position"))).where("list is not null")  # the lists of one object
    rows = state.mapInArrow(each(found, ["position", "value"], [number, word]), "position long, value string")
    lists_held = F.broadcast(ranges.withColumnRenamed("position", "_from"))  # a row for each list of the outermost object
    return rows.join(lists_held, (F.col("position") > F.col("_from")) & (F.col("position") < F.col("upto"))).select("list", "position", "value")


def records(spark: SparkSession, path: str, kind: str, block: int = BLOCK) -> DataFrame:
    """One of a profile's lists (summaries, windows, kernels, memcpys, activities) as rows; ordinal is the place in the document."""
    kinds = {"summaries": ("region_summary", schemas.REGION_SUMMARY), "kernels": ("kernel", schemas.KERNEL), "memcpys": ("memcpy", schemas.MEMCPY), "activities": ("activity", schemas.ACTIVITY), "windows": ("", schemas.WINDOW)}
    name, schema = kinds[kind]
    rows = elements(spark, path, block).where(F.col("list") == kind).select(F.col("position").alias("ordinal"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("ordinal", "_r.*")
    return schemas.with_defaults(rows, name) if name else rows


def profile_lines(device: str, host: str, **lists: DataFrame) -> DataFrame:
    """A profile document as lines of text (value) in order, for write.text(): the files of the folder are the document one after the other.

    Lists are sorted by ranges of `ordinal`, as many as their elements need, so that no task holds a list; what is written follows the order of
    partitions. The first element of a list is told by its ordinal, which no other has.
    """
    spark = next(iter(lists.values())).sparkSession
    one = spark.range(0, 1, 1, 1)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit(host).alias("host"), F.lit(device).alias("device"))), "\\}$", "")
    sections: list[DataFrame] = []

    def add(rows: DataFrame, value: Column) -> None:
        sections.append(rows.select(value.alias("value")))

    add(one, head)
    for kind, rows in lists.items():
        body = rows.select("ordinal", F.to_json(F.struct(*[c for c in rows.columns if c not in ("ordinal", "path")])).alias("value"))
        folder = scratch(spark)
        body.agg(F.min("ordinal").alias("_first"), F.count("*").alias("_count")).write.parquet(folder)
        known = spark.read.parquet(folder)  # one row
        needed = -(-known.first()["_count"] // ROWS)
        ranges = (needed, "ordinal") if needed > usual else ("ordinal",)
        comma = F.when(F.col("ordinal") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
        add(one, F.lit(f',"{kind}":['))
        add(body.crossJoin(F.broadcast(known.select("_first"))).repartitionByRange(*ranges).sortWithinPartitions("ordinal"), F.concat(comma, "value"))
        add(one, F.lit("]"))
    add(one, F.lit("}"))
    return reduce(DataFrame.unionByName, sections)
