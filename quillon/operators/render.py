"""Presentation as data: flat rows, field/value pairs, tab-separated text, trace documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quillon.functions import exact

PROCESS, REGIONS, KERNELS, COPIES, ACTIVITIES = 0, 0, 1, 2, 3
TRACKS = {REGIONS: "regions", KERNELS: "GPU kernels", COPIES: "GPU memcpy", ACTIVITIES: "CUDA API & activity"}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns folded into JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema])


def projected(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The listed columns that exist, in the order of the list; all without a list."""
    return df.select(*[f for f in fields if f in df.columns]) if fields is not None else df


def pairs(df: DataFrame, keys: list[str], fields: Sequence[str] | None = None) -> DataFrame:
    """One row per field: keys, field, value (as text)."""
    chosen = [f for f in (fields or [c for c in df.columns if c not in keys]) if f in df.columns]
    return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in chosen]).unpivot(keys, chosen, "field", "value")


def encode(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Lines of tab-separated cells as `value`; cells that hold a tab or line end, or begin with a quote, are quoted as JSON."""
    rows = projected(df, fields)
    return rows.select(F.array_join(F.array(*[exact.json_quoted(F.col(c).cast("string")) for c in rows.columns]), "\t").alias("value"))


def header(df: DataFrame, fields: Sequence[str] | None = None) -> str:
    return "\t".join(projected(df, fields).columns)


def decode(lines: DataFrame, head: str) -> DataFrame:
    """Rows from lines of encode(), given the header line; a line with another number of cells is an error."""
    names = head.split("\t")
    cells = F.split("value", "\t", -1)
    checked = F.when(F.size(cells) == len(names), cells).otherwise(F.raise_error(F.concat(F.lit("another number of cells: "), F.col("value"))).cast("array<string>"))
    # a quoted cell is one JSON string
    plain = lambda c: F.when(c.startswith('"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]).otherwise(c)
    return lines.select(checked.alias("_c")).select(*[plain(F.col("_c")[i]).alias(n) for i, n in enumerate(names)])


def origin(*tables: DataFrame) -> DataFrame:
    """One row: the earliest start over tables of records, 0 without any."""
    starts = [t.agg(F.min("start_ns").alias("_s")) for t in tables]
    every = starts[0]
    for s in starts[1:]:
        every = every.unionByName(s)
    return every.agg(F.coalesce(F.min("_s"), F.lit(0).cast("long")).alias("origin_ns"))


def trace_events(windows: DataFrame, kernels: DataFrame, copies: DataFrame, activities: DataFrame) -> DataFrame:
    """Trace events of four tracks, microseconds from the earliest start: name, tid, ts, dur, args (a map of text)."""
    text = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*[v.cast("string") for v in kv.values()]))
    none = F.create_map().cast("map<string,string>")
    ns = F.col("end_ns") - F.col("start_ns")
    of = lambda df, name, tid, args: df.select(F.col(name).alias("name"), F.lit(tid).alias("tid"), "start_ns", ns.alias("_dur"), args.alias("args"))
    every = (
        of(windows, "name", REGIONS, none)
        .unionByName(of(kernels, "name", KERNELS, text(grid=F.col("grid"), block=F.col("block"), registers=F.col("registers"))))
        .unionByName(of(copies, "kind", COPIES, text(bytes=F.col("bytes_moved"))))
        .unionByName(of(activities, "name", ACTIVITIES, text(kind=F.col("kind"), correlation=F.col("correlation_id"))))
    )
    start = F.broadcast(origin(windows, kernels, copies, activities))  # one row
    return every.crossJoin(start).select("name", "tid", ((F.col("start_ns") - F.col("origin_ns")) / 1000.0).alias("ts"), (F.col("_dur") / 1000.0).alias("dur"), "args")


def trace_lines(events: DataFrame, device: str = "") -> DataFrame:
    """Trace events and their metadata rows as lines of JSON, for write.text()."""
    spark = events.sparkSession
    meta = [("process_name", PROCESS, device or "device")] + [("thread_name", tid, name) for tid, name in TRACKS.items()]
    heads = spark.createDataFrame(meta, "kind string, tid int, name string")
    head = F.to_json(F.struct(F.lit("M").alias("ph"), F.col("kind").alias("name"), F.lit(0).alias("pid"), "tid", F.struct("name").alias("args")))
    body = F.to_json(F.struct(F.lit("X").alias("ph"), "name", F.lit(0).alias("pid"), "tid", "ts", "dur", "args"))
    return heads.select(head.alias("value")).unionByName(events.select(body.alias("value")))


def merge_document(sources: DataFrame) -> DataFrame:
    """One row: the document that merges several traces, as JSON text. A `.json` source without a sync target is an error.

    Sources have path, sync, clock, offset_ns, ordinal; clocks only stand where they are set and offsets where they are not 0.
    """
    unsynced = F.col("path").endswith(".json") & F.col("sync").isNull()
    path = F.when(unsynced, F.raise_error(F.concat(F.lit("no sync target for "), F.col("path"))).cast("string")).otherwise(F.col("path"))
    entry = F.struct(path.alias("path"), "sync", "clock", F.nullif("offset_ns", F.lit(0).cast("long")).alias("offset_ns"))
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))).alias("_s"))
    return listed.select(F.to_json(F.struct(F.transform("_s", lambda x: x["e"]).alias("sources"))).alias("value"))
