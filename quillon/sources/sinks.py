"""Sinks: appended ledgers, tables rewritten by key, heartbeats, rolled segments, profile documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import schemas
from quillon.operators import state
from quillon.session import scratch
from quillon.sources import files


def append(df: DataFrame, path: str) -> None:
    """Appends records as NDJSON."""
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put(rows: DataFrame, folder: str, batch: int) -> None:
    """Writes rows with an `arrival` order as one batch of a keyed table. A batch that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of a table that is written in batches, with the number of their batch."""
    schema = f"{schema}, batch long"
    if not files.exists(spark, f"{folder.rstrip('/')}/batch=*"):
        return schemas.empty(spark, schema)
    return spark.read.schema(schema).parquet(folder)


def current(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of a keyed table that count: of each key the last, by batch and then by arrival."""
    rows = batches(spark, folder, f"{schema}, arrival long")
    return state.latest(rows, keys, F.struct("batch", "arrival")).drop("batch", "arrival")


def one_file(lines: DataFrame, path: str) -> None:
    """Publishes lines of text (value) as one file: for documents that are a file by definition, not for data."""
    spark, folder = lines.sparkSession, f"{path}.{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(folder)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    for part in system.globStatus(made):
        system.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path))
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def heartbeat(spark: SparkSession, folder: str, job_state: str, offset: int, base: int, updated_at: str) -> None:
    """Publishes a log's heartbeat as one small record."""
    row = spark.createDataFrame([(job_state, offset, updated_at, base)], "state string, offset long, updated_at string, base long")
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/status.json")


def profile_document(device: str, host: str, **lists: DataFrame) -> DataFrame:
    """One row of JSON: a profile with its lists (summaries, windows, kernels, memcpys, activities) in the order of `ordinal`.

    A document is one file by definition, so its lists are gathered; use it for single profiles, and tables for fleets.
    """
    out = None
    for kind, rows in lists.items():
        fields = F.struct(*[c for c in rows.columns if c not in ("ordinal", "path")])
        one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", fields.alias("r")))), lambda x: x["r"]).alias(kind))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(F.lit(host).alias("host"), F.lit(device).alias("device"), *lists)).alias("value"))


def merge_manifest(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def command_events(commands: DataFrame, last_id: int) -> DataFrame:
    """Commands as history rows: ids go on after the last, the target is the first text among the arguments."""
    # ranges are numbered by themselves; the counts of the ranges before tell where each begins. They are written once: ranges that
    # are drawn again, or whose partitions are joined otherwise, would be others than those that were counted
    spark = commands.sparkSession
    folder = scratch(spark)
    commands.repartitionByRange("ordinal").sortWithinPartitions("ordinal").withColumn("_n", F.monotonically_increasing_id()).write.parquet(folder)
    ranged = spark.read.parquet(folder)
    ranged = ranged.withColumn("_range", F.shiftright("_n", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    numbered = ranged.join(ahead.drop("_size"), "_range").withColumn("id", F.lit(last_id) + F.col("_ahead") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return numbered.drop("_n", "_range", "_ahead").withColumn("target", F.get(F.filter("args", lambda a: a.isNotNull()), F.lit(0)))
