"""Job streams: frames from files or logs as they arrive, ingested once each, and projected to job states.

The source keeps its place in the checkpoint, and so does the state of each job (states.py): which frames were seen, and the last
start and the last end. So a micro-batch costs what it brings, whatever came before. It is written as a batch of its own,
which a batch that is run again replaces: frames that are new, the states of jobs that they change, and samples. Job
states are those folded by job when they are read. Nothing that is stored is read or written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from quillon import schemas
from quillon.operators import frames
from quillon.session import on_workers
from quillon.sources import logs, sinks
from quillon.streaming import states

FRAMES = "job string, kind string, offset long, at timestamp, payload string, arrival long"
MOVES = "job string, started struct<arrival: long, at: timestamp>, ended struct<arrival: long, at: timestamp, exit_code: int>"
SAMPLES = "job string, offset long, at timestamp, rss long"


def frame_stream(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """Frames of the NDJSON files that come into a folder; a line that does not decode fails the stream."""
    reader = spark.readStream.schema(schemas.FRAME.replace("at string", "at timestamp") + ", arrival long").option("mode", "FAILFAST")
    reader = reader.option("maxFilesPerTrigger", files_each) if files_each else reader
    return schemas.with_defaults(reader.json(folder), "frame").select("job", "kind", "offset", "at", "payload", "arrival")


def log_stream(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """Frames of a job's log from a byte offset on, over archives and the live file, in the order of their bytes (arrival)."""
    lines = logs.lines(spark, folder, since).select(F.col("position").alias("_position"), "value", F.lit(False).alias("unterminated"))
    decoded = frames.decode(lines, keep=["_position"])
    return decoded.select("job", "kind", "offset", "at", "payload", F.col("_position").alias("arrival"))


def stored_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame once, with the batch that brought it."""
    return sinks.batches(spark, f"{folder}/frames", f"{FRAMES}, what string").where("what = 'frame'").drop("what")


def stored_samples(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.batches(spark, f"{folder}/samples", SAMPLES).drop("batch")


def moves(frames_: DataFrame) -> DataFrame:
    """Per job: its last `started` and its last `ended` frame by arrival. Moves of parts of a stream fold to those of the whole."""
    code = F.get_json_object("payload", "$.exit_code").try_cast("int")
    last = lambda kind, *fields: F.max(F.when(F.col("kind") == kind, F.struct("arrival", "at", *fields)))
    return frames_.where(F.col("kind").isin("started", "ended")).groupBy("job").agg(last("started").alias("started"), last("ended", code.alias("exit_code")).alias("ended"))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """job, state, started_at, ended_at, exit_code: the folded moves of all batches."""
    folded = sinks.batches(spark, f"{folder}/moves", MOVES).groupBy("job").agg(F.max("started").alias("started"), F.max("ended").alias("ended"))
    began = F.coalesce(F.col("started.arrival") > F.col("ended.arrival"), F.col("started").isNotNull())
    return folded.select(
        "job", F.when(began, "running").otherwise("ended").alias("state"), F.col("started.at").alias("started_at"), F.col("ended.at").alias("ended_at"), F.col("ended.exit_code").alias("exit_code"),
    )


def _put(spark: SparkSession, folder: str, number: int, moved: DataFrame | None = None) -> None:
    """Writes the moves and samples of a batch whose frames are written."""
    written = sinks.batches(spark, f"{folder}/frames", f"{FRAMES}, what string, {states.MOVE}").where(F.col("batch") == number)
    if moved is None:
        time = lambda name: F.timestamp_micros(name).alias("at")
        has = lambda kind, *fields: F.when(F.col(f"{kind}_arrival").isNotNull(), F.struct(F.col(f"{kind}_arrival").alias("arrival"), time(f"{kind}_at"), *fields)).alias(kind)
        moved = written.where("what = 'state'").select("job", has("started"), has("ended", "exit_code"))
    sinks.put(moved, f"{folder}/moves", number)
    sinks.put(frames.samples(written.where("what = 'frame'")), f"{folder}/samples", number)


def ingest(folder: str, strict_compat: bool = False) -> Callable[[DataFrame, int], None]:
    """A function that stores a batch without a stream, held against all frames that are stored: first writes, their moves and samples.

    With strict_compat every arrival counts as a move instead, so a replayed `started` sets an ended job back to running.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = stored_frames(spark, folder).where(F.col("batch") != number)
        new = frames.first_writes(batch, known).withColumn("what", F.lit("frame"))
        new.write.mode("overwrite").partitionBy("what").parquet(f"{folder}/frames/batch={number}")
        written = stored_frames(spark, folder).where(F.col("batch") == number)
        _put(spark, folder, number, moves(batch if strict_compat else written))

    return run


def arrived(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for states.first_writes(): its rows are written once, for state must not be worked out twice."""

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.timestamp_micros("at")).write.mode("overwrite").partitionBy("what").parquet(f"{folder}/frames/batch={number}")
        _put(batch.sparkSession, folder, number)

    return run


def writer(stream: DataFrame, folder: str, checkpoint: str, strict_compat: bool = False, delay: str | None = None) -> DataStreamWriter:
    """What stores a stream; start it inside states.rocks()."""
    on_workers(stream.sparkSession)
    return states.first_writes(stream, delay, strict_compat).writeStream.outputMode("update").foreachBatch(arrived(folder)).option("checkpointLocation", checkpoint)


def catch_up(stream: DataFrame, folder: str, checkpoint: str, strict_compat: bool = False, delay: str | None = None) -> None:
    """Ingests what has arrived and ends."""
    with states.rocks(stream.sparkSession):
        query = writer(stream, folder, checkpoint, strict_compat, delay).trigger(availableNow=True).start()
    query.awaitTermination()


def watch(stream: DataFrame, folder: str, checkpoint: str, seconds: float, delay: str | None = None) -> StreamingQuery:
    """Ingests on a trigger until it is stopped."""
    with states.rocks(stream.sparkSession):
        return writer(stream, folder, checkpoint, delay=delay).trigger(processingTime=f"{seconds} seconds").start()


def follow(stream: DataFrame, folder: str, checkpoint: str, job: str, since: int = -1, passes: int = 1) -> DataFrame:
    """A job's frames after an offset, in order, once it has ended: catches up until then, at most so many times."""
    spark = stream.sparkSession
    for _ in range(passes):
        catch_up(stream, folder, checkpoint)
        if not job_states(spark, folder).where((F.col("job") == job) & (F.col("state") == "ended")).isEmpty():
            break
    return frames.tail(stored_frames(spark, folder).drop("batch"), job, since)


def once_within(stream: DataFrame, delay: str) -> DataFrame:
    """Frames once each, with state that is given up a delay after the frames' time: for streams without a stored table."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job", "offset"])


def live_counts(stream: DataFrame, delay: str, window: str) -> DataFrame:
    """Frames per job, kind and window of time, each count final once its window is past the delay."""
    return stream.withWatermark("at", delay).groupBy("job", "kind", F.window("at", window)).agg(F.count("*").cast("long").alias("frames"))
