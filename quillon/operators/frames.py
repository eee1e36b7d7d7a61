"""Frames of job streams: decoding with a torn tail, offsets, idempotent ingest, projection to job state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon import schemas


def decode(lines: DataFrame, text_col: str = "value", last_col: str = "unterminated", keep: list[str] | None = None) -> DataFrame:
    """Frames from lines of NDJSON, with the columns of lines to keep. Blank lines are skipped; a line that does not decode is an error, unless it is the
    unterminated last line of its file (last_col), which a writer had not finished."""
    rows = lines.where(F.trim(text_col) != "").withColumn("_frame", F.from_json(text_col, schemas.FRAME + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    torn = F.coalesce(F.col(last_col), F.lit(False)) & F.col("_frame._bad").isNotNull()
    rows = rows.where(~torn)
    bad = F.col("_frame._bad")
    job = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not a frame: "), bad)).cast("string")).otherwise(F.col("_frame.job"))
    out = rows.select(F.col("_frame.schema_version").alias("schema_version"), job.alias("job"), *[F.col(f"_frame.{c}").alias(c) for c in ("kind", "offset", "payload")], F.col("_frame.at").cast("timestamp").alias("at"), *(keep or []))
    return schemas.with_defaults(out, "frame")


def encode(frames: DataFrame) -> DataFrame:
    """One line of JSON per frame as `line`, with its length in bytes, line end included."""
    payload = F.coalesce(F.expr("try_parse_json(payload)"), F.expr("parse_json('{}')"))
    body = F.to_json(F.struct("schema_version", "job", "kind", "offset", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), payload.alias("payload")))
    return frames.withColumn("line", body).withColumn("encoded_length", F.octet_length("line") + 1)


def stamped(lines: DataFrame, by: list[str], base: int = 0, text_col: str = "line") -> DataFrame:
    """Lines with their byte offsets in a log that they are appended to, in the order of `ordinal`."""
    ahead = Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.lit(base).cast("long") + F.coalesce(F.sum(F.octet_length(text_col) + 1).over(ahead), F.lit(0).cast("long")))


def segments(lines: DataFrame, by: list[str], most_bytes: int, text_col: str = "line") -> DataFrame:
    """Stamped lines with the number of the segment they are in, where a segment ends with the line that fills it."""
    return lines.withColumn("segment", F.floor(F.col("offset") / most_bytes).cast("long"))


def next_offset(frames: DataFrame, by: list[str], logs: DataFrame | None = None) -> DataFrame:
    """Per log: where the next frame goes, after the last frame and its encoded length. logs (by, default) names the logs that
    are asked for, and where an empty one begins."""
    found = frames.groupBy(*by).agg(F.max_by(F.col("offset") + F.col("encoded_length"), "offset").alias("next_offset"))
    if logs is None:
        return found
    return logs.join(found, by, "left").select(*by, F.coalesce("next_offset", F.col("default").cast("long")).alias("next_offset"))


def tail(frames: DataFrame, job: str, since: int) -> DataFrame:
    """A job's frames after an offset, in order."""
    return frames.where((F.col("job") == job) & (F.col("offset") > since)).orderBy("offset")


def first_writes(frames: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Frames that are new: the first arrival of each (job, offset), without those that are stored already.

    The least arrival is combined before the shuffle, so a frame that was sent a million times costs a row a task.
    """
    first = frames.groupBy("job", "offset").agg(F.min_by(F.struct(*frames.columns), "arrival").alias("_f")).select("_f.*")
    return first if stored is None else first.join(stored.select("job", "offset"), ["job", "offset"], "left_anti")


def project(frames: DataFrame) -> DataFrame:
    """Job states from frames in order of arrival: job, state, started_at, ended_at, exit_code.

    The last `started` or `ended` frame gives the state; each kind's last frame gives its time, and the last `ended`
    frame the exit code. Give first_writes() for states that a replay cannot change, or every arrival for a
    projection that a replayed `started` sets back to running.
    """
    moves = frames.where(F.col("kind").isin("started", "ended"))
    code = F.get_json_object("payload", "$.exit_code").try_cast("int")
    of = lambda kind, value: F.max_by(value, F.when(F.col("kind") == kind, F.col("arrival")))
    has = lambda kind: F.count_if(F.col("kind") == kind) > 0
    return moves.groupBy("job").agg(
        F.when(F.max_by("kind", "arrival") == "started", "running").otherwise("ended").alias("state"), F.when(has("started"), of("started", F.struct("at"))["at"]).alias("started_at"),
        F.when(has("ended"), of("ended", F.struct("at"))["at"]).alias("ended_at"), F.when(has("ended"), of("ended", F.struct(code.alias("c")))["c"]).alias("exit_code"),
    )


def samples(frames: DataFrame) -> DataFrame:
    """The resource samples among frames: job, offset, at, rss; the last arrival of each (job, offset)."""
    rss = F.get_json_object("payload", "$.rss").try_cast("long")
    rows = frames.where(F.col("kind") == "sample").select("job", "offset", "at", rss.alias("rss"), "arrival")
    return rows.groupBy("job", "offset").agg(F.max_by(F.struct("at", "rss"), "arrival").alias("_s")).select("job", "offset", "_s.*")


def is_ended(frames: DataFrame) -> DataFrame:
    """Per job: whether an `ended` frame has been seen."""
    return frames.groupBy("job").agg(F.bool_or(F.col("kind") == "ended").alias("ended"))
