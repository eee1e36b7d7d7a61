"""File sources: NDJSON ledgers, job logs in segments, profile documents. Every source reads with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import schemas
from quillon.operators import frames


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path of any file system that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def ndjson(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """Records of NDJSON files; blank lines are skipped, a line that is no JSON is an error, an absent path is empty."""
    if not exists(spark, path):
        return schemas.empty(spark, schema)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    return schemas.with_defaults(rows, kind) if kind else rows


def observations(spark: SparkSession, path: str, provider: str = "", gpu: str = "") -> DataFrame:
    rows = ndjson(spark, path, schemas.OBSERVATION, "observation")
    rows = rows.where(F.col("provider") == provider) if provider else rows
    return rows.where(F.col("gpu") == gpu) if gpu else rows


def offers(spark: SparkSession, path: str) -> DataFrame:
    return ndjson(spark, path, schemas.OFFER, "offer")


def study_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of every `<study>.jsonl` in a folder, with study_id and their place in the file as ordinal.

    Files are read as lines, in as many splits as a file has; a line is counted inside its split, and the counts of the splits before it,
    one row for each split, tell where it begins.
    """
    path = f"{folder}/*.jsonl"
    if not exists(spark, path):
        return schemas.empty(spark, f"study_id string, {schemas.STUDY_EVENT}, ordinal long")
    split = ["_file", "_block"]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.where(F.trim("value") != "").withColumn("_own", F.row_number().over(Window.partitionBy(*split).orderBy("_id")))
    counts = lines.groupBy(*split).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*split, F.coalesce(before, F.lit(0)).alias("_before"))
    rows = lines.join(counts, split).withColumn("ordinal", F.col("_before") + F.col("_own")).withColumn("_e", F.from_json("value", schemas.STUDY_EVENT, {"mode": "FAILFAST"}))
    return rows.select(F.regexp_extract("_file", r"^(.*)\.jsonl$", 1).alias("study_id"), "_e.*", "ordinal")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archived segments of a log, by their names `<start>-<end>.ndjson.zst`: start, end, path; oldest first."""
    path = f"{folder}/*.ndjson.zst"
    if not exists(spark, path):
        return schemas.empty(spark, "start long, end long, path string")
    found = spark.read.format("binaryFile").load(path).select("path")
    part = lambda i: F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.ndjson\.zst$", i).cast("long")
    return found.select(part(1).alias("start"), part(2).alias("end"), "path").orderBy("start")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Archived segments, and the live one from the end of the last archive on."""
    old = archives(spark, folder)
    live = f"{folder}/live.ndjson"
    if not exists(spark, live):
        return old
    file = spark.read.format("binaryFile").load(live).select("path", "length")
    base = old.agg(F.coalesce(F.max("end"), F.lit(0).cast("long")).alias("_base"))  # one row
    return old.unionByName(file.crossJoin(base).select(F.col("_base").alias("start"), (F.col("_base") + F.col("length")).alias("end"), "path"))


def resume_position(spark: SparkSession, folder: str) -> DataFrame:
    """One row: where the live segment starts and where the next byte goes."""
    old = archives(spark, folder).agg(F.coalesce(F.max("end"), F.lit(0).cast("long")).alias("segment_start"))
    every = segments(spark, folder).agg(F.coalesce(F.max("end"), F.lit(0).cast("long")).alias("position"))
    return old.crossJoin(every)  # one row each


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as `value`, with `unterminated` for a last line that its writer had not ended.

    The byte after the last line tells: a file's length is the length of its lines and their ends, less one for a
    line without its end.
    """
    options = {"lineSep": "\n"}
    lines = spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    if path.endswith((".zst", ".gz")):
        return lines.select("value", F.lit(False).alias("unterminated"))
    per = lines.groupBy("_file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max(F.struct("_block", "_id")).alias("_last"), F.max("_size").alias("_length"))
    met = lines.join(per, "_file")
    is_last = F.struct("_block", "_id") == F.col("_last")
    return met.select("value", (is_last & (F.col("_bytes") > F.col("_length"))).alias("unterminated"))


def frames_from(spark: SparkSession, folder: str, offset: int = 0) -> DataFrame:
    """Frames of a log from a byte offset on, over archives and the live file. Archives that end before it are not read."""
    wanted = [r.path for r in archives(spark, folder).where(F.col("end") > offset).collect()]  # a file list, not data
    parts = []
    if wanted:
        parts.append(spark.read.option("lineSep", "\n").text(wanted).select("value", F.lit(False).alias("unterminated")))
    if exists(spark, f"{folder}/live.ndjson"):
        parts.append(log_lines(spark, f"{folder}/live.ndjson"))
    if not parts:
        return schemas.empty(spark, "schema_version int, job string, kind string, offset long, payload string, at timestamp")
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return frames.decode(lines).where(F.col("offset") >= offset)


def heartbeat(spark: SparkSession, folder: str) -> DataFrame:
    """The last published heartbeat of a log: state, offset, updated_at, base; no row before the first."""
    schema = "state string, offset long, updated_at string, base long"
    path = f"{folder}/status.json"
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else schemas.empty(spark, schema)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile documents with the path that each came from."""
    return spark.read.schema(schemas.PROFILE).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def profile_records(documents: DataFrame, kind: str) -> DataFrame:
    """One of a profile's lists (summaries, windows, kernels, memcpys, activities) as rows with their ordinal."""
    names = {"summaries": "region_summary", "kernels": "kernel", "memcpys": "memcpy", "activities": "activity"}
    rows = documents.select("path", F.posexplode(kind).alias("ordinal", "_r")).select("path", "ordinal", "_r.*")
    return schemas.with_defaults(rows, names[kind]) if kind in names else rows


def host_facts(reports: DataFrame, text_col: str = "value") -> DataFrame:
    """Host facts from noisy command output: the record that begins at the first brace."""
    from quillon.functions import text

    return reports.select(text.first_json(text_col, schemas.HOST_FACTS).alias("_f")).select("_f.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time (ns) and SHA-256 of files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.sha2("content", 256).alias("digest"))
