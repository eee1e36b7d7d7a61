"""Registered queries over files: records are written through the sinks, to a new folder each time, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import adapters as a
from quillon.operators import frames, render, state
from quillon.plans.listings import said
from quillon.plans.queries import FRAMES, KERNELS, OBS, OFFERS, ORACLE_SQL, RUNS, query, verdict_report
from quillon.session import scratch, table
from quillon.sources import documents, files, logs, sinks


@query(f"""WITH {OBS} SELECT provider, gpu, count(*) AS n, sum(setup_s) AS setup_s FROM o WHERE provider = 'p3' AND gpu = 'g0' GROUP BY ALL""")
def observation_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Observations appended twice, read by provider and hardware."""
    path = f"{scratch(spark)}/costs.ndjson"
    rows = a.observations(spark, sf)
    sinks.append(rows.where("gpu = 'g0'"), path)
    sinks.append(rows.where("gpu <> 'g0'"), path)
    found = files.observations(spark, path, "p3", "g0").select("*", F.greatest(F.col("t_running") - F.col("t_submit"), F.lit(0.0)).alias("setup_s"))
    return found.groupBy("provider", "gpu").agg(F.count("*").cast("long").alias("n"), F.sum("setup_s").alias("setup_s"))


@query(f"""WITH {OFFERS} SELECT provider, gpu, spot, rate AS rate_usd_hr, CAST(g AS INT) AS granularity_s, 'declared' AS source, '' AS region FROM f""")
def offer_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue written over another; fields that the file leaves out read as their defaults."""
    path = f"{scratch(spark)}/offers.ndjson"
    rows = a.offers(spark, sf)
    sinks.replace(rows.limit(3), path)
    sinks.replace(rows.drop("source", "region", "ordinal"), path)
    return files.offers(spark, path).select("provider", "gpu", "spot", "rate_usd_hr", "granularity_s", "source", "region")


@query("""SELECT 's' || (user_id % 4) AS study_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS "ordinal", CAST(user_id AS VARCHAR) AS handle,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'verdict' WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'click' THEN 'note' ELSE 'submitted' END AS kind FROM events""")
def study_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger file for each study; a line's place in its file is its ordinal."""
    folder = scratch(spark)
    rows = a.study_events(spark, sf)
    for study in ("s0", "s1", "s2", "s3"):
        own = rows.where(F.col("study_id") == study).orderBy("ordinal")
        sinks.one_file(own.select(F.to_json(F.struct("at", "kind", "handle", "state", "name")).alias("value")), f"{folder}/{study}.jsonl")
    return files.study_events(spark, folder).select("study_id", "ordinal", "handle", "kind")


@query(f"""WITH {FRAMES} SELECT job, kind, arrival * 512 AS "offset", epoch_us("at") AS "at" FROM once WHERE arrival * 512 >= 100000""")
def log_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as lines of a log, rolled into compressed segments, and read from an offset on; segments before it are not opened."""
    folder = scratch(spark)
    rows = a.frames(spark, sf).where("arrival < 1000000000").withColumn("offset", F.col("arrival") * 512)
    lines = frames.encode(rows.withColumn("schema_version", F.lit(1))).select("offset", F.rpad("line", 511, " ").alias("line"))
    logs.roll(lines, folder, 64 << 10)
    return files.frames_from(spark, folder, 100_000).select("job", "kind", "offset", F.unix_micros("at").alias("at"))


@query(f"""WITH {FRAMES} SELECT job, kind, arrival * 512 AS "offset", epoch_us("at") AS "at" FROM once WHERE arrival * 512 >= 100000""")
def log_followed(spark: SparkSession, sf: str) -> DataFrame:
    """A log followed as a stream from a byte offset on: archives, a live file, and a last line that is not finished."""
    from quillon.streaming import jobs

    folder = scratch(spark)
    rows = a.frames(spark, sf).where("arrival < 1000000000").withColumn("offset", F.col("arrival") * 512)
    lines = frames.encode(rows.withColumn("schema_version", F.lit(1))).select("arrival", "offset", F.rpad("line", 511, " ").alias("line"))
    live = lines.agg(F.greatest(F.max("arrival") - 50, F.lit(0))).first()[0]
    logs.roll(lines.where(F.col("arrival") < live), f"{folder}/log", 64 << 10)
    tail = lines.where(F.col("arrival") >= live).orderBy("arrival").collect()  # the live file: fifty lines
    logs.append_live(f"{folder}/log", "".join(f"{r.line}\n" for r in tail) + '{"schema_version":1,"job":"1","ki')
    jobs.catch_up(jobs.log_stream(spark, f"{folder}/log", 100_000), f"{folder}/out", f"{folder}/checkpoint")
    return jobs.stored_frames(spark, f"{folder}/out").select("job", "kind", "offset", F.unix_micros("at").alias("at"))


@query("""SELECT 'running' AS state, count(*) AS "offset", CAST(max(event_id) * 512 // 65536 + 1 AS BIGINT) AS most, (SELECT count(DISTINCT event_id * 512 // 65536) FROM events) AS segments FROM events""")
def log_status(spark: SparkSession, sf: str) -> DataFrame:
    """A log's heartbeat beside its segments; the segments' names tell where they begin."""
    folder = scratch(spark)
    events = table(spark, sf, "events")
    logs.roll(events.select((F.col("event_id") * 512).alias("offset"), F.rpad("event_type", 511, "x").alias("line")), folder, 64 << 10)
    sinks.heartbeat(spark, folder, "running", events.count(), 0, "now")
    ends = files.segments(spark, folder).agg(F.count("*").cast("long").alias("segments"), F.max(F.floor(F.col("start") / (64 << 10)) + 1).cast("long").alias("most"))
    return files.heartbeat(spark, folder).select("state", "offset").crossJoin(ends)  # one row each


@query("""SELECT CAST(max(event_id) * 512 + 512 AS BIGINT) AS segment_start, CAST(max(event_id) * 512 + 512 + 6 AS BIGINT) AS position FROM events""")
def log_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Where a log goes on: the live segment begins at the end of the last archive, and the next byte comes after what it holds."""
    folder = scratch(spark)
    logs.roll(table(spark, sf, "events").select((F.col("event_id") * 512).alias("offset"), F.rpad("event_type", 511, "x").alias("line")), folder, 64 << 10)
    sinks.one_file(spark.range(1).select(F.lit("12345").alias("value")), f"{folder}/live.ndjson")
    return files.resume_position(spark, folder)


@query(f"""WITH {KERNELS} SELECT name, min(s) AS start_ns, '' AS grid FROM k GROUP BY name""")
def profile_files(spark: SparkSession, sf: str) -> DataFrame:
    """A profile document with all kernel records, written in parts and read back in blocks."""
    path = scratch(spark)
    kernels = a.kernels(spark, sf).select("name", "start_ns", "end_ns", F.struct("start_ns", "ordinal").alias("ordinal"))
    documents.profile_lines("device", "host", kernels=kernels).write.text(path)
    return documents.records(spark, path, "kernels").groupBy("name").agg(F.min("start_ns").alias("start_ns"), F.max("grid").alias("grid"))


@query(f"""WITH {RUNS} SELECT handle, target, submitted_at, CASE WHEN target = 'host4' THEN 'second' ELSE state END AS state FROM runs""")
def registry_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A registry written in batches; of each key the last writer counts."""
    folder = scratch(spark)
    runs = a.runs(spark, sf).select(*state.RUN_KEY, "state")
    sinks.put(runs.select("*", F.lit(0).cast("long").alias("arrival")), folder, 0)
    late = runs.where("target = 'host4'")
    again = late.withColumns({"state": F.lit("first"), "arrival": F.lit(0).cast("long")}).unionByName(late.withColumns({"state": F.lit("second"), "arrival": F.lit(1).cast("long")}))
    sinks.put(again, folder, 1)
    return sinks.current(spark, folder, "target string, handle string, submitted_at string, state string", state.RUN_KEY)


@query("""SELECT 'p' || n_nationkey || '.json' AS path, 'sync' AS sync FROM nation""")
def merge_manifests(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    none = F.lit(None).cast("string")
    sources = table(spark, sf, "nation").select(said("p", F.col("n_nationkey"), ".json").alias("path"), F.lit("sync").alias("sync"), none.alias("clock"), F.lit(0).cast("long").alias("offset_ns"), F.col("n_nationkey").alias("ordinal"))
    sinks.merge_manifest(render.merge_document(sources), path)
    entries = F.from_json("value", "sources array<struct<path: string, sync: string>>")["sources"]
    return spark.read.text(path).select(F.explode(entries).alias("e")).select("e.*")


@query("""SELECT 100 + row_number() OVER (ORDER BY event_id) AS id, event_type AS command, CASE WHEN event_id % 2 = 0 THEN 'h' || user_id END AS target FROM events""")
def command_history(spark: SparkSession, sf: str) -> DataFrame:
    """Commands numbered on from the last id of a history."""
    k = F.col("event_id")
    commands = table(spark, sf, "events").select(k.alias("ordinal"), F.col("event_type").alias("command"), F.array(F.when(k % 2 == 0, said("h", F.col("user_id")))).alias("args"))
    return sinks.command_events(commands, 100).select("id", "command", "target")


@query("""SELECT n_name AS name, sha256(n_name || chr(10)) AS digest FROM nation""")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of files, as a sync compares them: a file for each nation."""
    folder = scratch(spark)
    table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("name")).repartition("name").write.partitionBy("name").text(folder)
    return files.file_digests(spark, folder).select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "digest")


@query(f"""SELECT bound || '-bound after 10 iterations' AS head, dominant_kernel AS kernel FROM ({ORACLE_SQL['profile_verdict']})""")
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    """A profile report as text: the words of its first line and the hottest kernel that its second names."""
    from quillon.operators import trace

    lines = trace.report_text(verdict_report(spark, sf)).select(F.split("value", "\n").alias("l"))
    return lines.select(F.regexp_extract(F.col("l")[0], "^([^:]*):", 1).alias("head"), F.regexp_extract(F.col("l")[1], "^hottest kernel (.*), [0-9.]+% of", 1).alias("kernel"))


@query("""SELECT CAST(user_id AS VARCHAR) AS job, event_id AS "offset", event_type AS kind FROM events WHERE event_id % 5 > 0""")
def torn_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a log in files whose last lines their writers had not finished."""
    folder = scratch(spark)
    k = F.col("event_id")
    whole = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("user_id").cast("string").alias("job"), F.col("event_type").alias("kind"), k.alias("offset"), F.lit("2024-01-01T00:00:00Z").alias("at"), F.lit("{}").alias("payload")))
    rows = table(spark, sf, "events").select(k.alias("k"), whole.alias("value"), (k % 5 == 0).alias("unterminated"))
    rows.select("k", F.when(F.col("unterminated"), F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value"), "unterminated").write.parquet(folder)
    return frames.decode(spark.read.parquet(folder)).select("job", "offset", "kind")
