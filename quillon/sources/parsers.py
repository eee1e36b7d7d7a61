"""Listings of schedulers and machines as rows: table-valued functions over a column of text.

Each takes a table of blobs (`id`, `value`) and returns rows with the blob's id and `line`, the place in the blob. All
are column expressions over split lines, so any number of blobs is read side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text

_END = "\r\n|[\n\r\u000b\u000c]"


def lines(blobs: DataFrame, id_col: str = "id", text_col: str = "value") -> DataFrame:
    """id, line, value: the lines of each blob."""
    return blobs.select(F.col(id_col), F.posexplode(F.split(text_col, _END)).alias("line", "value"))


def _words(x: Column | str) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda w: w != "")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def squeue(blobs: DataFrame) -> DataFrame:
    """Pipe-delimited queue listing: job_id, name, state, partition, elapsed. Rows of fewer than five parts are left out."""
    parts = F.split("value", "\\|")
    rows = lines(blobs).where((F.size(parts) >= 5) & (_trimmed(F.col("value")) != "")).withColumn("_p", F.transform(parts, _trimmed))
    at = lambda i: F.col("_p")[i]
    none = lambda i: F.nullif(at(i), F.lit(""))
    return rows.select("id", "line", at(0).alias("job_id"), at(1).alias("name"), text.slurm_state(at(2)).alias("state"), none(3).alias("partition"), none(4).alias("elapsed"))


def sacct(blobs: DataFrame, job_col: str = "job_id") -> DataFrame:
    """Accounting listing: the first row that is the job itself, not a step of it; blobs have the job's id. No row without one."""
    parts = F.split("value", "\\|")
    rows = blobs.select("id", F.col(job_col).alias("_job"), F.posexplode(F.split("value", _END)).alias("line", "value"))
    rows = rows.where(F.size(parts) >= 3).withColumn("_p", F.transform(parts, _trimmed)).where(F.col("_p")[0] == F.col("_job"))
    first = rows.groupBy("id").agg(F.min_by("_p", "line").alias("_p"))
    return first.select("id", F.col("_p")[0].alias("job_id"), text.slurm_state(F.col("_p")[1]).alias("state"), text.slurm_exit_code(F.col("_p")[2]).alias("exit_code"))


def sinfo(blobs: DataFrame) -> DataFrame:
    """Distinct partition names, the default's star taken off, where each first stands."""
    named = blobs.select("id", F.transform(F.split("value", _END), lambda x: F.regexp_replace(_trimmed(x), "\\*$", "")).alias("_l"))
    rows = named.select("id", "_l", F.explode(F.array_distinct("_l")).alias("name")).where("name <> ''")
    return rows.select("id", "name", (F.array_position("_l", F.col("name")) - 1).cast("int").alias("line"))


def _first_line(lines_: Column, condition: Callable[[Column], Column]) -> Column:
    """The place of the first line that meets a condition, from 0; -1 without any."""
    return (F.array_position(F.transform(lines_, condition), F.lit(True)) - 1).cast("int")


def qstat(blobs: DataFrame) -> DataFrame:
    """Queue listing in its standard and wide layouts, which the header line tells: job_id, name, state, queue."""
    whole = F.split("value", _END)
    head = _first_line(whole, lambda x: _trimmed(x).startswith("JOB_ID") | _trimmed(x).startswith("Job"))
    rows = blobs.select("id", head.alias("_head"), F.posexplode(whole).alias("line", "value"), _trimmed(F.get(whole, head)).startswith("JOB_ID").alias("_wide"))
    body = rows.where((F.col("_head") >= 0) & (F.col("line") > F.col("_head")))
    body = body.where(~((F.col("line") == F.col("_head") + 1) & _trimmed(F.col("value")).startswith("---"))).withColumn("_p", _words("value"))
    n, at = F.size("_p"), lambda i: F.get("_p", F.lit(i))
    body = body.where(n >= F.when(F.col("_wide"), 8).otherwise(5))
    state = F.when(F.col("_wide"), at(2)).when(n < 6, at(3)).otherwise(at(4))
    queue = F.when(F.col("_wide"), at(4)).when(n < 6, at(4)).otherwise(at(5))
    return body.select("id", "line", at(0).alias("job_id"), at(1).alias("name"), text.pbs_state(state).alias("state"), queue.alias("queue"))


def qstat_full(blobs: DataFrame) -> DataFrame:
    """Blocks opened by `Job Id:` with `key = value` lines: job_id, name, state, queue, exit_status."""
    split = blobs.select("id", F.split("value", _END).alias("_l"))
    opens = F.filter(F.transform("_l", lambda x, i: F.when(x.startswith("Job Id:"), i)), lambda i: i.isNotNull())
    split = split.select("id", "_l", opens.alias("_o")).select("id", "_l", "_o", F.posexplode("_o").alias("_n", "line"))
    end = F.coalesce(F.get("_o", F.col("_n") + 1), F.size("_l"))
    block = split.select("id", "line", F.transform(F.slice("_l", F.col("line") + 1, end - F.col("line")), _trimmed).alias("_b"))

    def value(key: str) -> Column:
        found = text.last_of(F.filter("_b", lambda x: x.startswith(f"{key} = ")))
        return F.substring(found, F.lit(len(key) + 4), F.length(found))

    return block.select(
        "id", "line", _trimmed(F.substring_index(F.col("_b")[0], "Job Id:", -1)).alias("job_id"), F.coalesce(value("Job_Name"), F.lit("")).alias("name"),
        F.coalesce(text.pbs_state(value("job_state")), F.lit("Q")).alias("state"), F.coalesce(value("queue"), F.lit("")).alias("queue"), value("Exit_status").cast("int").alias("exit_status"),
    )


def qstat_queues(blobs: DataFrame) -> DataFrame:
    """Queue names: the first words of flush-left lines after the first dashed line."""
    whole = F.split("value", _END)
    rows = blobs.select("id", _first_line(whole, lambda x: x.startswith("-")).alias("_head"), F.posexplode(whole).alias("line", "value"))
    body = rows.where((F.col("_head") >= 0) & (F.col("line") > F.col("_head")) & ~F.col("value").startswith("-") & F.col("value").rlike("^\\S"))
    return body.select("id", "line", _words("value")[0].alias("name"))


def resource_queues(blobs: DataFrame) -> DataFrame:
    """Enabled queues of a tree listing, its branches taken off."""
    rows = lines(blobs).where(F.col("value").contains("[ENABLE"))
    return rows.select("id", "line", _words(F.regexp_replace("value", "\\|--|`--", " "))[0].alias("name"))


def pueue(blobs: DataFrame) -> DataFrame:
    """Tasks of a status document: task, label, state, result, exit_code, start.

    A task's status is an object with one key, its state; a result is a name, or an object with one key and the code.
    """
    tasks = F.from_json(F.get_json_object("value", "$.tasks"), "map<string,string>")
    rows = blobs.select("id", F.explode(F.map_values(tasks)).alias("_t"))
    status = F.map_entries(F.from_json(F.get_json_object("_t", "$.status"), "map<string,string>"))
    rows = rows.withColumn("_s", F.get(status, F.lit(0)))
    rows = rows.withColumn("_r", F.get_json_object("_s.value", "$.result"))
    coded = F.col("_r").startswith("{")
    code = F.map_entries(F.from_json(F.when(coded, F.col("_r")), "map<string,string>"))[0]
    return rows.select(
        "id", F.get_json_object("_t", "$.id").cast("long").alias("task"), F.get_json_object("_t", "$.label").alias("label"), F.col("_s.key").alias("state"),
        F.when(coded, code["key"]).otherwise(F.col("_r")).alias("result"), F.when(coded & (code["key"] == "Failed"), code["value"].try_cast("int")).when(F.col("_r") == "Success", 0).alias("exit_code"),
        F.get_json_object("_s.value", "$.start").alias("start"),
    )


def capabilities(blobs: DataFrame) -> DataFrame:
    """Host capabilities from `key=value` lines; the last line of a key counts. A blob without such lines has no row."""
    rows = blobs.select("id", F.filter(F.split("value", _END), lambda x: x.contains("=")).alias("_l")).where(F.size("_l") > 0)

    def at(key: str) -> Column:
        found = text.last_of(F.filter("_l", lambda x: x.startswith(f"{key}=")))
        return F.substring(found, F.lit(len(key) + 2), F.length(found))

    name, memory = F.split_part(at("gpu"), F.lit(","), F.lit(1)), F.trim(F.regexp_extract(at("gpu"), "^[^,]*,(.*)$", 1))
    digits = lambda x, kind: F.when(x.rlike("^[0-9]+$"), x.try_cast(kind))
    return rows.select(
        "id", *[at(k).alias(k) for k in ("root", "kind", "account", "queue", "platform", "pixi", "uv")], F.nullif(F.trim(name), F.lit("")).alias("gpu_name"),
        digits(memory, "int").alias("gpu_mem_mb"), F.bround(digits(at("mem"), "long") / 1024**2).cast("int").alias("sysmem_gb"),
    )


def ssh_hosts(blobs: DataFrame) -> DataFrame:
    """Concrete aliases of `Host` lines, where each first stands; patterns are left out."""
    rows = lines(blobs).withColumn("_w", _words("value")).where(F.lower(F.get("_w", F.lit(0))) == "host")
    named = rows.select("id", "line", F.posexplode(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0)))).alias("_at", "alias")).where(~F.col("alias").rlike("[*?]"))
    first = named.groupBy("id", "alias").agg(F.min(F.struct("line", "_at")).alias("_f"))
    return first.select("id", "alias", F.col("_f.line").alias("line"), F.col("_f._at").alias("at"))


def cpu_records(blobs: DataFrame) -> DataFrame:
    """Blocks parted by blank lines, each as a map of its `key : value` lines, the last of a key counting: id, ordinal, fields."""
    blocks = blobs.select("id", F.posexplode(F.split(_trimmed(F.col("value")), "\n\n")).alias("ordinal", "_b"))
    pairs = F.transform(
        F.filter(F.split("_b", "\n"), lambda x: x.contains(":")),
        lambda x: F.struct(_trimmed(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), _trimmed(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")),
    )
    rows = blocks.select("id", "ordinal", pairs.alias("_e")).where(F.size("_e") > 0).withColumn("_k", F.array_distinct(F.transform("_e", lambda e: e["k"])))
    last = F.transform("_k", lambda k: text.last_of(F.filter("_e", lambda e: e["k"] == k))["v"])
    return rows.select("id", "ordinal", F.map_from_arrays("_k", last).alias("fields"))


def cgroup(blobs: DataFrame) -> DataFrame:
    """The group that caps memory, from `hierarchy:controllers:path` lines: version 2 before version 1's memory controller."""
    parts = F.split("value", ":", 3)
    rows = lines(blobs).where(F.size(parts) == 3).withColumn("_p", parts)
    rank = F.when((F.col("_p")[0] == "0") & (F.col("_p")[1] == ""), 2).when(F.array_contains(F.split(F.col("_p")[1], ","), "memory"), 1)
    best = rows.withColumn("version", rank).where("version IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("version", _trimmed(F.col("_p")[2]).alias("path")), F.struct(-F.col("version"), F.col("line"))).alias("_b"))
    return best.select("id", "_b.*")


def dotenv(blobs: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """Names and values of `.env` lines: comments and `export` dropped, one pair of quotes taken off; the first line of a name
    counts, and names that are defined already are left out."""
    entry = _trimmed(F.regexp_replace(_trimmed(F.col("value")), "^export ", ""))
    rows = lines(blobs).withColumn("_e", entry).where((F.col("_e") != "") & ~F.col("_e").startswith("#") & F.col("_e").contains("="))
    value = _trimmed(F.regexp_extract("_e", "^[^=]*=(.*)$", 1))
    rows = rows.select("id", "line", _trimmed(F.split_part("_e", F.lit("="), F.lit(1))).alias("name"), value.alias("_v"))
    quoted = F.col("_v").rlike("(?s)^(\".*\"|'.*')$") & (F.length("_v") >= 2)
    bare = F.when(quoted, F.expr("substring(_v, 2, length(_v) - 2)")).otherwise(F.col("_v"))
    first = rows.where("name <> ''").groupBy("id", "name").agg(F.min_by(bare, "line").alias("value"), F.min("line").alias("line"))
    return first if defined is None else first.join(defined.select(F.col("name").alias("_n")), F.col("name") == F.col("_n"), "left_anti")


def exit_markers(blobs: DataFrame, marker: str = "exit=") -> DataFrame:
    return blobs.select("id", text.exit_marker("value", marker).alias("exit_code"))


def breakages(blobs: DataFrame, path: str) -> DataFrame:
    """The failures that a tool's report lists at a dotted path."""
    return blobs.select("id", text.json_list("value", path).alias("breakages"))


def record_artifacts(blobs: DataFrame) -> DataFrame:
    """Native libraries that an install record (CSV) names."""
    first = F.regexp_replace(F.regexp_extract("value", '^("(?:[^"]|"")*"|[^,]*)', 1), '^"|"$', "")
    return lines(blobs).select("id", "line", first.alias("path")).where(F.col("path").rlike(r"\.(dylib|pyd|so)$"))


def installed_crates(blobs: DataFrame) -> DataFrame:
    """name, version from keys such as `"ripgrep 14.1.0 (registry+...)" = [...]`."""
    pattern = '^\\s*"([^ "]+) ([^ "]+) \\([^"]*\\)"\\s*='
    rows = lines(blobs).where(F.col("value").rlike(pattern))
    return rows.select("id", F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("version"))
