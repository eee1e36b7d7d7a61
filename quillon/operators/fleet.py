"""Hosts, devices and access: choices among them, admission, sections of a health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numeric, text

#: Processor makers by the ids in processor records, and by implementer codes; names of implementers and parts.
VENDOR_IDS = {"GenuineIntel": "intel", "AuthenticAMD": "amd"}
VENDOR_IMPLEMENTERS = {"0x41": "arm", "0x4e": "nvidia", "0x51": "qualcomm", "0x61": "apple"}
IMPLEMENTERS = {"0x41": "Arm", "0x4e": "NVIDIA", "0x51": "Qualcomm", "0x61": "Apple", "0xc0": "Ampere"}
PARTS = {("0x41", "0xd08"): "Cortex-A72", ("0x41", "0xd4f"): "Neoverse-V2", ("0x41", "0xd85"): "Cortex-X925", ("0x41", "0xd87"): "Cortex-A725"}
#: The order in which schedulers are looked for.
SCHEDULERS = ("pbs", "slurm", "pueue")


def smallest_fit(hosts: DataFrame, needs_gb: float) -> DataFrame:
    """The host with the least usable memory that suffices, the first of equals; an error without any."""
    fitting = hosts.where(numeric.fits("gpu_mem_mb", "sysmem_gb", needs_gb))
    best = fitting.agg(F.min_by(F.struct(*hosts.columns), F.struct(numeric.usable_memory_gb("gpu_mem_mb", "sysmem_gb"), F.col("ordinal"))).alias("_best"))
    missing = F.raise_error(F.lit(f"no host has {needs_gb} GB")).cast(best.schema["_best"].dataType)
    return best.select(F.when(F.col("_best").isNull(), missing).otherwise(F.col("_best")).alias("_best")).select("_best.*")


def first_usable(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The usable candidate of the highest priority; nothing without any."""
    usable = candidates.where("usable")
    best = usable.groupBy(*(by or [])).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in (by or [])]), "priority").alias("_best"))
    return best.where(F.col("_best").isNotNull()).select(*(by or []), "_best.*")


def scheduler(available: Column) -> Column:
    """The first scheduler, in the fixed order, that an array of names holds; `none` without any."""
    out = F.lit("none")
    for name in reversed(SCHEDULERS):
        out = F.when(F.array_contains(available, name), name).otherwise(out)
    return out


def refusal(rows: DataFrame) -> DataFrame:
    """Submissions with `refusal`: the first rule of their queue that they break, or null.

    Rows have walltime, mem_gb and the queue's submittable, max_walltime (empty for none), mem_ceiling_gb (0 for none), notes, queue.
    """
    note = F.when(F.col("notes") != "", F.concat(F.lit(" ("), F.col("notes"), F.lit(")"))).otherwise("")
    over = ~admits_walltime("max_walltime", "walltime")
    heavy = (F.col("mem_ceiling_gb") > 0) & (F.col("mem_gb") > F.col("mem_ceiling_gb"))
    return rows.withColumn(
        "refusal",
        F.when(~F.col("submittable"), F.concat(F.lit("queue "), F.col("queue"), F.lit(" takes no jobs"), note))
        .when(over, F.concat(F.lit("walltime "), F.col("walltime"), F.lit(" is over the ceiling of "), F.col("max_walltime"), note))
        .when(heavy, F.format_string("%d GB are over the ceiling of %d GB", "mem_gb", "mem_ceiling_gb")),
    )


def admits_walltime(ceiling: Column | str, walltime: Column | str) -> Column:
    c = F.col(ceiling) if isinstance(ceiling, str) else ceiling
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(True)).otherwise(numeric.walltime_seconds(walltime) <= numeric.walltime_seconds(F.when(c != "", c)))


def hardware_summary(gpus: DataFrame, hosts: DataFrame, by: str = "hostname") -> DataFrame:
    """Per host: its devices by model in the order they are listed, then its memory, as one line of text."""
    models = gpus.groupBy(by, "name").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    listed = models.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", F.format_string("%dx %s", "n", "name").alias("text")))).alias("_m"))
    memory = F.format_string("%.0f GB RAM", F.col("memory_total_bytes") / 1e9)
    met = hosts.join(listed, by, "left")
    return met.select(by, F.concat_ws(", ", F.transform("_m", lambda x: x["text"]), memory).alias("summary"))


def core_mix(records: DataFrame, by: str = "hostname") -> DataFrame:
    """Per host: its cores by kind in the order of its processor records (implementer, part, ordinal), with `Nx` before kinds of several cores."""
    names = F.create_map(*[F.lit(x) for kv in IMPLEMENTERS.items() for x in kv])
    parts = F.create_map(*[F.lit(x) for (i, p), name in PARTS.items() for x in (f"{i}/{p}", name)])
    implementer, part = F.lower("implementer"), F.lower("part")
    told = records.where((F.coalesce(implementer, F.lit("")) != "") & (F.coalesce(part, F.lit("")) != ""))
    kinds = told.groupBy(by, implementer.alias("_i"), part.alias("_p")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    maker = F.coalesce(F.try_element_at(names, F.col("_i")), F.concat(F.lit("implementer "), F.col("_i")))
    model = F.coalesce(F.try_element_at(parts, F.concat_ws("/", "_i", "_p")), F.concat(F.lit("part "), F.col("_p")))
    text_of = F.concat_ws(" ", F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("x"))), maker, model)
    listed = kinds.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", text_of.alias("text")))).alias("_k"))
    return listed.select(by, F.concat_ws(" + ", F.transform("_k", lambda x: x["text"])).alias("cores"))


def vendor(records: DataFrame, by: str = "hostname") -> DataFrame:
    """Per host: the maker that the first telling record names, by its id and then by its implementer; `unknown` without any."""
    ids = F.create_map(*[F.lit(x) for kv in VENDOR_IDS.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in VENDOR_IMPLEMENTERS.items() for x in kv])
    told = F.coalesce(F.try_element_at(ids, F.coalesce("vendor_id", F.lit(""))), F.try_element_at(codes, F.lower(F.coalesce("implementer", F.lit("")))))
    rows = records.withColumn("_v", told)
    return rows.groupBy(by).agg(F.coalesce(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("ordinal"))), F.lit("unknown")).alias("vendor"))


def release_flags(arch: Column | str, cpu: Column | str) -> Column:
    a, c = (F.col(x) if isinstance(x, str) else x for x in (arch, cpu))
    core = F.when(F.lower(c).contains("neoverse-v2"), "neoverse-v2").otherwise("native")
    none = F.array().cast("array<string>")
    return F.when(a == "aarch64", F.array(F.concat(F.lit("-mcpu="), core))).when(a.isin("x86_64", "amd64"), F.array(F.lit("-march=native"), F.lit("-mtune=native"))).otherwise(none)


def enforced_limit(caps: DataFrame, paths: DataFrame) -> DataFrame:
    """Per path: the least finite cap of it and all folders above it, null without any. Caps have path, limit_bytes (null for none)."""
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    above = paths.select("path", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("_d"), parts.alias("_p"))
    above = above.select("path", F.concat(F.lit("/"), F.concat_ws("/", F.slice("_p", F.lit(1), F.col("_d")))).alias("_folder")).distinct()
    c = caps.select(F.col("path").alias("_path"), "limit_bytes")
    return above.join(c, F.col("_folder") == F.col("_path"), "left").groupBy("path").agg(F.min("limit_bytes").alias("limit_bytes"))


def drive_partitions(drives: DataFrame, partitions: DataFrame) -> DataFrame:
    """Each drive of a host with the partitions whose device begins with its name.

    Drives and partitions meet on the host and the first letters of the name, so that no host's lists are crossed whole.
    """
    key = lambda c: F.substring(c, 1, 2)
    d = drives.select(F.col("host").alias("_host"), F.col("name").alias("drive"))
    met = partitions.join(d, (F.col("host") == F.col("_host")) & (key(F.col("device")) == key(F.col("drive"))) & F.col("device").startswith(F.col("drive")))
    return met.drop("_host").withColumns({"readonly": F.array_contains(F.split("options", ","), "ro"), "utilization_pct": numeric.share("used_bytes", "total_bytes")})


def drives(blocks: DataFrame, skip: tuple[str, ...] = ("loop", "ram", "zram", "dm-")) -> DataFrame:
    """Block devices with a size, without virtual ones, by name."""
    size = F.col("size").try_cast("long")
    return blocks.where((~F.col("name").rlike("^(" + "|".join(skip) + ")")) & (size > 0)).withColumn("size", size).orderBy("host", "name")


def total_bytes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("host").agg(F.sum("size").cast("long").alias("total_bytes"))


def best_capability(devices: DataFrame, by: str = "host") -> DataFrame:
    """Per host: the highest (major, minor) capability with its family and target; an error for hosts without any is left to the caller."""
    top = devices.groupBy(by).agg(F.max(F.struct("major", "minor")).alias("_c")).select(by, "_c.*")
    return top.withColumns({"family": numeric.capability_family("major", "minor"), "target": numeric.capability_target("major", "minor")})


def access(hosts: DataFrame, setups: DataFrame) -> DataFrame:
    """Declared hosts (no provider kinds) with access: unreachable, reachable (never set up) or ready, and the detail."""
    s = setups.select(F.col("alias").alias("_alias"), "env", "hardware")
    met = hosts.where(F.coalesce(F.col("kind"), F.lit("")) != "provider").join(s, F.col("name") == F.col("_alias"), "left")
    dead = F.coalesce(F.col("refusal"), F.lit("")) != ""
    return met.select(
        "name", "kind", F.when(dead, "unreachable").when(F.col("_alias").isNull(), "reachable").otherwise("ready").alias("access"),
        F.when(dead, F.col("refusal")).when(F.col("_alias").isNull(), "never set up").otherwise(F.coalesce("hardware", F.concat(F.col("env"), F.lit(", hardware unrecorded")))).alias("detail"),
    )


def provider_access(providers: DataFrame) -> DataFrame:
    """Providers with access: unkeyed without an account, unreachable on a fault, else keyed as their standing says."""
    kind = (
        F.when(~F.col("has_account"), "unkeyed").when(F.col("fault").isNotNull(), "unreachable")
        .when(F.coalesce(F.col("keyed"), F.lit(False)), "keyed").otherwise("unkeyed")
    )
    return providers.withColumn("access", kind)


#: Verdicts of report sections, from best to worst.
WORST = ("pass", "warn", "fail")


def worst(verdicts: Column) -> Column:
    """The worst verdict of an array; pass for none."""
    out = F.lit("pass")
    for v in WORST:
        out = F.when(F.array_contains(verdicts, v), v).otherwise(out)
    return out


def fleet_section(paths: DataFrame) -> DataFrame:
    """One row: how many paths are usable, the names of each class, and the verdict: fail without a usable path, warn with an unreachable one."""
    usable = F.col("access").isin("here", "ready", "keyed")
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("access") == kind, F.col("name")))).alias(kind)
    out = paths.agg(F.count_if(usable).cast("long").alias("usable"), *[names(k) for k in ("here", "ready", "reachable", "unreachable", "keyed", "unkeyed")])
    return out.withColumn("verdict", F.when(F.col("usable") == 0, "fail").when(F.size("unreachable") > 0, "warn").otherwise("pass"))


def gate_section(gates: DataFrame) -> DataFrame:
    """Gates with verdict and detail. Rows have run, report, install, timed_out, status, breakages (array), last_line."""
    clean = F.col("status") == 0
    broken = F.size("breakages") > 0
    verdict = F.when(F.col("timed_out"), "warn").when(clean, "pass").when(broken, "fail").when(F.col("report") != "", "warn").otherwise("fail")
    exited = F.format_string("`%s` exited %d", "run", "status")
    detail = (
        F.when(F.col("timed_out"), F.format_string("`%s` did not answer in time", "run")).when(clean, F.format_string("`%s` reports nothing broken", "run"))
        .when(broken, F.concat(F.size("breakages").cast("string"), F.lit(" breakages: "), F.concat_ws(", ", "breakages")))
        .when(F.col("report") != "", F.concat(exited, F.lit(" without a report"))).otherwise(F.coalesce(F.nullif(F.col("last_line"), F.lit("")), exited))
    )
    return gates.withColumns({"verdict": verdict, "detail": detail})


def idle_since(samples: DataFrame, by: list[str], duration: float) -> DataFrame:
    """Per device: the first sample at which it has been idle for a duration without a busy sample between. Samples have at (seconds), busy."""
    order = Window.partitionBy(*by).orderBy("at")
    island = F.sum(F.col("busy").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    quiet = samples.withColumn("_island", island).where("NOT busy").withColumn("_from", F.min("at").over(Window.partitionBy(*by, "_island")))
    return quiet.where(F.col("at") - F.col("_from") >= duration).groupBy(*by).agg(F.min("at").alias("idle_at"))


def route(kind: Column | str, providers: tuple[str, ...]) -> Column:
    """`ssh-family` for scheduler kinds, the provider's name for providers; an unknown kind is an error."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin("auto", "local", *SCHEDULERS), "ssh-family").when(k.isin(*providers), k).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), k)).cast("string"))


def submit_flags(kind: str, log: str = "logs/%j.log") -> Column:
    """Submission flags from resource columns (gpus, walltime, queue, account, mem_gb, nodes, script); unset ones are left out."""
    has = lambda c, flag: F.when(F.col(c).isNotNull(), F.concat(F.lit(flag), F.col(c).cast("string")))
    some = lambda c, flag: F.when(F.col(c).cast("string").isNotNull() & ~F.col(c).cast("string").isin("", "0"), F.concat(F.lit(flag), F.col(c).cast("string")))
    if kind == "slurm":
        memory = F.when(F.col("mem_gb").isNotNull(), F.concat(F.lit("--mem="), F.col("mem_gb").cast("string"), F.lit("G")))
        return F.array_compact(F.array(F.lit("sbatch"), F.lit(f"--output={log}"), some("gpus", "--gpus="), has("walltime", "--time="), has("queue", "--partition="), some("account", "--account="), memory, F.col("script")))
    memory = F.when(F.col("mem_gb").isNotNull(), F.concat(F.lit("select="), F.col("nodes").cast("string"), F.lit(":mem="), F.col("mem_gb").cast("string"), F.lit("gb")))
    flag = lambda name, value: F.when(value.isNotNull(), F.array(F.lit(name), value)).otherwise(F.array().cast("array<string>"))
    return F.concat(flag("-q", F.col("queue")), flag("-l", has("walltime", "walltime=")), flag("-W", some("account", "group_list=")), flag("-l", memory))


def busy_devices(devices: DataFrame) -> DataFrame:
    return devices.withColumn("busy", numeric.device_busy("util_pct", "memory_pct"))


def fleet_states(handles: DataFrame, rentals: DataFrame, marker: str = "exit=") -> DataFrame:
    """Asked handles with the verdicts of their rentals, the exit code taken from the end of the log."""
    r = rentals.select(F.col("handle").alias("_h"), "status", text.exit_marker("log", marker).alias("exit_code"))
    return handles.join(r, F.col("handle") == F.col("_h"), "left").select("handle", "status", "exit_code", text.instance_verdict("status", "exit_code").alias("verdict"))
