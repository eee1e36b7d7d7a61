"""Registered queries over hosts, devices, configuration layers, packages and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import adapters as a
from quillon.functions import exact, numeric, text
from quillon.operators import config, costs, fleet, frames, lab, packages, render, state, trace
from quillon.plans.listings import said
from quillon.plans.queries import FRAMES, ORACLE_SQL, READINGS, RUNS, query, swept
from quillon.session import table
from quillon.sources import market


def _strings(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items]).cast("array<string>")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'pbs' WHEN c_custkey % 3 = 1 THEN 'pueue' ELSE 'none' END AS scheduler,
    CASE WHEN c_custkey % 4 = 0 THEN '-mcpu=neoverse-v2' WHEN c_custkey % 4 = 1 THEN '-mcpu=native' WHEN c_custkey % 4 = 2 THEN '-march=native -mtune=native' ELSE '' END AS flags,
    CASE c_custkey % 3 WHEN 0 THEN 'ssh-family' WHEN 1 THEN 'rent' ELSE 'ssh-family' END AS route, c_custkey % 100 > 10 OR c_custkey % 97 > 90 AS busy,
    CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 90) * 1000 / 1024.0::DOUBLE ELSE CAST(c_custkey % 64 AS DOUBLE) END AS memory_gb,
    CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 90) * 1000 / 1024.0::DOUBLE ELSE c_custkey % 64 END >= 24.0 AS fits,
    CASE c_custkey % 3 WHEN 0 THEN 'osx-arm64,osx,unix' WHEN 1 THEN 'linux-64,linux,unix' ELSE 'wasi' END AS selectors,
    CASE WHEN c_custkey % 2 = 0 THEN '/abs/' || c_custkey WHEN c_custkey % 7 = 0 THEN '..' ELSE '../p' || c_custkey END AS shifted,
    'm@' || CASE c_custkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'v' || c_custkey || '.0' WHEN 2 THEN 'v1' ELSE 'main' END AS reference,
    CASE c_custkey % 5 WHEN 0 THEN 'vanished' WHEN 1 THEN 'running' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'ok' END WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'ok' END ELSE 'unknown' END AS rental,
    CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'ok' ELSE 'unknown' END AS console, c_custkey % 3 = 0 AS failed,
    CASE WHEN c_custkey % 2 = 0 THEN 'over' WHEN c_custkey % 3 = 0 THEN '' ELSE 'own' END AS planned FROM customer""")
def host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that look at one row of a host, a package or a rental."""
    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<int>")
    code = F.when(k % 2 == 1, 0)
    rows = table(spark, sf, "customer").withColumns({
        "_names": F.when(k % 3 == 0, _strings("slurm", "pbs")).when(k % 3 == 1, _strings("pueue")).otherwise(_strings()),
        "_status": F.when(k % 5 == 0, none).otherwise(pick(5, "", "loading", "exited", "offline", "odd")),
        "summaries": F.when(k % 3 == 0, empty).otherwise(F.array(F.lit(1))), "kernels": F.when(k % 6 == 1, F.array(F.lit(1))).otherwise(empty),
    })
    return lab.has_failed(rows).select(
        "c_custkey", fleet.scheduler(F.col("_names")).alias("scheduler"),
        F.concat_ws(" ", fleet.release_flags(pick(4, "aarch64", "aarch64", "amd64", "riscv"), pick(4, "Neoverse-V2", "x", "x", "x"))).alias("flags"),
        fleet.route(pick(3, "auto", "rent", "pbs"), ("rent",)).alias("route"), numeric.device_busy(k % 100, k % 97).alias("busy"),
        numeric.usable_memory_gb(F.when(k % 5 > 0, (k % 90) * 1000), k % 64).alias("memory_gb"), numeric.fits(F.when(k % 5 > 0, (k % 90) * 1000), k % 64, 24.0).alias("fits"),
        F.concat_ws(",", config.selectors(pick(3, "osx-arm64", "linux-64", "wasi"))).alias("selectors"),
        packages.shifted_path(F.when(k % 2 == 0, said("/abs/", k)).when(k % 7 == 0, "").otherwise(said("p", k))).alias("shifted"),
        packages.module_reference(F.lit("m"), F.when(k % 4 == 0, "*").when(k % 4 == 1, said(k, ".0")).otherwise(pick(4, "", "", "v1", "main"))).alias("reference"),
        text.instance_verdict("_status", code).alias("rental"), text.looked_up(pick(3, "Live", "gone", "odd"), {"live": "running", "gone": "ok"}).alias("console"), "failed",
        config.resolved_plan(F.when(k % 3 == 0, "none").otherwise("own"), F.when(k % 2 == 0, "over").otherwise("")).alias("planned"),
    )


@query("""SELECT p_partkey, '_ZN1a' || length(p_brand) || p_brand || 'E' AS name, 'a.' || p_brand AS readable, CASE CAST(p_size AS BIGINT) % 4 WHEN 0 THEN 1 ELSE 0 END + 0 AS zero,
    CAST(p_size * 16 + p_partkey % 100 AS BIGINT) AS shared, (p_size || 'x' || (p_partkey % 5) || 'x1') AS grid, substr(sha256('e:' || sha256('{"a":' || p_size || '}') || ':r' || (p_partkey % 3)), 1, 12) AS study FROM part""")
def kernel_names(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    mangled = F.concat(F.lit("_ZN1a"), F.length("p_brand"), F.col("p_brand"), F.lit("E"))
    return table(spark, sf, "part").select(
        "p_partkey", mangled.alias("name"), exact.readable_name(mangled).alias("readable"), F.when(size % 4 == 0, 1).otherwise(0).alias("zero"), numeric.shared_memory((size * 16).cast("long"), k % 100).alias("shared"),
        numeric.launch_shape(size, k % 5, F.lit(1)).alias("grid"), exact.study_id(F.lit("e"), said('{"a": ', size, "}"), said("r", k % 3)).alias("study"),
    )


@query("""SELECT o_orderkey, round(o_totalprice / 7, 4) AS rounded FROM orders""")
def rounded_standings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", exact.round4(F.col("o_totalprice") / 7).alias("rounded"))


@query("""WITH r AS (SELECT s_nationkey AS host, s_suppkey AS ordinal, CASE s_suppkey % 4 WHEN 0 THEN 'AuthenticAMD' WHEN 1 THEN 'other' END AS vendor_id, CASE s_suppkey % 3 WHEN 0 THEN '0x41' WHEN 1 THEN '0xC0' ELSE '0x99' END AS implementer,
        CASE s_suppkey % 2 WHEN 0 THEN '0xd4f' ELSE '0x123' END AS part FROM supplier),
    v AS (SELECT *, CASE WHEN vendor_id = 'AuthenticAMD' THEN 'amd' WHEN implementer = '0x41' THEN 'arm' END AS v FROM r),
    kinds AS (SELECT host, implementer, part, count(*) AS n, min(ordinal) AS first FROM r GROUP BY ALL),
    named AS (SELECT *, CASE WHEN n > 1 THEN n || 'x ' ELSE '' END || CASE implementer WHEN '0x41' THEN 'Arm' WHEN '0xC0' THEN 'Ampere' ELSE 'implementer 0x99' END || ' ' || CASE WHEN implementer = '0x41' AND part = '0xd4f' THEN 'Neoverse-V2' ELSE 'part ' || part END AS t FROM kinds)
    SELECT v.host, coalesce(arg_min(v.v, v.ordinal) FILTER (WHERE v.v IS NOT NULL), 'unknown') AS vendor, (SELECT string_agg(t, ' + ' ORDER BY first) FROM named WHERE named.host = v.host) AS cores FROM v GROUP BY v.host""")
def processor_makers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("host"), k.alias("ordinal"), F.when(k % 4 == 0, "AuthenticAMD").when(k % 4 == 1, "other").alias("vendor_id"),
        F.when(k % 3 == 0, "0x41").when(k % 3 == 1, "0xC0").otherwise("0x99").alias("implementer"), F.when(k % 2 == 0, "0xd4f").otherwise("0x123").alias("part"),
    )
    return fleet.vendor(rows, "host").join(fleet.core_mix(rows, "host"), "host")


@query("""WITH d AS (SELECT s_nationkey AS host, CASE s_suppkey % 4 WHEN 0 THEN 'loop' ELSE 'sd' END || s_suppkey AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 10 ELSE 0 END AS size FROM supplier)
    SELECT host, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS drives, string_agg(name, ',' ORDER BY name) AS names FROM d WHERE name NOT LIKE 'loop%' AND size > 0 GROUP BY host""")
def host_drives(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    blocks = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("host"), said(F.when(k % 4 == 0, "loop").otherwise("sd"), k).alias("name"), F.when(k % 5 > 0, (k * 10).cast("string")).otherwise("0").alias("size"))
    found = fleet.drives(blocks)
    named = found.groupBy("host").agg(F.count("*").cast("long").alias("drives"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return fleet.total_bytes(found).join(named, "host")


@query("""SELECT s_nationkey AS host, 'sd' || s_suppkey || 'x' AS drive, 'sd' || s_suppkey || 'xp' || r_regionkey AS device, r_regionkey = 2 AS readonly, CASE WHEN r_regionkey > 0 THEN 100.0::DOUBLE * r_regionkey / 8 ELSE 0.0 END AS utilization_pct
    FROM supplier, region""")
def drive_partitions(spark: SparkSession, sf: str) -> DataFrame:
    drive = said("sd", F.col("s_suppkey"), "x")
    drives = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("host"), drive.alias("name"))
    regions = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")
    parts = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("host"), drive.alias("name"), regions)
    r = F.col("r")
    parts = parts.select("host", F.concat("name", F.lit("p"), r).alias("device"), F.when(r == 2, "ro,x").otherwise("rw,nro").alias("options"), r.cast("long").alias("used_bytes"), F.when(r > 0, 8).otherwise(0).cast("long").alias("total_bytes"))
    return fleet.drive_partitions(drives, parts).select("host", "drive", "device", "readonly", "utilization_pct")


@query("""WITH c AS (SELECT c_nationkey AS host, c_custkey % 13 AS major, c_custkey % 10 AS minor FROM customer), t AS (SELECT host, max({'a': major, 'b': minor}) AS m FROM c GROUP BY host)
    SELECT t.host, CAST(m.a AS BIGINT) AS major, CAST(m.b AS BIGINT) AS minor, 'sm_' || m.a || m.b AS target, u.path, CAST(u.p AS BIGINT) AS priority FROM t LEFT JOIN (
        SELECT c_nationkey AS host, arg_min('/s' || c_custkey, c_custkey) AS path, min(c_custkey) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL) u USING (host)""")
def host_choices(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").withColumn("host", F.col("c_nationkey"))
    best = fleet.best_capability(rows.select("host", (k % 13).alias("major"), (k % 10).alias("minor"))).select("host", "major", "minor", "target")
    usable = fleet.first_usable(rows.select("host", said("/s", k).alias("path"), k.alias("priority"), (k % 3 == 0).alias("usable")), ["host"])
    return best.join(usable.drop("usable"), "host", "left")


@query("""WITH h AS (SELECT s_suppkey AS ordinal, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 * 10240 END AS mb, s_suppkey % 5 * 16 AS sys FROM supplier), m AS (SELECT *, coalesce(mb / 1024.0::DOUBLE, sys) AS gb FROM h)
    SELECT CAST(arg_min(ordinal, {'a': gb, 'b': ordinal}) AS BIGINT) AS ordinal, CAST(arg_min(mb, {'a': gb, 'b': ordinal}) AS BIGINT) AS gpu_mem_mb FROM m WHERE gb >= 24""")
def smallest_host(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    hosts = table(spark, sf, "supplier").select(k.alias("ordinal"), F.when(k % 3 > 0, k % 7 * 10_240).alias("gpu_mem_mb"), (k % 5 * 16).alias("sysmem_gb"))
    return fleet.smallest_fit(hosts, 24.0).select("ordinal", "gpu_mem_mb")


@query("""WITH p AS (SELECT c_custkey, 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS name, CASE WHEN c_custkey % 7 = 0 THEN 'unkeyed' WHEN c_custkey % 11 = 0 THEN 'unreachable' WHEN c_custkey % 2 = 0 THEN 'keyed' ELSE 'unkeyed' END AS access FROM customer)
    SELECT count(*) FILTER (WHERE access = 'keyed') AS usable, CAST(count(*) FILTER (WHERE access = 'unkeyed') AS INT) AS unkeyed, string_agg(name, ',' ORDER BY name) FILTER (WHERE access = 'unreachable') AS unreachable, 'warn' AS verdict FROM p""")
def fleet_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    providers = table(spark, sf, "customer").select(said("c", F.lpad(k.cast("string"), 8, "0")).alias("name"), (k % 7 > 0).alias("has_account"), F.when(k % 11 == 0, "down").alias("fault"), (k % 2 == 0).alias("keyed"))
    return fleet.fleet_section(fleet.provider_access(providers)).select("usable", F.size("unkeyed").alias("unkeyed"), F.concat_ws(",", "unreachable").alias("unreachable"), "verdict")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'warn' WHEN s_suppkey % 6 = 1 THEN 'pass' WHEN s_suppkey % 6 = 2 THEN 'fail' WHEN s_suppkey % 6 = 3 THEN 'warn' ELSE 'fail' END AS verdict,
    CASE WHEN s_suppkey % 6 = 2 THEN '2 breakages: a, b' WHEN s_suppkey % 6 = 3 THEN '`run` exited 3 without a report' WHEN s_suppkey % 6 = 4 THEN 'last ' || s_suppkey WHEN s_suppkey % 6 = 5 THEN '`run` exited 5' ELSE '' END AS detail FROM supplier""")
def gate_reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    m = k % 6
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.lit("run").alias("run"), F.when(m == 3, "r").otherwise("").alias("report"), F.lit("i").alias("install"), (m == 0).alias("timed_out"), F.when(m == 1, 0).otherwise(m.cast("int")).alias("status"),
        F.when(m == 2, _strings("a", "b")).otherwise(_strings()).alias("breakages"), F.when(m == 4, said("last ", k)).otherwise("").alias("last_line"),
    )
    return fleet.gate_section(rows).select("s_suppkey", "verdict", F.when(m < 2, "").otherwise(F.col("detail")).alias("detail"))


@query(f"""WITH {RUNS}, j AS (SELECT o_custkey, max(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT CAST(o_custkey AS VARCHAR) || '.srv' AS handle, CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'R' ELSE 'E' END AS state, CAST(CASE WHEN k % 4 > 0 THEN k % 4 - 1 END AS INT) AS exit_code,
           CASE WHEN k % 3 = 1 THEN 'running' WHEN k % 4 = 0 THEN 'unknown' WHEN k % 4 = 1 THEN 'ok' ELSE 'failed' END AS verdict FROM j WHERE o_custkey % 3 > 0""")
def scheduler_states(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    records = table(spark, sf, "orders").select(said(c, ".other.net").alias("job_id"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "R").otherwise("E").alias("state"), F.when(k % 4 > 0, (k % 4 - 1).cast("int")).alias("exit_status"), k.alias("ordinal"))
    handles = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(said(F.col("c_custkey"), ".srv").alias("handle"))
    return state.queue_states(handles, records)


@query("""SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'pbs' ELSE 'auto' END ELSE 'slurm' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN '/own' WHEN n_nationkey % 3 = 0 THEN '/f' || n_nationkey ELSE '' END AS root,
    CASE WHEN n_nationkey % 3 = 0 THEN 'acct' ELSE '' END AS account FROM nation""")
def filled_profiles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    profiles = nation.select(said("n", k).alias("name"), F.when(k % 2 == 0, "auto").otherwise("slurm").alias("kind"), F.when(k % 4 == 0, "/own").otherwise("").alias("root"), F.lit("").alias("account"))
    facts = nation.where(k % 3 == 0).select(said("n", k).alias("name"), F.lit("pbs").alias("kind"), said("/f", k).alias("root"), F.lit("acct").alias("account"))
    return config.filled(profiles, facts)


@query("""WITH s AS (SELECT n_nationkey AS ordinal, ['base', 'dev', 'env'][n_nationkey % 3 + 1] AS kind, 'e' || (n_nationkey % 2) AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'linux' END AS platform FROM nation),
    p AS (SELECT *, CASE WHEN kind = 'base' THEN CASE WHEN platform IS NULL THEN 0 ELSE 1 END WHEN kind = 'env' AND name = 'e1' THEN CASE WHEN platform IS NULL THEN 3 ELSE 4 END END AS place FROM s)
    SELECT ordinal, kind, CAST(row_number() OVER (ORDER BY place, ordinal) AS INT) AS rank FROM p WHERE place IS NOT NULL""")
def scope_layers(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("n_nationkey")
    scopes = table(spark, sf, "nation").select(k.alias("ordinal"), F.element_at(_strings("base", "dev", "env"), (k % 3 + 1).cast("int")).alias("kind"), said("e", k % 2).alias("name"), F.when(k % 5 == 0, "linux").alias("platform"))
    return config.layer_order(scopes, "e1").select("ordinal", "kind", F.row_number().over(Window.orderBy("layer")).alias("rank"))  # scopes of one manifest


@query("""WITH d AS (SELECT p_partkey AS k, 'pkg' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name FROM part)
    SELECT string_agg(name, ',' ORDER BY name) FILTER (WHERE k % 10 = 0 AND k % 4 > 0) AS absent, string_agg(name, ',' ORDER BY name) FILTER (WHERE k % 10 > 0 AND k % 21 = 0) AS damaged,
           CAST(count(*) FILTER (WHERE k % 10 > 0 AND (k % 3 = 0 OR k % 5 = 0)) AS INT) AS stale, 'fail' AS verdict FROM d WHERE k % 10 > 0 OR k % 4 > 0""")
def environment_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf, "part").withColumn("name", said("pkg", F.lpad(k.cast("string"), 8, "0")))
    declared = part.where((k % 10 > 0) | (k % 4 > 0)).select("name", F.lit("new").alias("digest"))
    installed = part.where(k % 10 > 0).select("name", (k % 21 == 0).alias("damaged"))
    recorded = part.where(k % 5 > 0).select("name", F.when(k % 3 == 0, "old").otherwise("new").alias("digest"))
    return packages.environment_section(declared, installed, recorded).select(F.concat_ws(",", "absent").alias("absent"), F.concat_ws(",", "damaged").alias("damaged"), F.size("stale").alias("stale"), "verdict")


@query("""SELECT 'pkg' || (p_size % 9) AS name, CAST(max(CASE WHEN p_type LIKE '%STEEL' THEN p_partkey END) AS BIGINT) AS steel, count(*) AS calls FROM part GROUP BY ALL""")
def newest_sources(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select(said("pkg", F.col("p_size") % 9).alias("name"), F.col("p_type").alias("path"), F.col("p_partkey").alias("mtime"))
    newest = packages.newest(files, ["name"], "STEEL$").select("name", F.nullif("newest", F.lit(0).cast("long")).alias("steel"))
    return newest.join(trace.calls_by_name(files), "name")


@query("""WITH c AS (SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders), m AS (SELECT sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS v FROM lineitem)
    SELECT c.v::DOUBLE AS credit_usd, m.v::DOUBLE AS metered_usd, (c.v - m.v)::DOUBLE AS remaining_usd, NULL::VARCHAR AS note, (SELECT min(l_extendedprice) FROM lineitem) AS cheapest_usd_hr FROM c, m""")
def account_standing(spark: SparkSession, sf: str) -> DataFrame:
    money = lambda name: F.col(name).cast("decimal(18, 2)").alias("usd")  # noqa: E731 - sums of whole cents
    lines = table(spark, sf, "lineitem")
    out = costs.standing(table(spark, sf, "orders").select(money("o_totalprice")), lines.select(money("l_extendedprice")), lines.select(F.col("l_extendedprice").alias("rate_usd_hr")))
    return out.withColumns({c: F.col(c).cast("double") for c in ("credit_usd", "metered_usd", "remaining_usd")})


@query("""SELECT 'c' || c_custkey AS name, c_acctbal - c_custkey AS remaining_usd FROM customer WHERE c_custkey % 5 > 0 ORDER BY c_mktsegment <> 'BUILDING', c_custkey DESC LIMIT 1""")
def budget_left(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(said("c", k).alias("name"), F.when(k % 5 > 0, F.col("c_acctbal")).alias("budget_usd"), k.alias("usage_usd"), (F.col("c_mktsegment") == "BUILDING").alias("is_default"), (-k).alias("ordinal"))
    return costs.budgeted(rows)


@query("""SELECT DISTINCT c_mktsegment AS name FROM customer""")
def package_names(spark: SparkSession, sf: str) -> DataFrame:
    return packages.names(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))


@query("""SELECT DISTINCT CAST(0 AS INT) AS depth, 'x' AS file FROM nation UNION SELECT 1, 'r' || n_regionkey || '/x' FROM nation UNION SELECT 2, 'r' || n_regionkey || '/n' || n_nationkey || '/x' FROM nation""")
def control_files(spark: SparkSession, sf: str) -> DataFrame:
    return config.ancestors(table(spark, sf, "nation").select(said("/r", F.col("n_regionkey"), "/n", F.col("n_nationkey"), "/f").alias("path")), "x")


@query("""SELECT r_name AS platform, n_name AS environment FROM region, nation WHERE n_nationkey % 3 = 0 OR (r_regionkey = n_regionkey)""")
def platform_matrix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    region = table(spark, sf, "region")
    only = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.when(k % 3 > 0, F.array("r_name")).alias("platforms"))
    return config.expanded(region.select(F.col("r_name").alias("name")), only)


@query("""SELECT 'd' || (p_partkey % 40) AS name, arg_max(p_name, p_partkey) AS source_path, map_extract(MAP {'a': 'own', 'b': 'base'}, 'a')[1] || ',base' AS vars FROM part WHERE p_size % 2 = 0 GROUP BY ALL""")
def local_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(said("d", k % 40).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("source_path"), k.alias("layer"))
    merged = config.map_over(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("base")), F.create_map(F.lit("a"), F.lit("own")))
    return config.local_paths(rows).select("name", "source_path", F.concat_ws(",", merged["a"], merged["b"]).alias("vars"))


@query("""SELECT o_orderkey, 'sbatch --output=logs/%j.log' || CASE WHEN o_orderkey % 4 > 0 THEN ' --gpus=' || (o_orderkey % 4) ELSE '' END || ' --time=01:00:00' || CASE WHEN o_orderkey % 3 > 0 THEN ' --partition=q' || (o_orderkey % 3) ELSE '' END
        || CASE WHEN o_orderkey % 5 = 0 THEN ' --mem=8G' ELSE '' END || ' run.sh' AS slurm,
    CASE WHEN o_orderkey % 3 > 0 THEN '-q q' || (o_orderkey % 3) || ' ' ELSE '' END || '-l walltime=01:00:00' || CASE WHEN o_orderkey % 5 = 0 THEN ' -l select=2:mem=8gb' ELSE '' END AS pbs FROM orders""")
def submission_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (k % 4).alias("gpus"), F.lit("01:00:00").alias("walltime"), F.when(k % 3 > 0, said("q", k % 3)).alias("queue"), F.lit("").alias("account"), F.when(k % 5 == 0, 8).alias("mem_gb"), F.lit(2).alias("nodes"), F.lit("run.sh").alias("script"),
    )
    return rows.select("o_orderkey", F.concat_ws(" ", fleet.submit_flags("slurm")).alias("slurm"), F.concat_ws(" ", fleet.submit_flags("pbs")).alias("pbs"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_size || '.0' ELSE '*' END AS version FROM part""")
def requirements(spark: SparkSession, sf: str) -> DataFrame:
    version = F.when(F.col("p_partkey") % 9 == 0, said(F.col("p_size"), ".0")).otherwise("*")
    return table(spark, sf, "part").select("p_partkey", packages.requirement("p_name", version, F.array().cast("array<string>")).alias("version"))


@query("""SELECT sha256('{"m":1}' || string_agg(CASE WHEN n_nationkey % 7 = 0 THEN chr(0) ELSE n_name END, '' ORDER BY n_name)) AS digest FROM nation""")
def resolution_digest(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 7 > 0, F.col("n_name").cast("binary")).alias("content"))
    return packages.resolution_digest(spark.range(1).select(F.lit('{"m":1}').alias("value")), files)


@query("""SELECT p_name || ' ' || md5(p_name) AS value FROM part""")
def sync_lines(spark: SparkSession, sf: str) -> DataFrame:
    return packages.sync_state(table(spark, sf, "part").select(F.col("p_name").alias("name"), F.md5("p_name").alias("digest")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 100.0::DOUBLE / (event_id % 4 + 1) END AS value, CASE WHEN event_id % 4 = 3 THEN 'ValueError: ' || event_id END AS error FROM events""")
def guarded_points(spark: SparkSession, sf: str) -> DataFrame:
    def work(row: dict[str, object]) -> float:
        if row["event_id"] % 4 == 3:
            raise ValueError(row["event_id"])
        return 100.0 / (row["event_id"] % 4 + 1)

    return lab.guarded_runs(table(spark, sf, "events").select("event_id"), work)


@query("""WITH g AS (SELECT o_custkey AS run_id, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'blocked' ELSE 'passed' END AS st FROM orders)
    SELECT run_id, string_agg(st, ',' ORDER BY o_orderkey) AS gates, 'quillon' AS producer, CASE WHEN bool_or(st = 'blocked') THEN 'blocked' WHEN bool_or(st = 'failed') THEN 'failed' ELSE 'runnable' END AS outcome FROM g GROUP BY run_id""")
def trial_receipts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("ordinal"), (k % 5 > 0).alias("passed"), F.when(F.col("o_orderstatus") == "P", "broke").alias("error"), F.lit("not idle").alias("blocked"))
    gates = lab.gate_status(rows)
    lines = lab.receipts(lab.trial_outcomes(gates, ["run_id"]), gates)
    body = F.from_json("line", "receipt struct<outcome: string, producer: string, gates: array<struct<status: string>>>")["receipt"]
    return lines.select("run_id", F.concat_ws(",", body["gates"]["status"]).alias("gates"), body["producer"].alias("producer"), body["outcome"].alias("outcome"))


@query("""SELECT s_suppkey, s_suppkey % 6 = 0 AS balanced FROM supplier""")
def balanced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lanes = ["cold", "warm", "idle"]
    return table(spark, sf, "supplier").select("s_suppkey", lab.balanced(F.col("s_suppkey"), lanes).alias("balanced"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE p_partkey % 8 END AS kinds, CASE p_partkey % 8 WHEN 0 THEN 'activity' WHEN 1 THEN 'kernel' WHEN 2 THEN 'memcpy' WHEN 3 THEN 'default' WHEN 4 THEN 'memset' ELSE 'activity' END AS label FROM part""")
def activity_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = F.when(k % 3 == 0, numeric.ALL_ACTIVITIES).otherwise((k % 8).cast("int"))
    label = numeric.activity_label((k % 8).cast("int"))
    return table(spark, sf, "part").select("p_partkey", numeric.resolved_activities(asked, F.lit(7)).cast("long").alias("kinds"), label.alias("label"))


@query(f"""WITH {READINGS}, m AS (SELECT track, region, CAST(count(*) AS DOUBLE) AS wall FROM r GROUP BY ALL) SELECT CAST(track AS VARCHAR) AS name, sum(wall) AS total_ms FROM m GROUP BY track ORDER BY sum(wall) DESC, min(region) LIMIT 10""")
def slowest_regions(spark: SparkSession, sf: str) -> DataFrame:
    summaries = trace.region_summaries(a.readings(spark, sf), ["track", "region"])
    return trace.bottlenecks(summaries.select("*", F.col("track").cast("string").alias("name"), F.col("samples").cast("double").alias("wall_ms"), F.col("region").alias("ordinal"))).select("name", "total_ms")


@query("""SELECT printf('%-24s %12.3f ms', n_name, n_nationkey * 1.5::DOUBLE) AS value FROM nation""")
def stage_timings(spark: SparkSession, sf: str) -> DataFrame:
    return trace.stages_text(table(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).cast("double").alias("mean_ms")))


@query(f"""WITH s AS ({ORACLE_SQL['monitor_sweep']}) SELECT outcome, handle AS subject, target, CASE WHEN verdict = 'vanished' THEN 'vanished (the scheduler no longer remembers the job)'
        WHEN outcome = 'failed' THEN 'failed' END AS reason FROM s WHERE outcome = 'finished' OR (outcome = 'failed' AND verdict = 'vanished')
    UNION ALL SELECT DISTINCT 'unreachable', target, target, 'no route' FROM s WHERE outcome = 'unreachable'""")
def sweep_changes(spark: SparkSession, sf: str) -> DataFrame:
    out = state.changes(swept(spark, sf))
    return out.where("outcome <> 'failed' OR reason LIKE 'vanished%'")  # exit codes of other failures are in exit_reasons


@query(f"""WITH {FRAMES} SELECT job, kind, off AS "offset" FROM firsts WHERE job = '7' AND off > 40""")
def frame_tail(spark: SparkSession, sf: str) -> DataFrame:
    return frames.tail(frames.first_writes(a.frames(spark, sf)), "7", 40).select("job", "kind", "offset")


@query(f"""WITH {FRAMES} SELECT job, bool_or(kind = 'ended') AS ended, CAST(max(off) AS BIGINT) AS last_offset FROM fr GROUP BY job""")
def jobs_ended(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.frames(spark, sf)
    return frames.is_ended(rows).join(rows.groupBy("job").agg(F.max("offset").alias("last_offset")), "job")


@query(f"""WITH {RUNS} SELECT handle, target, submitted_at, CASE WHEN target = 'host1' THEN 'done' ELSE state END AS state, CASE WHEN target <> 'host1' THEN exit_code END AS exit_code, CASE WHEN target = 'host1' THEN 'timeout' ELSE verdict END AS verdict,
    CASE WHEN target = 'host2' THEN coalesce(verdict, reported) ELSE reported END AS reported FROM runs""")
def runs_resolved(spark: SparkSession, sf: str) -> DataFrame:
    runs = a.runs(spark, sf)
    outcomes = runs.where("target = 'host1'").select(*state.RUN_KEY, F.lit("done").alias("state"), F.lit(None).cast("int").alias("exit_code"), F.lit("timeout").alias("verdict"))
    handled = runs.where("target = 'host2'").select(*state.RUN_KEY, "verdict")
    return state.reported(state.resolved(runs, outcomes), handled).select(*state.RUN_KEY, "state", "exit_code", "verdict", "reported")


@query(f"""WITH {RUNS} SELECT handle, target, submitted_at, state FROM runs WHERE handle = '7' AND target = 'host3' ORDER BY submitted_at DESC LIMIT 1""")
def run_of_handle(spark: SparkSession, sf: str) -> DataFrame:
    return state.run_of(a.runs(spark, sf), "7", "host3").select("handle", "target", "submitted_at", "state")


@query("""SELECT event_id AS id, event_type AS command FROM events ORDER BY event_id DESC LIMIT 20""")
def recent_commands(spark: SparkSession, sf: str) -> DataFrame:
    return state.recent_commands(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("command")))


@query("""SELECT 'vast' AS provider, s_name AS gpu, CAST(s_suppkey % 8 AS INT) AS gpu_count, 'n' || s_nationkey AS region, s_acctbal / 2 AS rate_usd_hr, s_suppkey % 2 = 0 AS available FROM supplier WHERE s_suppkey % 3 > 0
    UNION ALL SELECT 'vast', s_name, CAST(s_suppkey % 8 AS INT), '', s_acctbal / 2, s_suppkey % 2 = 0 FROM supplier WHERE s_suppkey % 3 = 0""")
def market_offers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("gpu_name"), (k % 8).alias("num_gpus"), F.when(k % 3 > 0, said("n", F.col("s_nationkey"))).alias("geolocation"), (F.col("s_acctbal") / 2).alias("min_bid"), F.col("s_acctbal").alias("dph_total"), (k % 2 == 0).alias("rentable"),
    )
    return market.from_market(rows, spot=True).select("provider", "gpu", "gpu_count", "region", "rate_usd_hr", "available")


@query("""SELECT n_name AS gpu, CAST(s_suppkey % 8 AS INT) AS gpus, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS usd_hr, 'r' || n_regionkey AS region, 't' || s_suppkey AS instance_type_id, s_suppkey % 2 = 0 AS in_stock
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def console_types(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    price = lambda mode, usd: F.struct(F.lit(mode).alias("chargeMode"), usd.alias("price"))
    usd = F.col("s_acctbal").cast("double")
    prices = F.when(k % 3 == 0, F.array(price("perDay", usd))).otherwise(F.array(price("perDay", usd * 9), price("perHour", usd), price("perHour", usd + 1)))
    kind = F.struct((k % 8).cast("int").alias("gpuNum"), said("t", k).alias("instanceTypeId"), F.when(k % 2 == 0, "InStock").otherwise("Out").alias("stockStatus"), prices.alias("price"))
    per = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(kind).alias("_k"))
    region = F.struct(said("r", F.col("n_regionkey")).alias("regionName"), F.lit("id").alias("regionId"), F.col("_k").alias("instanceTypeInfos"))
    families = table(spark, sf, "nation").join(per, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("gpuName"), F.array(region).alias("regionInfos"))
    return market.console_catalog(families).select("gpu", "gpus", "usd_hr", "region", "instance_type_id", "in_stock")


@query("""SELECT c_custkey, CAST(c_name AS VARCHAR) AS c_name, '["' || c_mktsegment || '"]' AS tags FROM customer""")
def flat_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.array("c_mktsegment").alias("tags"), "c_acctbal")
    return render.projected(render.flat(rows), ["c_custkey", "absent", "c_name", "tags"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, CASE c_custkey % 3 WHEN 0 THEN 'a' || chr(9) || c_name WHEN 1 THEN '"' || c_name ELSE c_name END AS name FROM customer""")
def tab_separated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as lines of tab-separated cells and back; cells that hold a tab or begin with a quote are quoted on the way."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("a\t"), "c_name")).when(k % 3 == 1, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name")).alias("name"))
    return render.decode(render.encode(rows), render.header(rows))


@query("""SELECT 'p' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.json' ELSE '.nsys' END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'sync' END AS sync, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END AS offset_ns FROM supplier""")
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(said("p", k, F.when(k % 2 == 0, ".json").otherwise(".nsys")).alias("path"), F.when(k % 2 == 0, "sync").alias("sync"), F.lit(None).cast("string").alias("clock"), (k % 3).cast("long").alias("offset_ns"), k.alias("ordinal"))
    document = render.merge_document(rows)
    entries = F.from_json("value", "sources array<struct<path: string, sync: string, offset_ns: long>>")["sources"]
    return document.select(F.explode(entries).alias("e")).select("e.*")


@query("""SELECT s_suppkey, 'h' || s_suppkey AS hostname, CAST(s_suppkey * 1000 AS BIGINT) AS memory_total_bytes, s_suppkey % 2 = 0 AS capped FROM supplier""")
def host_reports(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.sources import files

    k = F.col("s_suppkey")
    value = said("motd: hello\n", '{"hostname":"h', k, '","memory_total_bytes":', k * 1000, ',"cgroup":{"capped":', F.when(k % 2 == 0, "true").otherwise("false"), "}}")
    facts = files.host_facts(table(spark, sf, "supplier").select(value.alias("value")))
    return facts.select(F.regexp_extract("hostname", "([0-9]+)", 1).cast("long").alias("s_suppkey"), "hostname", "memory_total_bytes", F.col("cgroup.capped").alias("capped"))


@query("""SELECT 'n' || n_nationkey AS host, CASE WHEN n_nationkey % 3 = 0 THEN 'r1' ELSE 'r' || n_regionkey END AS env, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'c2' ELSE 'c' || n_regionkey END AS container,
    CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'i2' ELSE 'i' || n_regionkey END AS image, 'a=own,b=base,n=' || n_nationkey AS vars FROM nation""")
def execution_plans(spark: SparkSession, sf: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = nation.select(said("n", k).alias("host"), F.when(k % 3 == 0, "r1").otherwise("").alias("env"), F.when(k % 4 == 0, "none").when(k % 4 == 1, "c2").otherwise("").alias("container"))
    own = F.create_map(F.lit("a"), F.lit("own"), F.lit("n"), k.cast("string"))
    profiles = nation.select(said("n", k).alias("name"), said("r", r).alias("env"), said("c", r).alias("container"), own.alias("vars"))
    declared = region.select(said("r", F.col("r_regionkey")).alias("name"))
    images = region.select(said("c", F.col("r_regionkey")).alias("name"), said("i", F.col("r_regionkey")).alias("image"))
    out = config.plans(asked, profiles, declared, images, F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base")))
    pairs = F.transform(F.array_sort(F.map_entries("vars")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("host", "env", "container", "image", F.concat_ws(",", pairs).alias("vars"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT DISTINCT e.user_id, CAST(coalesce(l.last + 7, 1000) AS BIGINT) AS next_offset FROM events e LEFT JOIN l ON e.user_id = l.user_id""")
def next_offsets(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("offset"), F.lit(7).alias("encoded_length"))
    return frames.next_offset(rows, ["user_id"], events.select("user_id").distinct().withColumn("default", F.lit(1000)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a|' || o_orderstatus END AS fields, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'dflt' END AS word,
    CASE WHEN o_orderkey % 2 = 0 THEN 'look in /w/' || o_orderkey ELSE 'the rent backend does not implement Logs' END AS refusal FROM orders""")
def field_lists(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    raw = F.when(k % 3 == 0, F.when(k % 2 == 0, " , ")).otherwise(said(" a ,, ", s, ","))
    refusal = text.capability_refusal(F.lit("rent"), F.lit("Logs"), F.when(k % 2 == 0, "look in {path}"), path=said("/w/", k))
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", text.comma_list(raw)).alias("fields"), text.lookup(s, {"F": "done", "O": "open"}, F.lit("dflt")).alias("word"), refusal.alias("refusal"))
