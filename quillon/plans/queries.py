"""The registered queries, each beside its DuckDB SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import adapters as a
from quillon.functions import exact, numeric, text
from quillon.operators import config, costs, fleet, frames, lab, packages, render, state, trace
from quillon.session import on_workers, scratch, table
from quillon.sources import market, parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            on_workers(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The adapters, as SQL -------------------------------------------------------------------------------------------

ACT = """act AS (SELECT user_id AS track, event_type AS name, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 200) AS BIGINT) * 1000000 AS e, event_id AS ordinal FROM events)"""
KERNELS = """k AS (
    SELECT p_type AS name, l_orderkey * 1000000 + l_linenumber * 1000 AS s, l_orderkey * 1000000 + l_linenumber * 1000 + CAST(l_quantity AS BIGINT) * 1000 AS e,
           p_size || 'x' || l_linenumber || 'x1' AS grid, p_size || 'x1x1' AS block, p_size, l_linenumber, p_size AS registers,
           {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_shipdate, 'f': l_quantity, 'g': l_extendedprice, 'h': l_discount, 'i': l_tax} AS ordinal
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COPIES = """c AS (
    SELECT CAST(round(l_discount * 100) AS INT) % 11 AS code, CAST(round(l_tax * 100) AS BIGINT) * 100 AS ns, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes,
           l_orderkey * 1000000 + l_linenumber * 1000 AS s FROM lineitem)"""
WINDOWS = """w AS (
    SELECT DISTINCT user_id AS track, 'hour-' || (epoch_us(ts) // 3600000000) AS name, epoch_us(ts) // 3600000000 * 3600000000 AS s, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS e FROM events
    UNION SELECT DISTINCT user_id, 'day-' || (epoch_us(ts) // 86400000000), epoch_us(ts) // 86400000000 * 86400000000, (epoch_us(ts) // 86400000000 + 1) * 86400000000 FROM events)"""
READINGS = """r AS (
    SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS region, user_id AS track, epoch_us(ts) AS at, event_id AS memory, CAST(round(value * 100) AS BIGINT) % 101 AS util,
           CAST(round(value * 100) AS BIGINT) % 97 AS mem_util, CAST(round(value * 100) AS BIGINT) % 301 AS power, CAST(round(value * 100) AS BIGINT) % 90 AS temp FROM events)"""
OBS = """o AS (
    SELECT 'p' || (l_suppkey % 7) AS provider, 'g' || (l_suppkey % 3) AS gpu,
           greatest((epoch_us(l_shipdate) / 1000000) - (epoch_us(o_orderdate) / 1000000), 0.0::DOUBLE) AS setup_s,
           greatest((epoch_us(l_shipdate) / 1000000 + l_quantity * 3600) - epoch_us(l_shipdate) / 1000000, 0.0::DOUBLE) AS run_s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
OFFERS = """f AS (
    SELECT s_suppkey AS ordinal, 'p' || (s_suppkey % 7) AS provider, 'G' || (s_suppkey % 3) AS gpu, s_suppkey % 5 = 0 AS spot, round(abs(s_acctbal) * 100) / 100 AS rate,
           CASE WHEN s_suppkey % 2 = 1 THEN 60 ELSE 1 END AS g, CASE WHEN s_suppkey % 2 = 1 THEN 60 ELSE 0 END AS mn FROM supplier)"""
RUNS = """runs AS (
    SELECT CAST(o_custkey AS VARCHAR) AS handle, 'host' || (o_orderkey % 5) AS target, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '#' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS submitted_at,
           's' || (o_custkey % 4) AS study_id, o_orderstatus AS state, CASE o_orderstatus WHEN 'P' THEN o_orderkey % 150 WHEN 'F' THEN 0 END AS exit_code,
           CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'failed' END AS verdict,
           CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'failed' END END AS reported FROM orders)"""
LEDGER = """ledger AS (
    SELECT 's' || (user_id % 4) AS study_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "at",
           CASE WHEN event_type IN ('purchase', 'error') THEN 'verdict' WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'click' THEN 'note' ELSE 'submitted' END AS kind,
           CAST(user_id AS VARCHAR) AS handle, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'failed' END AS state,
           CASE WHEN event_type = 'signup' THEN 'name' || event_id END AS name, event_id AS ordinal FROM events)"""
STATUSES = """moves AS (SELECT *, CASE kind WHEN 'submitted' THEN 'submitted' WHEN 'verdict' THEN state END AS st FROM ledger),
    statuses AS (SELECT study_id, handle, arg_max(st, ordinal) AS state FROM moves WHERE st IS NOT NULL GROUP BY ALL)"""
MERGED = """own AS (SELECT study_id, handle, arg_min(verdict, {'a': submitted_at, 'b': target}) FILTER (WHERE verdict IS NOT NULL) AS v FROM runs GROUP BY ALL),
    merged AS (SELECT coalesce(own.study_id, s.study_id) AS study_id, coalesce(own.handle, s.handle) AS handle, coalesce(own.v, s.state, 'submitted') AS state
               FROM own FULL JOIN statuses s ON own.study_id = s.study_id AND own.handle = s.handle)"""
FRAMES = """once AS (
    SELECT CAST(user_id AS VARCHAR) AS job, CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'ended' WHEN 'purchase' THEN 'sample' ELSE 'line' END AS kind,
           CAST(event_id // 2 AS BIGINT) AS off, ts AS "at", CAST(event_id % 4 AS INT) AS exit_code, CAST(round(value * 100) AS BIGINT) AS rss, event_id AS arrival FROM events),
    fr AS (SELECT * FROM once UNION ALL SELECT job, kind, off, "at", 9, 9, arrival + 1000000000 FROM once WHERE arrival % 3 = 0),
    firsts AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY job, off ORDER BY arrival) = 1)"""


# Traces ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {ACT}, far AS (SELECT *, max(e) OVER (PARTITION BY track ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM act WHERE e > s),
    g AS (SELECT *, CASE WHEN s > far THEN s - far END AS gap FROM far)
    SELECT track, CAST(max(e) - min(s) AS BIGINT) AS span, CAST(max(e) - min(s) - coalesce(sum(gap), 0) AS BIGINT) AS busy, CAST(coalesce(sum(gap), 0) AS BIGINT) AS idle,
           count(*) AS activities, count(*) FILTER (WHERE gap >= 1000000) AS gaps, CAST(coalesce(sum(gap) FILTER (WHERE gap >= 1000000), 0) AS BIGINT) AS gap_total,
           100.0::DOUBLE * CAST(max(e) - min(s) - coalesce(sum(gap), 0) AS BIGINT) / CAST(max(e) - min(s) AS BIGINT) AS occupancy_pct
    FROM g GROUP BY track""")
def timeline_by_track(spark: SparkSession, sf: str) -> DataFrame:
    return trace.timeline(a.activities(spark, sf), ["track"], SECOND)


@query(f"""WITH {ACT}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s, e, name) AS rn FROM act WHERE e > s),
    far AS (SELECT *, max(e) OVER w AS far, arg_max(name, {{'e': e, 'n': -rn}}) OVER w AS before FROM n WINDOW w AS (PARTITION BY track ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT track, far AS gap_start, s AS gap_end, s - far AS gap_length, before, name AS after FROM far WHERE s > far AND s - far >= 60000000)
    SELECT *, CAST(row_number() OVER (PARTITION BY track ORDER BY gap_length DESC, gap_start) AS INT) AS rank FROM g QUALIFY rank <= 10""")
def timeline_top_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return trace.top_gaps(a.activities(spark, sf), ["track"], 10, 60 * SECOND)


@query(f"""WITH {ACT}, far AS (SELECT *, max(e) OVER (PARTITION BY track ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM act WHERE e > s)
    SELECT track, ordinal, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM far""")
def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The number of the merged run that each interval is in, by slices of a day."""
    return trace.runs(a.activities(spark, sf), ["track"], width=DAY).select("track", "ordinal", "run")


@query(ORACLE_SQL["timeline_by_track"])
def timeline_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The same timelines by slices of a day: what a fleet with one very long track needs."""
    return trace.timeline(a.activities(spark, sf), ["track"], SECOND, width=DAY)


@query(ORACLE_SQL["timeline_top_gaps"])
def top_gaps_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    return trace.top_gaps(a.activities(spark, sf), ["track"], 10, 60 * SECOND, width=DAY)


@query(f"""WITH {READINGS} SELECT region, count(*) AS samples, max(memory) AS peak_memory_bytes, CAST(floor(sum(memory) / count(*)) AS BIGINT) AS avg_memory_bytes,
    avg(util) AS avg_util_pct, avg(mem_util) AS avg_memory_util_pct, avg(power) AS avg_power_w, CAST(max(temp) AS INT) AS max_temp_c FROM r GROUP BY region""")
def region_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return trace.region_summaries(a.readings(spark, sf), ["region"])


@query(f"""WITH {READINGS}, m AS (SELECT track, region, CAST(count(*) AS DOUBLE) AS wall, max(memory) AS peak, avg(util) AS util, avg(power) AS power FROM r GROUP BY ALL)
    SELECT CAST(track AS VARCHAR) AS name, count(*) AS calls, sum(wall) AS total_ms, avg(wall) AS mean_ms, max(peak) AS peak_memory_bytes, max(util) AS peak_util_pct, max(power) AS peak_power_w FROM m GROUP BY track""")
def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    summaries = trace.region_summaries(a.readings(spark, sf), ["track", "region"])
    return trace.region_stats(summaries.select("*", F.col("track").cast("string").alias("name"), F.col("samples").cast("double").alias("wall_ms"), F.col("region").alias("ordinal")))


@query(f"""WITH {KERNELS}, per AS (SELECT name, count(*) AS calls, CAST(sum(e - s) AS BIGINT) AS total_ns FROM k GROUP BY name)
    SELECT name, calls, total_ns, total_ns / calls AS mean_ns, 100.0::DOUBLE * total_ns / CAST(sum(total_ns) OVER () AS BIGINT) AS share_pct FROM per ORDER BY total_ns DESC LIMIT 10""")
def hot_kernels(spark: SparkSession, sf: str) -> DataFrame:
    return trace.hot_kernels(a.kernels(spark, sf), 10).select("name", "calls", "total_ns", "mean_ns", "share_pct")


@query(f"""WITH {KERNELS}, per AS (SELECT name, count(*) AS calls, CAST(sum(e - s) AS BIGINT) AS total_ns, arg_max({{'g': grid, 'b': block, 'r': registers}}, ordinal) AS last FROM k GROUP BY name)
    SELECT name, calls, total_ns, total_ns / calls AS mean_ns, 100.0::DOUBLE * total_ns / CAST(sum(total_ns) OVER () AS BIGINT) AS share_pct, last.g AS grid, last.b AS block, last.r AS registers,
           CAST(last.r AS BIGINT) AS threads, 100.0::DOUBLE * last.r / 1024 AS occupancy_pct FROM per""")
def kernel_stats_last_shape(spark: SparkSession, sf: str) -> DataFrame:
    return trace.kernel_stats(a.kernels(spark, sf))


@query(f"""WITH {KERNELS}, per AS (SELECT name, count(*) AS calls, sum(e - s) / 1e6::DOUBLE AS total_ms, CAST(max(p_size * l_linenumber) AS BIGINT) AS blocks, arg_min(p_size, ordinal) AS one FROM k WHERE e > s GROUP BY name)
    SELECT name, calls, total_ms, blocks, CAST(one AS BIGINT) AS threads, one AS registers, blocks / 108::DOUBLE AS waves,
           CASE WHEN ceil(blocks / 108::DOUBLE) > 0 THEN 100.0::DOUBLE * (ceil(blocks / 108::DOUBLE) - blocks / 108::DOUBLE) / ceil(blocks / 108::DOUBLE) ELSE 0 END AS tail_waste_pct FROM per""")
def kernel_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return trace.kernel_efficiency(a.kernels(spark, sf), 108)


@query(f"""WITH {KERNELS}, per AS (SELECT name, sum(e - s) AS ns FROM k WHERE e > s GROUP BY name ORDER BY ns DESC LIMIT 4)
    SELECT count(*) AS rows, CAST(round(sum(ns) / 1000) AS BIGINT) AS total_us, 108 AS multiprocessors FROM per""")
def efficiency_report(spark: SparkSession, sf: str) -> DataFrame:
    report = trace.efficiency_report(a.kernels(spark, sf), 108, 900.0, 10**12, top=4)
    return report.select("rows", F.round(F.col("total_ms") * 1000).cast("long").alias("total_us"), "multiprocessors")


@query(f"""WITH {KERNELS}, {COPIES}, x AS (SELECT (SELECT CAST(sum(e - s) AS BIGINT) FROM k) AS kernel_ns, (SELECT CAST(sum(ns) AS BIGINT) FROM c) AS copy_ns, (SELECT CAST(sum(bytes) AS BIGINT) FROM c) AS copy_bytes)
    SELECT kernel_ns, copy_ns, copy_bytes, 100.0::DOUBLE * kernel_ns / (kernel_ns + copy_ns) AS compute_pct, 100.0::DOUBLE * copy_ns / (kernel_ns + copy_ns) AS copy_pct, copy_bytes / copy_ns AS copy_gbps,
           CASE WHEN copy_ns >= kernel_ns THEN 'memory' ELSE 'compute' END AS bound FROM x""")
def bottleneck_split(spark: SparkSession, sf: str) -> DataFrame:
    return trace.time_split(a.kernels(spark, sf), a.copies(spark, sf))


@query(f"""WITH {KERNELS}, {COPIES}, {READINGS},
    t AS (SELECT (SELECT CAST(sum(e - s) AS BIGINT) FROM k) AS kernel_ns, (SELECT CAST(sum(ns) AS BIGINT) FROM c) AS copy_ns),
    d AS (SELECT name, CAST(sum(e - s) AS BIGINT) AS ns FROM k GROUP BY name ORDER BY ns DESC LIMIT 1),
    m AS (SELECT region, max(memory) AS peak, CAST(floor(sum(memory) / count(*)) AS BIGINT) AS mean FROM r GROUP BY region)
    SELECT d.name AS dominant_kernel, 100.0::DOUBLE * d.ns / t.kernel_ns AS dominant_share_pct, t.kernel_ns, t.copy_ns, (SELECT max(peak) FROM m) AS peak_memory_bytes,
           (SELECT CAST(floor(sum(mean) / count(*)) AS BIGINT) FROM m) AS avg_memory_bytes, CASE WHEN copy_ns >= kernel_ns THEN 'memory' ELSE 'compute' END AS bound, 'memset,sync' AS unavailable FROM t, d""")
def profile_verdict(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["dominant_kernel", "dominant_share_pct", "kernel_ns", "copy_ns", "peak_memory_bytes", "avg_memory_bytes", "bound"]
    return verdict_report(spark, sf).select(*columns, F.concat_ws(",", "unavailable").alias("unavailable"))


def verdict_report(spark: SparkSession, sf: str) -> DataFrame:
    summaries = trace.region_summaries(a.readings(spark, sf), ["region"])
    return trace.profile_report(a.kernels(spark, sf), a.copies(spark, sf), summaries, 10, 900.0, supported=0b11, requested=0b1111)


PLACED = f"""WITH {ACT}, {WINDOWS}, met AS (
        SELECT act.*, w.name AS wname, w.e - w.s AS width, w.s AS ws, w.e AS we FROM act LEFT JOIN w ON act.track = w.track AND act.s >= w.s AND act.s < w.e),
    placed AS (SELECT track, s, e, ordinal, coalesce(arg_min(wname, {{'a': width, 'b': ws, 'c': we, 'd': wname}}), '(outside regions)') AS region FROM met GROUP BY ALL)"""


@query(f"""{PLACED}, per AS (SELECT region, count(*) AS calls, CAST(sum(e - s) AS BIGINT) AS total FROM placed GROUP BY region),
    walls AS (SELECT name AS region, arg_max(e - s, {{'a': s, 'b': e, 'c': name}}) AS wall FROM w GROUP BY name)
    SELECT per.region, calls, total, 100.0::DOUBLE * total / CAST(sum(total) OVER () AS BIGINT) AS share_pct, coalesce(wall, 0) AS wall FROM per LEFT JOIN walls USING (region)""")
def hot_regions(spark: SparkSession, sf: str) -> DataFrame:
    return trace.hot_regions(a.activities(spark, sf), a.windows(spark, sf), ["track"], None, width=DAY).select("region", "calls", "total", "share_pct", "wall")


@query(f"""WITH {ACT}, {READINGS} SELECT act.name AS span, count(*) AS samples, max(r.memory) AS peak_memory_bytes, CAST(floor(sum(r.memory) / count(*)) AS BIGINT) AS avg_memory_bytes,
    avg(r.util) AS avg_util_pct, avg(r.mem_util) AS avg_memory_util_pct, avg(r.power) AS avg_power_w, CAST(max(r.temp) AS INT) AS max_temp_c
    FROM r JOIN act ON r.track = act.track AND r.at >= act.s AND r.at < act.e GROUP BY act.name""")
def samples_to_spans(spark: SparkSession, sf: str) -> DataFrame:
    return trace.region_summaries(trace.samples_in_spans(a.readings(spark, sf), a.activities(spark, sf), ["track"], width=DAY), ["span"])


@query(f"""WITH {WINDOWS} SELECT i.track, i.name, i.s AS start, string_agg(o.name, '.' ORDER BY o.s - o.e, o.s, o.e, o.name) AS path
    FROM w i JOIN w o ON i.track = o.track AND o.s <= i.s AND o.e >= i.e GROUP BY ALL""")
def span_paths(spark: SparkSession, sf: str) -> DataFrame:
    return trace.span_paths(a.windows(spark, sf), ["track"], width=DAY).select("track", "name", "start", "path")


@query("""WITH h AS (SELECT event_id % 2 AS side, CAST(user_id AS VARCHAR) AS name, CAST(round(sum(value * 100)) AS DOUBLE) AS ms FROM events GROUP BY ALL)
    SELECT coalesce(b.name, c.name) AS name, coalesce(b.ms, 0) AS before_ms, coalesce(c.ms, 0) AS after_ms, CASE WHEN b.ms IS NOT NULL AND c.ms > 0 THEN b.ms / c.ms ELSE 0 END AS speedup,
           coalesce(c.ms, 0) - coalesce(b.ms, 0) AS delta_ms FROM (SELECT * FROM h WHERE side = 0) b FULL JOIN (SELECT * FROM h WHERE side = 1) c ON b.name = c.name""")
def profile_diff(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100)
    half = lambda k: table(spark, sf, "events").where(F.pmod("event_id", F.lit(2)) == k).select(F.col("user_id").cast("string").alias("name"), cents.alias("wall_ms"))
    return trace.profile_diff(half(0), half(1))


@query(f"""WITH {ACT}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ordinal DESC) AS back, count(*) OVER (PARTITION BY track) AS n FROM act)
    SELECT track, name, s AS start, "ordinal", greatest(n - 50, 0) AS dropped FROM n WHERE back <= 50""")
def keep_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return trace.keep_last(a.activities(spark, sf), ["track"], 50).select("track", "name", "start", "ordinal", "dropped")


@query(f"""WITH {COPIES}, n AS (SELECT *, ['unknown', 'HtoD', 'DtoH', 'HtoA', 'AtoH', 'AtoA', 'AtoD', 'DtoA', 'DtoD', 'HtoH', 'PtoP'][code + 1] AS kind FROM c)
    SELECT kind, count(*) AS copies, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(ns) AS BIGINT) AS ns, CASE WHEN sum(ns) > 0 THEN CAST(sum(bytes) AS BIGINT) / CAST(sum(ns) AS BIGINT) ELSE 0 END AS gbps FROM n GROUP BY kind""")
def copy_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    rows = trace.copy_records(a.copies(spark, sf))
    per = rows.groupBy("kind").agg(F.count("*").alias("copies"), F.sum("bytes_moved").alias("bytes"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("ns"))
    return per.withColumn("gbps", numeric.bandwidth("bytes", "ns"))


@query("""SELECT p_partkey, CAST(p_size * (p_partkey % 5) AS BIGINT) AS blocks, CAST(p_size AS BIGINT) AS threads, 100.0::DOUBLE * p_size / 1024 AS occupancy_pct, CAST(0 AS BIGINT) AS none FROM part""")
def launch_shapes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    grid = F.concat(F.lit("("), F.col("p_size"), F.lit(", "), F.pmod("p_partkey", F.lit(5)), F.lit(")"))
    block = F.concat_ws("x", "p_size", F.lit("N"), F.lit("1"))
    return part.select("p_partkey", numeric.grid_blocks(grid).alias("blocks"), numeric.threads_per_block(block).alias("threads"), numeric.block_occupancy(block).alias("occupancy_pct"), numeric.grid_blocks(F.lit("garbage")).alias("none"))


@query(f"""WITH {KERNELS}, {COPIES}, o AS (SELECT least((SELECT min(s) FROM k), (SELECT min(s) FROM c)) AS o),
    ev AS (SELECT 1 AS tid, name, s, e - s AS ns FROM k UNION ALL SELECT 2, ['unknown', 'HtoD', 'DtoH', 'HtoA', 'AtoH', 'AtoA', 'AtoD', 'DtoA', 'DtoD', 'HtoH', 'PtoP'][code + 1], s, ns FROM c)
    SELECT tid, name, count(*) AS events, min((s - o) / 1000) AS first_ts, max((s - o) / 1000) AS last_ts, CAST(round(sum(ns) / 1000) AS BIGINT) AS dur FROM ev, o GROUP BY ALL""")
def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    kernels = a.kernels(spark, sf)
    copies = trace.copy_records(a.copies(spark, sf))
    none = copies.where("false").select(F.col("kind").alias("name"), "kind", "start_ns", "end_ns", F.lit(0).alias("correlation_id"))
    events = render.trace_events(none, kernels, copies, none)
    ns = F.round(F.col("dur") * 1000).cast("long")  # whole again: sums of fractions depend on their order, and can fall below a half
    return events.groupBy("tid", "name").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum(ns) / 1000).cast("long").alias("dur"))


@query("""WITH s AS (SELECT c_nationkey, c_custkey, CAST(c_custkey % 90 + 1 AS DOUBLE) AS ms FROM customer)
    SELECT c_nationkey, c_custkey, coalesce(sum(ms * 1000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ts_us, ms * 1000 AS dur_us FROM s""")
def regions_laid_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("ordinal"), (F.pmod("c_custkey", F.lit(90)) + 1).cast("double").alias("wall_ms"))
    return trace.laid_out(rows, ["c_nationkey"]).select("c_nationkey", "c_custkey", "ts_us", "dur_us")


@query("""SELECT event_type AS label, count(*) AS iterations, CAST(round(avg(CAST(round(value * 100) AS BIGINT)) * 1000) AS BIGINT) AS mean_milli, min(CAST(round(value * 100) AS BIGINT)) AS min_us FROM events GROUP BY event_type""")
def benchmark_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.round(F.col("value") * 100).cast("long").alias("us"), F.col("event_id").alias("ordinal"))
    return trace.benchmark_ranking(rows).select("label", "iterations", F.round(F.col("mean_us") * 1000).cast("long").alias("mean_milli"), "min_us")


@query("""WITH t AS (SELECT user_id, arg_max(event_id % 97, event_id) - arg_min(event_id % 97, event_id) AS delta, max(event_id % 40 + event_id % 30) AS peak, max(event_id % 60) AS util, count(*) % 3 AS procs FROM events GROUP BY user_id)
    SELECT user_id, CAST(delta AS DOUBLE) AS host_delta_gb, CAST(peak AS DOUBLE) AS peak_gpu_gb, 100.0::DOUBLE * peak / 64 >= 95 AS near_oom, util <= 25 AS gpu_underutilized, delta >= 4 OR procs > 1 AS host_offload, false AS throttled FROM t""")
def trial_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    mod = lambda n: F.pmod(e, F.lit(n)).cast("double")
    rows = table(spark, sf, "events").select("user_id", e.alias("ordinal"), mod(97).alias("host_gb"), F.array(mod(40), mod(30)).alias("gpu_gb"))
    per = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.pmod(e, F.lit(60))).cast("int").alias("gpu_pct"), (F.count("*") % 3).cast("int").alias("processes"))
    met = trace.meter(rows, ["user_id"]).join(per, "user_id").withColumns({"capacity_gb": F.lit(64.0), "throttles": F.array().cast("array<string>")})
    return trace.diagnosis(met).select("user_id", "host_delta_gb", "peak_gpu_gb", "near_oom", "gpu_underutilized", "host_offload", "throttled")


# Costs ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {OBS} SELECT provider, gpu, count(*) AS samples, avg(setup_s) AS mean_s, quantile_cont(setup_s, 0.5) AS p50_s, quantile_cont(setup_s, 0.9) AS p90_s FROM o WHERE setup_s > 0 GROUP BY ALL HAVING count(*) >= 3""")
def setup_fit(spark: SparkSession, sf: str) -> DataFrame:
    return costs.setup_fits(a.observations(spark, sf)).select("provider", "gpu", "samples", "mean_s", "p50_s", "p90_s")


@query(f"""WITH {OBS}, {OFFERS}, fit AS (SELECT provider, gpu, count(*) AS n, quantile_cont(setup_s, 0.5) AS p50, quantile_cont(setup_s, 0.9) AS p90 FROM o WHERE setup_s > 0 GROUP BY ALL HAVING count(*) >= 3)
    SELECT f."ordinal", f.provider, f.gpu, f.rate * greatest(mn, CAST(ceil((coalesce(p50, 300) + 3600) / g) AS BIGINT) * g) / 3600 AS expected_usd,
           f.rate * greatest(mn, CAST(ceil((coalesce(p90, 300) + 3600) / g) AS BIGINT) * g) / 3600 AS p90_usd, coalesce(n, 0) AS setup_samples
    FROM f LEFT JOIN fit ON f.provider = fit.provider AND f.gpu = fit.gpu WHERE lower(f.gpu) = 'g1'""")
def offer_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return costs.quotes(a.offers(spark, sf), a.observations(spark, sf), 3600.0, "g1").select("ordinal", "provider", "gpu", "expected_usd", "p90_usd", "setup_samples")


@query(f"""WITH {OBS}, {OFFERS}, fit AS (SELECT provider, gpu, count(*) AS n, quantile_cont(setup_s, 0.5) AS p50 FROM o WHERE setup_s > 0 GROUP BY ALL HAVING count(*) >= 3)
    SELECT f."ordinal", f.rate * greatest(mn, CAST(ceil((coalesce(p50, 300) + 3600) / g) AS BIGINT) * g) / 3600 AS expected_usd, coalesce(n, 0) AS setup_samples
    FROM f LEFT JOIN fit ON f.provider = fit.provider AND lower(f.gpu) = fit.gpu""")
def offer_quotes_fitted(spark: SparkSession, sf: str) -> DataFrame:
    offers = a.offers(spark, sf).withColumn("gpu", F.lower("gpu"))
    return costs.quotes(offers, a.observations(spark, sf), 3600.0).select("ordinal", "expected_usd", "setup_samples")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(60, CAST(ceil((l_linenumber * 7 + l_quantity) / 60) AS BIGINT) * 60) AS billed_s,
    l_extendedprice * greatest(60, CAST(ceil((l_linenumber * 7 + l_quantity) / 60) AS BIGINT) * 60) / 3600 AS cost_usd FROM lineitem""")
def billing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") * 7).cast("double").alias("setup_s"), F.col("l_quantity").alias("run_s"), F.lit(60).alias("granularity_s"),
        F.lit(60).alias("minimum_s"), F.col("l_extendedprice").alias("rate_usd_hr"), F.lit(0.0).alias("fees_usd"),
    )
    return costs.billed(rows).select("l_orderkey", "l_linenumber", "l_partkey", "billed_s", "cost_usd")


@query(f"""WITH {OFFERS}, best AS (SELECT *, "ordinal" % 10 AS reliability FROM f ORDER BY reliability DESC, rate, "ordinal" LIMIT 1) SELECT "ordinal", provider, gpu, rate AS rate_usd_hr, reliability FROM best""")
def offer_pick(spark: SparkSession, sf: str) -> DataFrame:
    return costs.pick(a.offers(spark, sf).withColumn("reliability", F.pmod("ordinal", F.lit(10)))).select("ordinal", "provider", "gpu", "rate_usd_hr", "reliability")


@query(f"""WITH {OFFERS}, t AS (SELECT "ordinal", rate, rate / 2 AS fl FROM f WHERE gpu = 'G1' ORDER BY rate, "ordinal" LIMIT 32) SELECT "ordinal", fl AS rate_usd_hr FROM t""")
def offer_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.offers(spark, sf).withColumnRenamed("rate_usd_hr", "total_usd_hr").withColumn("floor_usd_hr", F.col("total_usd_hr") / 2)
    return costs.search(rows, "G1", spot=True).select("ordinal", "rate_usd_hr")


@query("""SELECT CASE s_nationkey % 3 WHEN 0 THEN 'vast' ELSE 'p' || (s_nationkey % 3) END AS provider, s_name AS gpu, CAST(s_suppkey % 8 + 1 AS INT) AS gpu_count, s_acctbal AS rate_usd_hr, 'imported:gpuhunt' AS source
    FROM supplier WHERE s_suppkey % 4 > 0 AND s_acctbal <> 0""")
def price_feed(spark: SparkSession, sf: str) -> DataFrame:
    third = F.pmod("s_nationkey", F.lit(3))
    rows = table(spark, sf, "supplier").select(
        F.when(third == 0, "vastai").otherwise(F.concat(F.lit("p"), third)).alias("provider"), F.col("s_name").alias("gpu_name"), (F.pmod("s_suppkey", F.lit(8)) + 1).alias("gpu_count"),
        F.lit(None).cast("boolean").alias("spot"), F.lit(None).cast("string").alias("location"), F.when(F.pmod("s_suppkey", F.lit(4)) > 0, F.col("s_acctbal")).alias("price"),
    )
    return market.from_feed(rows).select("provider", "gpu", "gpu_count", "rate_usd_hr", "source")


@query("""SELECT o_orderkey, CAST(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 AS BIGINT) AS seconds,
    CASE WHEN o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 > 0 THEN o_totalprice * 3600 / (o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7) ELSE 0 END AS hourly_cap,
    o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 <= 43200 AS admitted FROM orders""")
def walltimes(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: F.lpad(F.pmod("o_orderkey", F.lit(n)).cast("string"), 2, "0")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.concat_ws(":", part(24), part(60), part(7)).alias("walltime"))
    return rows.select("o_orderkey", numeric.walltime_seconds("walltime").alias("seconds"), numeric.hourly_cap("o_totalprice", "walltime").alias("hourly_cap"), fleet.admits_walltime(F.lit("12:00:00"), "walltime").alias("admitted"))


# State ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {RUNS} SELECT handle, arg_max({{'t': target, 's': submitted_at}}, {{'a': submitted_at, 'b': target}}).t AS target, max(submitted_at) AS submitted_at, count(DISTINCT target) AS targets FROM runs GROUP BY handle""")
def run_latest(spark: SparkSession, sf: str) -> DataFrame:
    return state.newest_runs(a.runs(spark, sf)).select("handle", "target", "submitted_at", "targets")


@query(f"""WITH {RUNS} SELECT handle, target, submitted_at, verdict, reported FROM runs WHERE verdict IS NULL OR reported IS DISTINCT FROM verdict""")
def runs_tracked(spark: SparkSession, sf: str) -> DataFrame:
    return state.tracked(a.runs(spark, sf)).select("handle", "target", "submitted_at", "verdict", "reported")


@query(f"""WITH {RUNS} SELECT handle, target, submitted_at FROM runs ORDER BY submitted_at DESC LIMIT 20""")
def runs_recent(spark: SparkSession, sf: str) -> DataFrame:
    return state.recent(a.runs(spark, sf)).select("handle", "target", "submitted_at")


@query(f"""WITH {RUNS}, nw AS (SELECT handle, target, submitted_at, 'ok' AS verdict, 7 AS exit_code FROM runs WHERE CAST(handle AS BIGINT) % 3 = 0 AND state = 'O')
    SELECT r.handle, r.target, r.submitted_at, CASE WHEN nw.handle IS NULL THEN r.verdict ELSE nw.verdict END AS verdict, CAST(CASE WHEN nw.handle IS NULL THEN r.exit_code ELSE nw.exit_code END AS INT) AS exit_code
    FROM runs r LEFT JOIN nw USING (handle, target, submitted_at)""")
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    runs = a.runs(spark, sf).select("handle", "target", "submitted_at", "state", "verdict", "exit_code")
    new = runs.where((F.pmod(F.col("handle").cast("long"), F.lit(3)) == 0) & (F.col("state") == "O")).withColumns({"verdict": F.lit("ok"), "exit_code": F.lit(7), "arrival": F.lit(1)})
    stale = new.withColumns({"verdict": F.lit("failed"), "arrival": F.lit(0)})
    return state.upsert(runs, new.unionByName(stale), state.RUN_KEY).select("handle", "target", "submitted_at", "verdict", "exit_code")


@query(f"WITH {LEDGER}, {STATUSES} SELECT * FROM statuses")
def study_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return state.statuses(a.study_events(spark, sf), ["study_id"])


@query(f"""WITH {LEDGER}, {RUNS}, {STATUSES}, {MERGED} SELECT study_id, count(*) AS submitted, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state NOT IN ('ok', 'submitted')) AS failed,
    count(*) FILTER (WHERE state = 'submitted') AS running FROM merged GROUP BY study_id""")
def study_progress(spark: SparkSession, sf: str) -> DataFrame:
    return state.progress(state.merged_states(a.runs(spark, sf), a.study_events(spark, sf)), ["study_id"])


@query(f"""WITH {LEDGER}, {RUNS}, {STATUSES}, {MERGED}, head AS (SELECT study_id, min("at") AS oldest_at, max("at") AS newest_at, arg_min(name, ordinal) FILTER (WHERE kind = 'created') AS name FROM ledger GROUP BY study_id),
    counts AS (SELECT study_id, state, count(*) AS handles FROM merged GROUP BY ALL) SELECT h.study_id, h.name, h.oldest_at, h.newest_at, c.state, c.handles FROM head h LEFT JOIN counts c USING (study_id)""")
def study_overview(spark: SparkSession, sf: str) -> DataFrame:
    return state.overview(a.runs(spark, sf), a.study_events(spark, sf))


@query("""WITH v AS (SELECT o_custkey, o_orderkey AS ord, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'queued' END AS verdict FROM orders),
    l AS (SELECT *, lag(verdict) OVER (PARTITION BY o_custkey ORDER BY ord) AS before FROM v)
    SELECT o_custkey, ord AS "ordinal", before, verdict FROM l WHERE before <> verdict AND before <> 'queued' AND NOT (before = 'running' AND verdict = 'ok')""")
def verdict_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("ordinal"), F.when(s == "O", "running").when(s == "F", "ok").otherwise("queued").alias("verdict"))
    return state.violations(rows, ["o_custkey"])


@query(f"""WITH {RUNS}, t AS (SELECT * FROM runs WHERE verdict IS NULL OR reported IS DISTINCT FROM verdict),
    n AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN verdict WHEN CAST(handle AS BIGINT) % 7 = 0 THEN 'ok' WHEN CAST(handle AS BIGINT) % 7 = 1 THEN 'vanished' ELSE 'running' END AS now FROM t)
    SELECT handle, target, submitted_at, CASE WHEN target = 'host3' THEN 'unreachable' WHEN now = 'running' THEN 'running' WHEN now = 'ok' THEN 'finished' ELSE 'failed' END AS outcome, CASE WHEN target <> 'host3' THEN now END AS verdict FROM n""")
def monitor_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return swept(spark, sf).select("handle", "target", "submitted_at", "outcome", "verdict")


def swept(spark: SparkSession, sf: str) -> DataFrame:
    runs = a.runs(spark, sf)
    h = F.pmod(F.col("handle").cast("long"), F.lit(7))
    probes = runs.select("target", "handle").distinct().select(
        "target", "handle", F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("exit_code"), F.when(h == 0, "ok").when(h == 1, "vanished").otherwise("running").alias("verdict"),
        F.when(F.col("target") == "host3", "no route").alias("fault"),
    )
    return state.sweep(runs, probes)


@query(f"""WITH {RUNS}, labels AS (SELECT handle, arg_max('s' || (CAST(handle AS BIGINT) % 4), submitted_at) AS s FROM runs GROUP BY handle)
    SELECT CAST(c_custkey AS VARCHAR) AS handle, CASE WHEN c_custkey % 5 = 0 THEN 'own' ELSE s END AS study_id FROM customer LEFT JOIN labels ON CAST(c_custkey AS VARCHAR) = handle""")
def run_owners(spark: SparkSession, sf: str) -> DataFrame:
    handles = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("handle"))
    own = handles.where(F.pmod(F.col("handle").cast("long"), F.lit(5)) == 0).withColumn("study_id", F.lit("own"))
    return state.owners(handles, own, a.runs(spark, sf))


# Frames ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {FRAMES} SELECT job, off AS "offset", kind, arrival FROM firsts""")
def ingest_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return frames.first_writes(a.frames(spark, sf)).select("job", "offset", "kind", "arrival")


PROJECTED = """SELECT job, CASE arg_max(kind, arrival) WHEN 'started' THEN 'running' ELSE 'ended' END AS state,
    CAST(epoch_us(arg_max("at", arrival) FILTER (WHERE kind = 'started')) AS BIGINT) AS started_us, CAST(epoch_us(arg_max("at", arrival) FILTER (WHERE kind = 'ended')) AS BIGINT) AS ended_us,
    arg_max(exit_code, arrival) FILTER (WHERE kind = 'ended') AS exit_code FROM {} WHERE kind IN ('started', 'ended') GROUP BY job"""


def _micros(jobs: DataFrame) -> DataFrame:
    return jobs.select("job", "state", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "exit_code")


@query(f"WITH {FRAMES} " + PROJECTED.format("firsts"))
def job_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _micros(frames.project(frames.first_writes(a.frames(spark, sf))))


@query(f"WITH {FRAMES} " + PROJECTED.format("fr"))
def job_projection_replayed(spark: SparkSession, sf: str) -> DataFrame:
    return _micros(frames.project(a.frames(spark, sf)))


@query(f"""WITH {FRAMES} SELECT job, off AS "offset", arg_max(rss, arrival) AS rss FROM fr WHERE kind = 'sample' GROUP BY ALL""")
def job_samples(spark: SparkSession, sf: str) -> DataFrame:
    return frames.samples(a.frames(spark, sf)).select("job", "offset", "rss")


@query("""WITH l AS (SELECT conv_id, turn, strlen(coalesce(text, '')) + 1 AS n FROM conversations),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
    SELECT conv_id, CAST(max(off) AS BIGINT) AS last_offset, CAST(arg_max(off + n, off) AS BIGINT) AS next_offset, CAST(max(off // 4096) AS BIGINT) AS segments FROM o GROUP BY conv_id""")
def log_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("line"))
    stamped = frames.segments(frames.stamped(rows, ["conv_id"]), ["conv_id"], 4096).withColumn("encoded_length", F.octet_length("line") + 1)
    ends = frames.next_offset(stamped, ["conv_id"])
    return stamped.groupBy("conv_id").agg(F.max("offset").alias("last_offset"), F.max("segment").alias("segments")).join(ends, "conv_id")


# Text -----------------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: regexp_replace(x, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g')), lambda x: x <> '') AS ls FROM conversations)
    SELECT conv_id, turn, len(ls) AS lines, array_to_string(ls[-3:], '|') AS excerpt FROM l""")
def log_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.size(text.meaningful_lines("text")).cast("long").alias("lines"), F.concat_ws("|", text.log_excerpt("text", 3)).alias("excerpt"))


CODE = "CAST(event_id % 7 * 25 AS INT)"
REASON = "CASE {0} WHEN 124 THEN 'timed out (walltime exceeded)' WHEN 125 THEN 'timeout failed to start the job' WHEN 137 THEN 'killed by SIGKILL (out of memory or walltime, exit 137)' WHEN 139 THEN 'crashed with SIGSEGV (segfault, exit 139)' WHEN 143 THEN 'terminated by SIGTERM (walltime or cancel, exit 143)' END"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(120 + event_id % 25 AS INT) END AS code, CASE event_type WHEN 'click' THEN 'vanished' ELSE 'failed' END AS v FROM events)
    SELECT event_id, {REASON.format('code')} AS exit_reason, CASE WHEN v = 'vanished' THEN 'vanished (the scheduler no longer remembers the job)' WHEN {REASON.format('code')} IS NOT NULL THEN {REASON.format('code')}
           WHEN code IS NOT NULL THEN 'exited ' || code ELSE 'failed' END AS short_reason,
           event_id || ' ' || v || CASE WHEN code IS NULL THEN '' ELSE ' (exit ' || code || coalesce(', ' || {REASON.format('code')}, '') || ')' END AS line FROM e""")
def exit_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", (F.lit(120) + F.pmod("event_id", F.lit(25))).cast("int")).alias("code"), F.when(F.col("event_type") == "click", "vanished").otherwise("failed").alias("v")
    )
    return rows.select("event_id", text.exit_reason("code").alias("exit_reason"), text.short_reason("v", "code").alias("short_reason"), text.verdict_line(F.col("event_id").cast("string"), "v", "code", F.lit("")).alias("line"))


@query(r"""SELECT conv_id, turn, substr(coalesce(
        regexp_extract_all(text, '(?m)^\w[\w.]*(?:Error|Exception|Interrupt|Killed)\b.*')[-1], regexp_extract_all(text, '(?mi)^(?:qsub|sbatch|srun|pueue):.*')[-1],
        regexp_extract_all(text, '(?mi)^.*(?:fatal error|error:|failed to build|No such file|out of memory|cuda error).*')[-1],
        list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: regexp_replace(x, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g')), lambda x: x <> '')[-1], '(no log output)'), 1, 240) AS reason FROM conversations""")
def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.failure_reason("text", F.lit(None).cast("int")).alias("reason"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN ['PENDING', 'RUNNING', 'COMPLETED', 'FAILED', 'TIMEOUT'][event_id % 5 + 1] END AS s, CASE WHEN event_id % 11 > 0 THEN ['Q', 'R', 'F', 'E', 'H'][event_id % 5 + 1] END AS p,
        CASE WHEN event_id % 11 > 0 THEN ['Running', 'Queued', 'Done', 'Stashed', 'Locked'][event_id % 5 + 1] END AS t, CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 1 END AS code FROM events)
    SELECT event_id, CASE WHEN s IS NULL THEN 'vanished' WHEN s IN ('PENDING', 'RUNNING') THEN 'running' WHEN s = 'COMPLETED' AND coalesce(code, 0) = 0 THEN 'ok' ELSE 'failed' END AS slurm,
           CASE WHEN p IS NULL THEN 'vanished' WHEN p NOT IN ('F', 'E') THEN 'running' WHEN code IS NULL THEN 'unknown' WHEN code = 0 THEN 'ok' ELSE 'failed' END AS pbs,
           CASE WHEN t IS NULL THEN 'vanished' WHEN t IN ('Running', 'Queued') THEN 'running' WHEN t = 'Done' AND code = 0 THEN 'ok' ELSE 'failed' END AS pueue,
           CASE WHEN s IS NULL THEN 3 WHEN s IN ('PENDING', 'RUNNING') THEN 2 WHEN s = 'COMPLETED' AND coalesce(code, 0) = 0 THEN 0 ELSE 1 END AS exit_rank FROM e""")
def verdicts_all(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda *names: F.when(e % 11 > 0, F.get(F.array(*map(F.lit, names)), (e % 5).cast("int")))
    rows = table(spark, sf, "events").select(
        "event_id", pick("PENDING", "RUNNING", "COMPLETED", "FAILED", "TIMEOUT").alias("s"), pick("Q", "RUNNING", "F", "exiting", "H").alias("p"), pick("Running", "Queued", "Done", "Stashed", "Locked").alias("t"),
        F.when(e % 3 > 0, (e % 3 - 1).cast("int")).alias("code"),
    )
    slurm = text.slurm_verdict("s", "code")
    result = F.when(F.col("code") == 0, "Success").when(F.col("code") > 0, "Failed")
    return rows.select("event_id", slurm.alias("slurm"), text.pbs_verdict(text.pbs_state("p"), "code").alias("pbs"), text.pueue_verdict("t", result).alias("pueue"), numeric.exit_rank(slurm).alias("exit_rank"))


#: Order keys that one listing of a customer covers: no listing has more lines, however many orders a customer has.
LISTED = 5_000


def listings(orders: DataFrame) -> DataFrame:
    """Queue listings of each customer's orders: id, value, one for every block of LISTED order keys that it has orders in."""
    s = F.col("o_orderstatus")
    line = F.concat_ws(
        "|", F.col("o_orderkey").cast("string"), F.lit(" job "), F.when(s == "O", "running x").when(s == "F", "COMPLETED").otherwise("P by 7"), "o_orderpriority",
        F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.concat(F.lit("0:"), F.pmod("o_orderkey", F.lit(3)))).otherwise(""),
    )
    blocks = orders.groupBy(F.col("o_custkey").alias("id"), F.floor(F.col("o_orderkey") / LISTED).alias("_block"))
    return blocks.agg(F.concat(F.lit("short|row\n\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("value")).drop("_block")


@query("""SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'P by 7' END AS state,
    nullif(trim(o_orderpriority), '') AS "partition", CASE WHEN o_orderkey % 3 > 0 THEN '0:' || (o_orderkey % 3) END AS elapsed FROM orders""")
def queue_listing(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.squeue(listings(table(spark, sf, "orders"))).select("id", "job_id", "state", "partition", "elapsed")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    noisy = F.concat(F.lit("warning: x\n{\"report\": {\"list\": ["), F.get_json_object("props", "$.k"), F.lit("]}}"))
    rows = table(spark, sf, "events").select("event_id", text.json_list(noisy, "report.list").alias("l"))
    return rows.select("event_id", F.get("l", F.lit(0)).cast("long").alias("k"))


@query("""SELECT o_orderkey, 's' || (o_orderkey % 9) AS study, CASE WHEN o_orderkey % 2 = 0 THEN 'study:s' || (o_orderkey % 9) ELSE 'study:s' || (o_orderkey % 9) || '/t' || o_orderkey END AS label,
    'clerk-' || (o_orderkey % 5) AS kebab, 'm@' || CASE WHEN o_orderkey % 3 = 0 THEN 'main' ELSE 'r' || (o_orderkey % 3) END AS revision, CAST(o_orderkey AS VARCHAR) AS bare, substr(sha256(o_orderpriority), 1, 12) AS content FROM orders""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = text.study_label(F.concat(F.lit("s"), k % 9), F.when(k % 2 == 1, F.concat(F.lit("t"), k)))
    return table(spark, sf, "orders").select(
        "o_orderkey", text.labelled_study(label).alias("study"), label.alias("label"), text.kebab(F.concat(F.lit("clerk_"), k % 5)).alias("kebab"),
        text.revision_key(F.lit("m"), F.when(k % 3 > 0, F.concat(F.lit("r"), k % 3)).otherwise("")).alias("revision"), text.before_dot(F.concat(k.cast("string"), F.lit(".server.net"))).alias("bare"), text.content_name("o_orderpriority").alias("content"),
    )


@query("""SELECT c_custkey, substr(sha256('{"balance":' || CAST(c_custkey % 100 AS VARCHAR) || ',"name":"' || c_name || '"}'), 1, 16) AS run_id FROM customer""")
def run_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    config_json = F.to_json(F.struct(F.col("c_name").alias("name"), F.pmod("c_custkey", F.lit(100)).alias("balance")))
    return table(spark, sf, "customer").select("c_custkey", exact.run_id(config_json).alias("run_id"))


@query("""SELECT o_orderkey, CAST(least(100, (o_orderkey % 4 + 1) * 50) AS BIGINT) AS memory, CAST(trunc((o_orderkey % 4 + 1) * 7 / 2) AS BIGINT) AS hours, CAST(greatest(1, (o_orderkey % 4 + 1) * 3 // 2 - 1) AS BIGINT) AS gpus FROM orders""")
def resource_expressions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.pmod("o_orderkey", F.lit(4)) + 1).alias("attempt"))
    return rows.select("o_orderkey", exact.resource("min(100, attempt * 50)", "attempt").alias("memory"), exact.resource("attempt * 7 / 2", "attempt").alias("hours"), exact.resource("max(1, attempt * 3 // 2 - 1)", "attempt").alias("gpus"))


@query("""SELECT p_partkey, CASE WHEN p_size % 13 = 7 AND p_partkey % 10 = 5 THEN 'Turing' WHEN p_size % 13 = 8 AND p_partkey % 10 = 9 THEN 'Ada' ELSE CASE p_size % 13 WHEN 6 THEN 'Pascal' WHEN 7 THEN 'Volta' WHEN 8 THEN 'Ampere' WHEN 9 THEN 'Hopper'
    WHEN 10 THEN 'Blackwell' WHEN 12 THEN 'Blackwell' ELSE 'Unknown' END END AS family, 'sm_' || (p_size % 13) || (p_partkey % 10) AS target FROM part""")
def device_families(spark: SparkSession, sf: str) -> DataFrame:
    major, minor = F.pmod("p_size", F.lit(13)), F.pmod("p_partkey", F.lit(10))
    return table(spark, sf, "part").select("p_partkey", numeric.capability_family(major, minor).alias("family"), numeric.capability_target(major, minor).alias("target"))


# Configuration, packages, hosts ---------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def needs_missing(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("ordinal", F.col("p_partkey"))
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return packages.missing(parts, used, "p_partkey").select("p_partkey", "p_name")


@query("""WITH rows AS (SELECT 0 AS layer, 'n' || n_nationkey AS path, 'version' AS kind, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 1, 'n' || n_nationkey, 'version', CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE n_name END FROM nation
        UNION ALL SELECT 2, 'n' || c_nationkey, 'version', max(c_name) FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey)
    SELECT path, arg_max(value, {'a': CASE WHEN value = '*' THEN 0 ELSE 1 END, 'b': layer}) AS value FROM rows GROUP BY path""")
def layer_merge(spark: SparkSession, sf: str) -> DataFrame:
    nation, region, customer = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    row = lambda df, layer, key, value: df.select(F.lit(layer).alias("layer"), F.concat(F.lit("n"), key).alias("path"), F.lit("version").alias("kind"), value.alias("value"))
    base = row(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), 0, "n_nationkey", F.col("r_name"))
    over = row(nation, 1, "n_nationkey", F.when(F.pmod("n_nationkey", F.lit(3)) == 0, "*").otherwise(F.col("n_name")))
    top = row(customer.where(F.pmod("c_nationkey", F.lit(2)) == 0).groupBy("c_nationkey").agg(F.max("c_name").alias("v")), 2, "c_nationkey", F.col("v"))
    return config.merged_layers(base.unionByName(over).unionByName(top)).select("path", "value")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL),
    l AS (SELECT user_id, list(event_type ORDER BY o) AS own FROM f GROUP BY user_id)
    SELECT user_id, array_to_string(list_concat(['base', 'view'], list_filter(own, lambda x: x <> 'view')), ',') AS merged FROM l""")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("ordinal", F.col("event_id"))
    firsts = config.ordered_distinct(rows, ["user_id"], "event_type").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "event_type"))).alias("_l"))
    own = F.transform("_l", lambda x: x["event_type"])
    return firsts.select("user_id", F.concat_ws(",", config.ordered_union(F.array(F.lit("base"), F.lit("view")), own)).alias("merged"))


@query("""SELECT s_suppkey, 's_name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def unpivot_record(spark: SparkSession, sf: str) -> DataFrame:
    return render.pairs(table(spark, sf, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey", "absent"])


@query("""SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'base' END AS root, 'x=1,y=' || CASE WHEN n_nationkey % 3 = 0 THEN '9' ELSE '2' END AS vars,
    array_to_string(list_concat(['a', 'b'], CASE WHEN n_nationkey % 4 = 0 THEN ['c'] ELSE [] END), ',') AS sync FROM nation""")
def profile_overlay(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    strings = F.array().cast("array<string>")
    own = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), k).alias("name"), F.when(k % 2 == 0, "own").otherwise("").alias("root"), F.when(k % 3 == 0, F.create_map(F.lit("y"), F.lit("9"))).otherwise(F.create_map().cast("map<string,string>")).alias("vars"),
        F.when(k % 4 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(strings).alias("sync"),
    )
    base = spark.range(1).select(F.lit("base").alias("root"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")).alias("vars"), F.array(F.lit("a"), F.lit("b")).alias("sync"))
    out = config.overlay(base, own, "name", ["root"], ["vars"], ["sync"])
    pairs = F.transform(F.array_sort(F.map_entries("vars")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("name", "root", F.concat_ws(",", pairs).alias("vars"), F.concat_ws(",", "sync").alias("sync"))


@query("""SELECT 'c' || c_custkey AS host, 'container' AS field, 'n' || (c_nationkey + 3) AS value FROM customer WHERE c_nationkey + 3 > 24
    UNION ALL SELECT 'c' || c_custkey, 'environment', 'r9' FROM customer WHERE c_custkey % 10 = 9""")
def broken_references(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    hosts = table(spark, sf, "customer").select(F.concat(F.lit("c"), k).alias("name"), F.concat(F.lit("n"), F.col("c_nationkey") + 3).alias("container"), F.when(k % 10 == 9, "r9").when(k % 10 == 0, "").otherwise("r0").alias("environment"))
    known = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return config.unresolved(hosts, known, table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("name")))


@query("""WITH d AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 3 > 0), i AS (SELECT p_partkey AS k, p_size + p_partkey % 2 AS have FROM part WHERE p_partkey % 5 > 0)
    SELECT 'pkg' || i.k AS name, 'uninstall' AS action FROM i WHERE i.k NOT IN (SELECT k FROM d) UNION ALL
    SELECT 'pkg' || d.k, 'install' FROM d LEFT JOIN i USING (k) WHERE have IS NULL OR have < p_size + 1""")
def package_sync(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg"), k).alias("name")
    declared = part.where(k % 3 > 0).select(name, F.concat(F.lit(">="), F.col("p_size") + 1, F.lit(".0")).alias("version"))
    installed = part.where(k % 5 > 0).select(name, F.concat((F.col("p_size") + k % 2).cast("string"), F.lit(".0.0")).alias("version"))
    return packages.sync_plan(declared, installed)


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS damaged, o_orderkey % 100 > CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50 END AS outdated, o_orderkey % 4 = 0 OR o_orderkey % 100 > CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50 END AS suspect FROM orders""")
def package_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("long")
    strings = F.array().cast("array<string>")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit("root")).alias("roots"), F.when(k % 4 == 0, strings).otherwise(F.array(F.lit("root"))).alias("surviving"), F.array(k % 100, none).alias("source_times"),
        F.array(F.when(k % 3 > 0, F.lit(50).cast("long")), F.when(k % 3 > 0, F.lit(70).cast("long"))).alias("artifact_times"),
    )
    return packages.audited(rows).select("o_orderkey", "damaged", "outdated", "suspect")


@query("""WITH paths AS (SELECT DISTINCT '/r' || n_regionkey || '/n' || n_nationkey AS path, n_regionkey, n_nationkey FROM nation)
    SELECT path, CAST(least(CASE WHEN n_regionkey > 0 THEN n_regionkey * 100 END, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END) AS BIGINT) AS limit_bytes FROM paths""")
def enforced_limits(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    path = F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("path")
    caps = nation.select(path, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") * 10).cast("long").alias("limit_bytes"))
    roots = table(spark, sf, "region").select(F.concat(F.lit("/r"), "r_regionkey").alias("path"), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey") * 100).cast("long").alias("limit_bytes"))
    return fleet.enforced_limit(caps.unionByName(roots), nation.select(path))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'takes no jobs' WHEN s_suppkey % 24 > 12 THEN 'walltime' WHEN s_suppkey % 64 > 48 THEN 'memory' END AS rule FROM supplier""")
def queue_admission(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.lit("q").alias("queue"), (k % 6 > 0).alias("submittable"), F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("walltime"), F.lit("12:00:00").alias("max_walltime"),
        (k % 64).cast("int").alias("mem_gb"), F.lit(48).alias("mem_ceiling_gb"), F.lit("").alias("notes"),
    )
    r = F.col("refusal")
    return fleet.refusal(rows).select("s_suppkey", F.when(r.contains("takes no jobs"), "takes no jobs").when(r.startswith("walltime"), "walltime").when(r.isNotNull(), "memory").alias("rule"))


@query("""WITH g AS (SELECT l_orderkey, ['A100', 'H100', 'L4'][l_suppkey % 3 + 1] AS name, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS o, count(*) AS n FROM lineitem GROUP BY ALL),
    l AS (SELECT l_orderkey, string_agg(n || 'x ' || name, ', ' ORDER BY o) AS t FROM g GROUP BY l_orderkey)
    SELECT o_orderkey AS hostname, concat_ws(', ', t, (o_orderkey % 512 + 1) || ' GB RAM') AS summary FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def hardware_summaries(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("A100"), F.lit("H100"), F.lit("L4"))
    gpus = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hostname"), F.get(names, (F.col("l_suppkey") % 3).cast("int")).alias("name"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"))
    hosts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("hostname"), ((F.col("o_orderkey") % 512 + 1) * 1_000_000_000).alias("memory_total_bytes"))
    return fleet.hardware_summary(gpus, hosts)


@query("""WITH h AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS dead, c_custkey % 3 = 0 AS known FROM customer WHERE c_custkey % 11 > 0)
    SELECT 'c' || c_custkey AS name, CASE WHEN dead THEN 'unreachable' WHEN NOT known THEN 'reachable' ELSE 'ready' END AS access, CASE WHEN dead THEN 'no route' WHEN NOT known THEN 'never set up' ELSE 'gpu, hardware unrecorded' END AS detail FROM h""")
def access_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k)
    hosts = table(spark, sf, "customer").select(name.alias("name"), F.when(k % 11 == 0, "provider").otherwise("slurm").alias("kind"), F.when(F.col("c_mktsegment") == "BUILDING", "no route").alias("refusal"))
    setups = table(spark, sf, "customer").where(k % 3 == 0).select(name.alias("alias"), F.lit("gpu").alias("env"), F.lit(None).cast("string").alias("hardware"))
    return fleet.access(hosts, setups).select("name", "access", "detail")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1000000 AS t, value > 60 AS busy FROM events), i AS (SELECT *, sum(busy::INT) OVER (PARTITION BY user_id ORDER BY t) AS g FROM s),
    f AS (SELECT *, min(t) FILTER (WHERE NOT busy) OVER (PARTITION BY user_id, g) AS since FROM i) SELECT user_id, min(t) AS idle_at FROM f WHERE NOT busy AND t - since >= 86400 GROUP BY user_id""")
def idle_devices(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", (a.micros("ts") / SECOND).alias("at"), (F.col("value") > 60).alias("busy"))
    return fleet.idle_since(rows, ["user_id"], 86_400.0)


@query("""SELECT o_orderkey AS block, CASE o_orderkey % 6 WHEN 0 THEN 'cold-warm-idle' WHEN 1 THEN 'cold-idle-warm' WHEN 2 THEN 'warm-cold-idle' WHEN 3 THEN 'warm-idle-cold' WHEN 4 THEN 'idle-cold-warm' ELSE 'idle-warm-cold' END AS lanes FROM orders""")
def lane_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("block"))
    return lab.block_orders(rows, ["cold", "warm", "idle"]).select("block", F.concat_ws("-", "lanes").alias("lanes"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'blocked' ELSE 'passed' END AS st FROM orders),
    w AS (SELECT o_custkey, arg_min(st, {'a': CASE st WHEN 'blocked' THEN 0 ELSE 1 END, 'b': o_orderkey}) FILTER (WHERE st <> 'passed') AS st FROM g GROUP BY o_custkey) SELECT o_custkey, coalesce(st, 'runnable') AS outcome FROM w""")
def trial_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 5 > 0).alias("passed"), F.when(F.col("o_orderstatus") == "P", "broke").alias("error"), F.lit("not idle").alias("blocked")
    )
    return lab.trial_outcomes(lab.gate_status(rows), ["o_custkey"]).select("o_custkey", "outcome")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS "at" FROM events), st AS (SELECT user_id, min("at") AS started FROM e GROUP BY user_id),
    r AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, started AS "at" FROM st UNION ALL
        SELECT user_id, event_id, "at" FROM (SELECT r.user_id, e.event_id, e."at", row_number() OVER (PARTITION BY r.user_id ORDER BY e."at", e.event_id) AS n FROM r JOIN e ON e.user_id = r.user_id AND e."at" - r."at" >= 86400) WHERE n = 1)
    SELECT r.user_id, r.event_id, r."at", st.started FROM r JOIN st USING (user_id) WHERE r.event_id IS NOT NULL""")
def sampled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at which a sample is due, a day apart at least: each depends on the one before."""
    us = a.micros("ts") / SECOND
    rows = table(spark, sf, "events").select("user_id", "event_id", us.alias("at"))
    started = rows.groupBy("user_id").agg(F.min("at").alias("started"))
    return lab.throttled(rows.join(started, "user_id"), "user_id", 86_400.0)


@query(ORACLE_SQL["job_projection"])
def stream_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written as files, ingested as a stream with a checkpoint, and projected to job states."""
    from quillon.streaming import jobs

    folder = scratch(spark)
    a.frames(spark, sf).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
    jobs.catch_up(jobs.frame_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return _micros(jobs.job_states(spark, f"{folder}/out"))


@query(ORACLE_SQL["samples_to_spans"])
def live_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and spans written as files, met as two streams, and summed by span."""
    from quillon.streaming import spans

    folder = scratch(spark)
    time = lambda name: F.timestamp_micros(name).alias(name)
    samples = a.readings(spark, sf).withColumn("at", F.timestamp_micros("at"))
    opened = a.activities(spark, sf).select("track", "name", time("start"), time("end"))
    for name, rows in (("samples", samples), ("spans", opened)):
        rows.write.parquet(f"{folder}/{name}")
    stream = lambda name, rows: spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
    met = spans.samples_in_spans(stream("samples", samples), stream("spans", opened), ["track"], "1 hour", "3 days")
    met.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return trace.region_summaries(spark.read.schema(met.schema).parquet(f"{folder}/out"), ["span"])


@query(ORACLE_SQL["job_projection"])
def stream_watched(spark: SparkSession, sf: str) -> DataFrame:
    """Frames ingested on a trigger until what has arrived is stored, and projected to job states."""
    from quillon.streaming import jobs

    folder = scratch(spark)
    a.frames(spark, sf).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
    running = jobs.watch(jobs.frame_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", 0.5)
    running.processAllAvailable()
    running.stop()
    return _micros(jobs.job_states(spark, f"{folder}/out"))
