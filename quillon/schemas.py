"""Declared schemas of the record kinds, and the defaults that stand for missing fields.

A field that is not nullable in the model has a default, and a missing JSON key reads as that default, not as
null. `with_defaults` applies them once, in the source adapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNEL = "name string, start_ns long, end_ns long, correlation_id long, grid string, block string, static_shared_mem long, dynamic_shared_mem long, registers int"
MEMCPY = "kind string, start_ns long, end_ns long, correlation_id long, bytes_moved long"
ACTIVITY = "kind string, name string, start_ns long, end_ns long, correlation_id long"
WINDOW = "name string, start_ns long, end_ns long, wall_ns long"
REGION_SUMMARY = (
    "name string, wall_ms double, samples int, peak_memory_bytes long, avg_memory_bytes long, avg_util_pct double, "
    "avg_memory_util_pct double, avg_power_w double, max_temp_c int"
)
READING = "unit_name string, memory_used_bytes long, gpu_util_pct double, memory_util_pct double, power_w double, temperature_c int"
PROFILE = (
    f"host string, device string, summaries array<struct<{REGION_SUMMARY}>>, windows array<struct<{WINDOW}>>, kernels array<struct<{KERNEL}>>, "
    f"memcpys array<struct<{MEMCPY}>>, activities array<struct<{ACTIVITY}>>, dropped_spans long, dropped_activities long"
)
FRAME = "schema_version int, job string, kind string, offset long, at string, payload string"
OBSERVATION = "provider string, gpu string, region string, t_submit double, t_running double, t_ended double, billed_usd double"
OFFER = (
    "provider string, gpu string, gpu_count int, spot boolean, region string, rate_usd_hr double, granularity_s int, minimum_s int, "
    "fees_usd double, available boolean, source string"
)
RUN_RECORD = (
    "handle string, target string, kind string, script string, args string, git_sha string, dirty int, submitted_at string, "
    "fetch_path string, name string, state string, exit_code int, verdict string, reported string"
)
STUDY_EVENT = "at string, kind string, handle string, host string, state string, name string"
HISTORY_EVENT = "at string, command string, args array<string>, target string, handle string, outcome string, detail string, duration_ms long"
JOB_STATE = "handle string, label string, state string, exit_code int, verdict string"
HOST_FACTS = (
    "schema_version int, hostname string, cpu_name string, cpu_logical_cores int, memory_total_bytes long, "
    "cgroup struct<limit_bytes: long, capped: boolean>, scratch struct<path: string, free_bytes: long, source: string>, scheduler string, "
    "gpus array<struct<name: string, memory_total_bytes: long, arch_key: string>>, "
    "fabric array<struct<device: string, port: int, state: string, rate: string, link_layer: string>>"
)

#: Defaults by record kind; fields that are not listed are really nullable.
DEFAULTS: dict[str, dict[str, object]] = {
    "kernel": {"name": "", "start_ns": 0, "end_ns": 0, "correlation_id": 0, "grid": "", "block": "", "static_shared_mem": 0, "dynamic_shared_mem": 0, "registers": 0},
    "memcpy": {"kind": "unknown", "start_ns": 0, "end_ns": 0, "correlation_id": 0, "bytes_moved": 0},
    "activity": {"kind": "", "name": "", "start_ns": 0, "end_ns": 0, "correlation_id": 0},
    "region_summary": {
        "name": "", "wall_ms": 0.0, "samples": 0, "peak_memory_bytes": 0, "avg_memory_bytes": 0, "avg_util_pct": 0.0, "avg_memory_util_pct": 0.0, "avg_power_w": 0.0, "max_temp_c": 0,
    },
    "reading": {"unit_name": "", "memory_used_bytes": 0, "gpu_util_pct": 0.0, "memory_util_pct": 0.0, "power_w": 0.0, "temperature_c": 0},
    "frame": {"schema_version": 1, "offset": 0, "payload": "{}"},
    "observation": {"provider": "", "gpu": "", "region": "", "t_submit": 0.0, "t_running": 0.0, "t_ended": 0.0, "billed_usd": 0.0},
    "offer": {"provider": "", "gpu": "", "gpu_count": 1, "spot": False, "region": "", "rate_usd_hr": 0.0, "granularity_s": 1, "minimum_s": 0, "fees_usd": 0.0, "source": "declared"},
    "run_record": {"name": ""},
}


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Missing fields filled with the defaults of a record kind."""
    return df.withColumns({c: F.coalesce(c, F.lit(v).cast(df.schema[c].dataType)) for c, v in DEFAULTS[kind].items() if c in df.columns})


def empty(spark: object, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
