"""Numeric expressions: launch shapes, rates, billing, thresholds. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hardware's cap on threads of a block, and names of copy directions by code.
MAX_THREADS = 1024
COPY_KINDS = ("unknown", "HtoD", "DtoH", "HtoA", "AtoH", "AtoA", "AtoD", "DtoA", "DtoD", "HtoH", "PtoP")
#: Activity kinds in the order of their bits.
ACTIVITY_KINDS = ("kernel", "memcpy", "memset", "sync", "overhead", "memory", "jit", "runtime", "driver", "memory_pool")
DEFAULT_ACTIVITIES, ALL_ACTIVITIES = 0b11, (1 << len(ACTIVITY_KINDS)) - 1
#: Processor families by capability.
FAMILY_BY_MAJOR = {6: "Pascal", 7: "Volta", 8: "Ampere", 9: "Hopper", 10: "Blackwell", 12: "Blackwell"}
FAMILY_BY_PAIR = {(7, 5): "Turing", (8, 9): "Ada"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _product(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(1).cast("long"), lambda a, z: a * z)


def threads_per_block(block: Column | str) -> Column:
    """The product of the dimensions of `16x2x1`; a dimension that is no number counts as 1."""
    return _product(F.transform(F.split(_c(block), "x"), lambda d: F.when(d.rlike("^[0-9]+$"), d.try_cast("long")).otherwise(F.lit(1).cast("long"))))


def grid_blocks(shape: Column | str) -> Column:
    """The product of all numbers in a launch shape, whatever parts them; 0 without any."""
    parts = F.filter(F.split(_c(shape), "[(),x\\s]+"), lambda d: d.rlike("^[0-9]+$"))
    return F.when(F.size(parts) == 0, F.lit(0).cast("long")).otherwise(_product(F.transform(parts, lambda d: d.cast("long"))))


def launch_shape(x: Column | str, y: Column | str, z: Column | str) -> Column:
    return F.concat_ws("x", _c(x), _c(y), _c(z))


def block_occupancy(block: Column | str) -> Column:
    """Threads of a block in percent of the hardware's cap."""
    return 100.0 * threads_per_block(block) / MAX_THREADS


def shared_memory(static: Column | str, dynamic: Column | str) -> Column:
    return _c(static) + _c(dynamic)


def bandwidth(amount: Column | str, duration_ns: Column | str) -> Column:
    """Bytes by nanoseconds, which is GB/s; 0 where no time passed."""
    return F.when(_c(duration_ns) > 0, _c(amount) / _c(duration_ns)).otherwise(0.0)


def copy_kind(code: Column | str) -> Column:
    """A copy direction's name; codes without one are `kind_N`."""
    names = F.array(*map(F.lit, COPY_KINDS))
    known = F.when(_c(code).between(0, len(COPY_KINDS) - 1), F.get(names, _c(code).cast("int")))
    return F.coalesce(known, F.concat(F.lit("kind_"), _c(code).cast("string")))


def share(part: Column | str, whole: Column | str) -> Column:
    """Percent of a whole; 0 of nothing."""
    return F.when(_c(whole) > 0, 100.0 * _c(part) / _c(whole)).otherwise(0.0)


occupancy = percent_used = share


def idle(span: Column | str, busy: Column | str) -> Column:
    return F.greatest(_c(span) - _c(busy), F.lit(0).cast("long"))


def achieved_rate(amount: Column | str, total_ms: Column | str) -> Column:
    """GB/s from bytes and milliseconds; 0 without time or bytes."""
    return F.when((_c(total_ms) > 0) & (_c(amount) > 0), _c(amount) / (_c(total_ms) / 1000.0) / 1e9).otherwise(0.0)


def billed_seconds(setup_s: Column | str, run_s: Column | str, granularity_s: Column | str, minimum_s: Column | str, drain_s: Column | str | None = None) -> Column:
    """Wall seconds rounded up to whole billing steps, and to the minimum."""
    wall = _c(setup_s) + _c(run_s) + (_c(drain_s) if drain_s is not None else F.lit(0.0))
    return F.greatest(_c(minimum_s).cast("long"), F.ceil(wall.cast("double") / _c(granularity_s)).cast("long") * _c(granularity_s).cast("long"))


def cost(rate_usd_hr: Column | str, seconds: Column | str, fees_usd: Column | str) -> Column:
    return _c(fees_usd) + _c(rate_usd_hr) * _c(seconds) / 3600.0


def run_seconds(t_running: Column | str, t_ended: Column | str) -> Column:
    """Seconds a job ran; 0 where either time was never observed."""
    seen = (_c(t_running) != 0) & (_c(t_ended) != 0)
    return F.when(seen, F.greatest(_c(t_ended) - _c(t_running), F.lit(0.0))).otherwise(0.0)


def setup_seconds(t_submit: Column | str, t_running: Column | str) -> Column:
    return F.when(_c(t_running) != 0, F.greatest(_c(t_running) - _c(t_submit), F.lit(0.0))).otherwise(0.0)


def walltime_seconds(walltime: Column | str) -> Column:
    """Seconds of `HH:MM:SS`; anything but three numbers is an error."""
    parts = F.split(_c(walltime), ":")
    number = lambda i: F.get(parts, F.lit(i)).cast("long")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).otherwise(F.raise_error(F.concat(F.lit("no walltime: "), _c(walltime))).cast("long"))


def hourly_cap(budget_usd: Column | str, walltime: Column | str) -> Column:
    """The hourly rate at which a budget lasts for a walltime; 0 without a walltime."""
    seconds = F.when(F.coalesce(_c(walltime), F.lit("")) != "", walltime_seconds(walltime))
    return F.when(seconds > 0, _c(budget_usd) * 3600.0 / seconds).otherwise(0.0)


def capability_family(major: Column | str, minor: Column | str) -> Column:
    """The family of a (major, minor) capability: the exact pair first, then the major number."""
    out = F.lit("Unknown")
    for m, name in FAMILY_BY_MAJOR.items():
        out = F.when(_c(major) == m, name).otherwise(out)
    for (m, n), name in FAMILY_BY_PAIR.items():
        out = F.when((_c(major) == m) & (_c(minor) == n), name).otherwise(out)
    return out


def capability_target(major: Column | str, minor: Column | str) -> Column:
    return F.format_string("sm_%d%d", _c(major), _c(minor))


def activity_label(flags: Column | str) -> Column:
    """The lower-case name of an activity flag or named combination; `activity` for anything else."""
    out = F.lit("activity")
    for i, name in enumerate(ACTIVITY_KINDS):
        out = F.when(_c(flags) == (1 << i), name).otherwise(out)
    return F.when(_c(flags) == DEFAULT_ACTIVITIES, "default").when(_c(flags) == ALL_ACTIVITIES, "all").otherwise(out)


def missing_activities(supported: Column | str, requested: Column | str) -> Column:
    """Names of flags that were asked for and are not offered, in the order of the bits; none where either is unknown."""
    flags = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(n).alias("name")) for i, n in enumerate(ACTIVITY_KINDS)])
    asked = lambda f: (f["bit"].bitwiseAND(_c(requested)) != 0) & (f["bit"].bitwiseAND(_c(supported)) == 0)
    return F.when(_c(supported).isNotNull() & _c(requested).isNotNull(), F.transform(F.filter(flags, asked), lambda f: f["name"])).otherwise(F.array().cast("array<string>"))


def resolved_activities(kinds: Column | str, supported: Column | str) -> Column:
    """The kinds to trace: all that are supported for `all`; an unsupported kind that is asked for is an error."""
    left = _c(kinds).bitwiseAND(F.bitwise_not(_c(supported)))
    return F.when(_c(kinds) == ALL_ACTIVITIES, _c(supported)).when(left == 0, _c(kinds)).otherwise(F.raise_error(F.lit("unsupported activity kinds")).cast("int"))


def device_busy(util_pct: Column | str, memory_pct: Column | str, util_threshold: int = 10, memory_threshold: float = 90.0) -> Column:
    """Whether a device works: above either threshold. No device is not busy."""
    return F.coalesce((_c(util_pct) > util_threshold) | (_c(memory_pct) > memory_threshold), F.lit(False))


def usable_memory_gb(gpu_mem_mb: Column | str, sysmem_gb: Column | str) -> Column:
    return F.coalesce(_c(gpu_mem_mb) / 1024.0, _c(sysmem_gb).cast("double"))


def fits(gpu_mem_mb: Column | str, sysmem_gb: Column | str, needs_gb: float) -> Column:
    return F.coalesce(usable_memory_gb(gpu_mem_mb, sysmem_gb) >= needs_gb, F.lit(False))


def exit_rank(verdict: Column | str) -> Column:
    """The exit status of a verdict: ok 0, failed 1, running 2, anything else 3."""
    return F.when(_c(verdict) == "ok", 0).when(_c(verdict) == "failed", 1).when(_c(verdict) == "running", 2).otherwise(3)
