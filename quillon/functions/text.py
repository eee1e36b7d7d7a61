"""Text expressions: log lines, failure causes, verdicts, identifiers. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Causes that an exit code tells by itself.
EXIT_REASONS = {
    124: "timed out (walltime exceeded)",
    125: "timeout failed to start the job",
    137: "killed by SIGKILL (out of memory or walltime, exit 137)",
    139: "crashed with SIGSEGV (segfault, exit 139)",
    143: "terminated by SIGTERM (walltime or cancel, exit 143)",
}
#: Scheduler states and verdict words.
SLURM_STATES = (
    "PENDING", "RUNNING", "SUSPENDED", "COMPLETING", "COMPLETED", "CANCELLED", "FAILED", "TIMEOUT", "NODE_FAIL", "OUT_OF_MEMORY", "BOOT_FAIL", "DEADLINE", "PREEMPTED",
)
SLURM_LIVE = ("PENDING", "RUNNING", "SUSPENDED", "COMPLETING")
PBS_STATES = {
    "BEGUN": "B", "EXITING": "E", "FINISHED": "F", "HELD": "H", "MOVED": "M", "QUEUED": "Q", "RUNNING": "R", "SUSPENDED": "S", "WAITING": "W",
}
PBS_FINISHED = ("F", "E")
PUEUE_LIVE = ("Running", "Queued", "Paused")
INSTANCE_LIVE = ("created", "loading", "running", "stopping")
INSTANCE_ENDED = ("exited", "stopped", "offline", "error")
TERMINAL = ("ok", "failed", "vanished", "unknown", "timeout")
#: What is said where no exit code tells a cause, and of a log without lines.
FORGOTTEN, EXITED, FAILED, NO_OUTPUT = "vanished (the scheduler no longer remembers the job)", "exited ", "failed", "(no log output)"
#: Terminal control codes and box-drawing characters.
ANSI = "\\x1b\\[[0-9;?]*[A-Za-z]"
BOX = "[\\u2500-\\u259F]+"
#: Failure markers, by priority; the first takes the name of the tool that enforces walltimes.
MARKERS = (
    "(?m)^{tool}: killed at walltime.*",
    "(?mU)^\\w[\\w.]*(?:Error|Exception|Interrupt|Killed)\\b.*",
    "(?mi)^(?:qsub|sbatch|srun|pueue):.*",
    "(?mi)^.*(?:fatal error|error:|failed to build|No such file|out of memory|cuda error).*",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chosen(key: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def meaningful_lines(log: Column | str) -> Column:
    """The lines of a log without control codes and panel borders, trimmed, blank ones dropped."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ANSI, ""), BOX, " "), "^\\s+|\\s+$", "")
    return F.filter(F.transform(F.split(_c(log), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), plain), lambda x: x != "")


def tail(lines: Column, limit: int) -> Column:
    """The last `limit` entries of an array."""
    size = F.size(lines)
    return F.slice(lines, F.greatest(size - limit + 1, F.lit(1)), F.lit(limit))


def log_excerpt(log: Column | str, limit: int = 10) -> Column:
    return tail(meaningful_lines(log), limit)


def last_of(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def exit_reason(code: Column | str) -> Column:
    return _chosen(_c(code), EXIT_REASONS)


def failure_reason(log: Column | str, code: Column | str, tool: str = "runner") -> Column:
    """One line of cause: the last match of the first marker that matches, else what the exit code tells, else the last line."""
    found = [F.substring(F.trim(last_of(F.regexp_extract_all(_c(log), F.lit(m.replace("{tool}", tool)), F.lit(0)))), 1, 240) for m in MARKERS]
    return F.coalesce(*found, exit_reason(code), F.substring(last_of(meaningful_lines(log)), 1, 240), F.lit(NO_OUTPUT))


def short_reason(verdict: Column | str, code: Column | str) -> Column:
    """A cause from the cached state alone."""
    return (
        F.when(_c(verdict) == "vanished", FORGOTTEN)
        .when(exit_reason(code).isNotNull(), exit_reason(code))
        .when(_c(code).isNotNull(), F.concat(F.lit(EXITED), _c(code).cast("string")))
        .otherwise(FAILED)
    )


def verdict_line(handle: Column | str, verdict: Column | str, code: Column | str, age: Column | str) -> Column:
    """`handle verdict (exit 137, why, submitted 3h)`; details that are unknown are left out."""
    age_part = F.when(F.coalesce(_c(age), F.lit("")) != "", F.concat(F.lit("submitted "), _c(age)))
    details = F.concat_ws(", ", F.concat(F.lit("exit "), _c(code).cast("string")), exit_reason(code), age_part)
    return F.concat(_c(handle), F.lit(" "), _c(verdict), F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""))


def slurm_state(value: Column | str) -> Column:
    """The first word, upper-cased, where it is a known state; else the trimmed text."""
    head = F.upper(F.split_part(F.trim(_c(value)), F.lit(" "), F.lit(1)))
    return F.when(head.isin(*SLURM_STATES), head).otherwise(F.trim(_c(value)))


def slurm_exit_code(value: Column | str) -> Column:
    """`code:signal` as one number: a code other than 0, else a signal other than 0, else 0; null where unreadable."""
    text = F.trim(_c(value))
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
    code = number(F.split_part(text, F.lit(":"), F.lit(1)))
    signal = number(F.regexp_extract(text, "^[^:]*:(.*)$", 1))
    return F.when(code != 0, code).when(signal != 0, signal).otherwise(code)


def slurm_verdict(state: Column | str, code: Column | str) -> Column:
    return (
        F.when(_c(state).isNull(), "vanished").when(_c(state).isin(*SLURM_LIVE), "running")
        .when((_c(state) == "COMPLETED") & (F.coalesce(_c(code), F.lit(0)) == 0), "ok").otherwise("failed")
    )


def pbs_state(value: Column | str) -> Column:
    """A letter code or a word as a letter code; anything else unchanged."""
    return F.when(_c(value).isin(*PBS_STATES.values()), _c(value)).otherwise(F.coalesce(_chosen(F.upper(_c(value)), PBS_STATES), _c(value)))


def pbs_verdict(state: Column | str, code: Column | str) -> Column:
    return (
        F.when(_c(state).isNull(), "vanished").when(~_c(state).isin(*PBS_FINISHED), "running")
        .when(_c(code).isNull(), "unknown").when(_c(code) == 0, "ok").otherwise("failed")
    )


def pueue_verdict(state: Column | str, result: Column | str) -> Column:
    """A null state is a task that is gone. Locked and stashed tasks read as failed."""
    done = (_c(state) == "Done") & (F.coalesce(_c(result), F.lit("")) == "Success")
    return F.when(_c(state).isNull(), "vanished").when(_c(state).isin(*PUEUE_LIVE), "running").when(done, "ok").otherwise("failed")


def inherited(state: Column | str, started: Column | str, boundary: Column | str) -> Column:
    """Whether a live task did not start at or after a boundary."""
    return F.coalesce(_c(state).isin(*PUEUE_LIVE), F.lit(False)) & F.coalesce(_c(started).cast("timestamp") < _c(boundary).cast("timestamp"), F.lit(True))


def instance_verdict(status: Column | str, code: Column | str) -> Column:
    """A rental's verdict from its status and the exit code that its log ends with. A null status is a rental that is gone."""
    return (
        F.when(_c(status).isNull(), "vanished").when(_c(status).isin(*INSTANCE_LIVE), "running")
        .when(~_c(status).isin(*INSTANCE_ENDED) | _c(code).isNull(), "unknown").when(_c(code) == 0, "ok").otherwise("failed")
    )


def lookup(key: Column | str, table: dict[str, str], default: Column | str) -> Column:
    """The entry of a small table, or a default."""
    return F.coalesce(_chosen(_c(key), table), _c(default))


def comma_list(raw: Column | str) -> Column:
    """The entries of a comma list, trimmed, blank ones dropped; a null is an empty list."""
    entries = F.transform(F.split(F.coalesce(_c(raw), F.lit("")), ","), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    return F.filter(entries, lambda x: x != "")


#: Fixed value: what a backend without advice of its own says of a capability that it lacks.
LACKS = "the %s backend does not implement %s"


def capability_refusal(backend: Column | str, capability: Column | str, advice: Column | str, **facts: Column | str) -> Column:
    """The advice for a lacking capability, its `{name}` places filled from facts; a plain statement where there is none."""
    told = _c(advice)
    for name, value in facts.items():
        told = F.replace(told, F.lit("{" + name + "}"), F.coalesce(_c(value).cast("string"), F.lit("")))
    return F.coalesce(told, F.format_string(LACKS, _c(backend), _c(capability)))


def looked_up(status: Column | str, verdicts: dict[str, str]) -> Column:
    """A verdict by lower-cased status; `unknown` without an entry."""
    return F.coalesce(_chosen(F.lower(_c(status)), verdicts), F.lit("unknown"))


def exit_marker(log: Column | str, marker: str) -> Column:
    """The number after the last `marker` that has one."""
    lines = F.split(_c(log), "\n")
    value = lambda x: F.when(F.instr(x, marker) > 0, F.trim(F.substring_index(F.substring(x, F.instr(x, marker), F.length(x)), marker, -1)).try_cast("int"))
    return last_of(F.filter(F.transform(lines, value), lambda x: x.isNotNull()))


def before_dot(handle: Column | str) -> Column:
    return F.substring_index(_c(handle), ".", 1)


def study_label(study: Column | str, trial: Column | str | None = None) -> Column:
    """`study:<id>`, or `study:<id>/<trial>` with a trial."""
    base = F.concat(F.lit("study:"), _c(study))
    return base if trial is None else F.when(F.coalesce(_c(trial), F.lit("")) != "", F.concat(base, F.lit("/"), _c(trial))).otherwise(base)


def labelled_study(label: Column | str) -> Column:
    """The study of a label; empty where it is no study's."""
    return F.regexp_extract(_c(label), "^study:([^/]*)", 1)


def kebab(name: Column | str) -> Column:
    return F.replace(_c(name), F.lit("_"), F.lit("-"))


def revision_key(repo: Column | str, revision: Column | str) -> Column:
    """`repo@revision`, with `main` where none is named."""
    return F.concat(_c(repo), F.lit("@"), F.coalesce(F.nullif(_c(revision), F.lit("")), F.lit("main")))


def content_name(text: Column | str, digits: int = 12) -> Column:
    """The first digits of a text's SHA-256."""
    return F.substring(F.sha2(_c(text).cast("binary"), 256), 1, digits)


def renamed(name: Column | str, aliases: dict[str, str]) -> Column:
    return F.coalesce(_chosen(_c(name), aliases), _c(name))


def json_list(output: Column | str, path: str) -> Column:
    """The list at a dotted path of the JSON that begins at the first brace, as strings; empty where there is none."""
    body = F.when(F.instr(_c(output), "{") > 0, F.expr("1").cast("string")).isNotNull()
    text = F.substring(_c(output), F.instr(_c(output), "{"), F.length(_c(output)))
    found = F.get_json_object(text, "$." + path) if path else F.lit(None).cast("string")
    items = F.when(body & found.startswith("["), F.from_json(found, "array<string>"))
    return F.coalesce(items, F.array().cast("array<string>"))


def first_json(output: Column | str, schema: str) -> Column:
    """The record that begins at the first brace of noisy output; an error without one."""
    at = F.instr(_c(output), "{")
    text = F.when(at > 0, F.substring(_c(output), at, F.length(_c(output)))).otherwise(F.raise_error(F.lit("no record in the output")))
    return F.from_json(text, schema)
