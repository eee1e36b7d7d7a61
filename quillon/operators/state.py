"""Run and study state: registries with one row per key, ledgers of events, merges of both, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text

RUN_KEY = ["target", "handle", "submitted_at"]
#: The moves that a verdict may make.
MOVES = {"queued": ("running", "vanished"), "running": ("ok", "failed", "vanished", "timeout"), "ok": (), "failed": (), "vanished": (), "unknown": (), "timeout": ()}


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key. One aggregate with a combine step before the shuffle; hot keys cost one row a task."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A table after rows with an `arrival` order have been written into it: the last writer of each key wins."""
    old = stored.withColumn("_new", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")))
    new = incoming.withColumn("_new", F.struct(F.lit(1).alias("a"), F.col("arrival").cast("long").alias("b"))).drop("arrival")
    return latest(old.unionByName(new), keys, F.col("_new")).drop("_new")


def resolved(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs with the state, exit code and verdict of outcomes (by RUN_KEY) written in, null ones too."""
    o = outcomes.select(*[F.col(k).alias(f"_{k}") for k in RUN_KEY], F.struct("state", "exit_code", "verdict").alias("_o"))
    condition = (F.col("target") == F.col("_target")) & (F.col("handle") == F.col("_handle")) & (F.col("submitted_at") == F.col("_submitted_at"))
    pick = lambda c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c)
    return stored.join(o, condition, "left").select(*[pick(c) if c in ("state", "exit_code", "verdict") else F.col(c) for c in stored.columns])


def reported(stored: DataFrame, handled: DataFrame) -> DataFrame:
    """Runs with `reported` advanced to the verdict of handled rows (by RUN_KEY)."""
    h = handled.select(*[F.col(k).alias(f"_{k}") for k in RUN_KEY], F.col("verdict").alias("_verdict"))
    condition = (F.col("target") == F.col("_target")) & (F.col("handle") == F.col("_handle")) & (F.col("submitted_at") == F.col("_submitted_at"))
    return stored.join(h, condition, "left").select(*[F.coalesce("_verdict", "reported").alias(c) if c == "reported" else F.col(c) for c in stored.columns])


def recent(rows: DataFrame, limit: int = 20, by: str = "submitted_at") -> DataFrame:
    """The newest rows; of equal times the greater handle first."""
    ties = [F.col(c).desc() for c in ("handle", "target") if c in rows.columns]
    return rows.orderBy(F.col(by).desc(), *ties).limit(limit)


def recent_commands(history: DataFrame, limit: int = 20) -> DataFrame:
    """The last commands, oldest of them first."""
    return history.orderBy(F.col("id").desc()).limit(limit).orderBy("id")


def tracked(runs: DataFrame) -> DataFrame:
    """Runs without a terminal verdict, and those whose verdict has not been reported."""
    open_ = F.coalesce(~F.col("verdict").isin(*text.TERMINAL), F.lit(True))
    return runs.where(open_ | ~F.col("reported").eqNullSafe(F.col("verdict")))


def newest_runs(runs: DataFrame) -> DataFrame:
    """Per handle: its newest run and the number of targets it ran on."""
    best = runs.groupBy("handle").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "handle"]), F.struct("submitted_at", "target")).alias("_row"), F.count_distinct("target").alias("targets"))
    return best.select("handle", "_row.*", "targets")


def run_of(runs: DataFrame, handle: str, target: str | None = None) -> DataFrame:
    """The newest run of a handle; without a target, a handle of several targets is an error."""
    found = runs.where(F.col("handle") == handle)
    if target is not None:
        return newest_runs(found.where(F.col("target") == target)).drop("targets")
    sure = F.when(F.col("targets") > 1, F.raise_error(F.concat(F.lit("several targets ran "), F.col("handle"))).cast("string")).otherwise(F.col("target"))
    return newest_runs(found).withColumn("target", sure).drop("targets")


def study_runs(runs: DataFrame, study: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs whose label names a study, as `study_id`; with a limit, of the newest `limit` runs only."""
    rows = recent(runs, limit) if limit else runs
    rows = rows.withColumn("study_id", text.labelled_study("name"))
    return rows.where(F.col("study_id") == study if study is not None else F.col("study_id") != "")


def statuses(events: DataFrame, by: list[str]) -> DataFrame:
    """Per handle: the state of its last submission or verdict; a verdict that names no state is passed over."""
    state = F.when(F.col("kind") == "submitted", F.lit("submitted")).when(F.col("kind") == "verdict", F.col("state"))
    known = events.where(F.col("handle").isNotNull()).withColumn("_state", state).where("_state IS NOT NULL")
    return known.groupBy(*by, "handle").agg(F.max_by("_state", "ordinal").alias("state"))


def merged_states(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Per study and handle: the dispatched run's verdict, else the ledger's state, else `submitted`.

    Of several verdicts for a handle the oldest run's wins.
    """
    oldest = F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.struct("submitted_at", "target")))
    own = study_runs(runs).groupBy("study_id", "handle").agg(oldest.alias("_verdict"))
    ledger = statuses(events, ["study_id"]).withColumnRenamed("state", "_state")
    return own.join(ledger, ["study_id", "handle"], "full").select("study_id", "handle", F.coalesce("_verdict", "_state", F.lit("submitted")).alias("state"))


def progress(states: DataFrame, by: list[str]) -> DataFrame:
    """Per study: submitted (all), ok, failed (neither ok nor submitted), running (the rest)."""
    counts = states.groupBy(*by).agg(
        F.count("*").cast("long").alias("submitted"), F.count_if(F.col("state") == "ok").cast("long").alias("ok"), F.count_if(~F.col("state").isin("ok", "submitted")).cast("long").alias("failed")
    )
    return counts.withColumn("running", F.col("submitted") - F.col("ok") - F.col("failed"))


def study_summaries(events: DataFrame) -> DataFrame:
    """Per study: oldest_at, newest_at, and the name that its first creation gave, which may be none."""
    name = F.min_by(F.struct("name"), F.when(F.col("kind") == "created", F.col("ordinal")))
    return events.groupBy("study_id").agg(F.min("at").alias("oldest_at"), F.max("at").alias("newest_at"), name["name"].alias("name"), F.count_if(F.col("kind") == "created").alias("_created")).select(
        "study_id", F.when(F.col("_created") > 0, F.col("name")).alias("name"), "oldest_at", "newest_at"
    )


def overview(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Studies of the ledgers with a row for each state: study_id, name, oldest_at, newest_at, state, handles."""
    counts = merged_states(runs, events).groupBy("study_id", "state").agg(F.count("*").cast("long").alias("handles"))
    return study_summaries(events).join(counts, "study_id", "left")


def violations(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Successive verdicts that make a move which is not declared: by, ordinal, before, verdict.

    A repeated verdict is no move. `queued`, which every run starts from, may be left for anything.
    """
    order = Window.partitionBy(*by).orderBy("ordinal")
    seen = verdicts.withColumn("before", F.lag("verdict").over(order))
    allowed = F.col("before") == "queued"
    for start, moves in MOVES.items():
        if moves:
            allowed = allowed | ((F.col("before") == start) & F.col("verdict").isin(*moves))
    return seen.where((F.col("before") != F.col("verdict")) & ~allowed).select(*by, "ordinal", "before", "verdict")


def owners(handles: DataFrame, own: DataFrame, runs: DataFrame) -> DataFrame:
    """Each handle's study: the one that this session submitted it under, else the one of its newest run's label, else null."""
    labels = newest_runs(runs).select("handle", F.nullif(text.labelled_study("name"), F.lit("")).alias("_label"))
    mine = own.select("handle", F.col("study_id").alias("_own"))
    return handles.join(mine, "handle", "left").join(labels, "handle", "left").select(*handles.columns, F.coalesce("_own", "_label").alias("study_id"))


def sweep(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """One pass over tracked runs: handle, target, outcome (running, finished, failed, unreachable), verdict, exit_code, reason.

    probes: target, handle, state, exit_code, verdict, fault; a fault makes the whole target unreachable. A terminal
    verdict in the registry outranks any probe.
    """
    p = probes.select(F.col("target").alias("_t"), F.col("handle").alias("_h"), F.col("exit_code").alias("_code"), F.col("verdict").alias("_verdict"))
    down = probes.where(F.col("fault").isNotNull()).groupBy(F.col("target").alias("_down")).agg(F.min("fault").alias("_fault"))
    open_ = tracked(runs)
    met = open_.join(p, (F.col("target") == F.col("_t")) & (F.col("handle") == F.col("_h")), "left").join(down, F.col("target") == F.col("_down"), "left")
    cached = F.coalesce(F.col("verdict").isin(*text.TERMINAL), F.lit(False))
    verdict = F.when(cached, F.col("verdict")).otherwise(F.coalesce("_verdict", F.lit("vanished")))
    code = F.when(cached, F.col("exit_code")).otherwise(F.col("_code"))
    met = met.withColumn("_now", verdict).withColumn("_exit", code)
    outcome = (
        F.when(F.col("_fault").isNotNull(), "unreachable").when(~F.col("_now").isin(*text.TERMINAL), "running").when(F.col("_now") == "ok", "finished").otherwise("failed")
    )
    met = met.withColumn("outcome", outcome)
    reason = F.when(F.col("outcome") == "failed", text.short_reason("_now", "_exit")).when(F.col("outcome") == "unreachable", F.col("_fault"))
    return met.select("handle", "target", "submitted_at", "outcome", F.when(F.col("outcome") != "unreachable", F.col("_now")).alias("verdict"), F.when(F.col("outcome") != "unreachable", F.col("_exit")).alias("exit_code"), reason.alias("reason"))


def changes(swept: DataFrame) -> DataFrame:
    """What a sweep has to tell: one row per finished or failed run, and one per host that is down."""
    ended = swept.where(F.col("outcome").isin("finished", "failed")).select("outcome", F.col("handle").alias("subject"), "target", "reason")
    down = swept.where(F.col("outcome") == "unreachable").groupBy("target").agg(F.min("reason").alias("reason")).select(F.lit("unreachable").alias("outcome"), F.col("target").alias("subject"), "target", "reason")
    return ended.unionByName(down)


def queue_states(handles: DataFrame, records: DataFrame) -> DataFrame:
    """Asked handles that the scheduler knows, met on the text before the first dot; the last of several records counts."""
    last = records.groupBy(text.before_dot("job_id").alias("_bare")).agg(F.max_by(F.struct("state", "exit_status"), "ordinal").alias("_r"))
    return handles.join(last, text.before_dot("handle") == F.col("_bare")).select("handle", F.col("_r.state").alias("state"), F.col("_r.exit_status").alias("exit_code"), text.pbs_verdict(F.col("_r.state"), F.col("_r.exit_status")).alias("verdict"))
