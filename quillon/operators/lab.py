"""Trials: counterbalanced orders of conditions, gates, outcomes, guarded runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quillon.operators.runs import runs_of


def block_orders(blocks: DataFrame, lanes: list[str], block: str = "block") -> DataFrame:
    """Each block with the order of its lanes: permutations in turn, by position.

    Digits of the block's number in factorial base pick a lane after the other from those that are left, as
    column expressions; there is no table of all permutations.
    """
    if not lanes:
        return blocks.withColumn("lanes", F.array().cast("array<string>"))
    left = F.array(*map(F.lit, lanes))
    rank = F.pmod(F.col(block), F.lit(math.factorial(len(lanes)))).cast("long")
    out = blocks
    picked = []
    for i in range(len(lanes), 0, -1):
        out = out.withColumn("_left", left).withColumn("_rank", rank) if i == len(lanes) else out
        step = math.factorial(i - 1)
        at = F.floor(F.col("_rank") / step).cast("int")
        name = f"_lane{i}"
        out = out.withColumn(name, F.get("_left", at)).withColumn("_left", F.array_remove("_left", F.col(name))).withColumn("_rank", F.col("_rank") % step)
        picked.append(name)
    return out.withColumn("lanes", F.array(*picked)).drop("_left", "_rank", *picked)


def balanced(blocks: Column, lanes: list[str]) -> Column:
    """Whether every order comes up equally often in so many blocks."""
    return F.lit(True) if not lanes else blocks % math.factorial(len(lanes)) == 0


def gate_status(rows: DataFrame) -> DataFrame:
    """Gate checks with status: passed, blocked (a clean no) or failed (the check itself broke), and the reason."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("passed"), "passed").otherwise("blocked")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("passed"), F.col("blocked")).otherwise("")
    return rows.withColumns({"status": status, "reason": reason})


def trial_outcomes(gates: DataFrame, by: list[str]) -> DataFrame:
    """Per trial: runnable, or blocked or failed with the reason of its first such gate; blocked outranks failed."""
    rank = F.when(F.col("status") == "blocked", 0).when(F.col("status") == "failed", 1)
    worst = F.min_by(F.struct("status", "reason"), F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("ordinal"))))
    out = gates.groupBy(*by).agg(worst.alias("_w"))
    return out.select(*by, F.coalesce("_w.status", F.lit("runnable")).alias("outcome"), F.coalesce("_w.reason", F.lit("")).alias("reason"))


def receipts(outcomes: DataFrame, gates: DataFrame, by: str = "run_id", producer: str = "quillon") -> DataFrame:
    """One line of JSON per trial: its id, outcome and gates in their order."""
    listed = gates.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("status", "reason").alias("g")))).alias("_g"))
    met = outcomes.join(listed, by, "left").withColumn("gates", F.transform("_g", lambda x: x["g"]))
    return met.select(by, F.to_json(F.struct(F.struct(by, "outcome", F.lit(producer).alias("producer"), "gates", "reason").alias("receipt"))).alias("line"))


def guarded_runs(points: DataFrame, work: Callable[[dict[str, object]], float], schema: str = "value double, error string") -> DataFrame:
    """A function over each point: its value, or the error that it raised; a failing point does not stop the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: dict[str, object]) -> tuple[float | None, str | None]:
            try:
                return float(work(row)), None
            except Exception as fault:
                return None, f"{type(fault).__name__}: {fault}"

        for frame in frames:
            results = [one(row) for row in frame.to_dict("records")]
            yield frame.assign(value=pd.Series([v for v, _ in results], dtype="float64", index=frame.index), error=pd.Series([e for _, e in results], dtype="object", index=frame.index))

    fields = points.schema.simpleString()[len("struct<") : -1]
    return points.mapInPandas(run, f"{fields}, {schema}")


def has_failed(rows: DataFrame) -> DataFrame:
    """Study rows that brought nothing back: neither summaries nor kernels."""
    return rows.withColumn("failed", (F.size("summaries") == 0) & (F.size("kernels") == 0))


def _following(entry: np.ndarray, last: np.ndarray, interval: float) -> np.ndarray:
    """The place of the first entry that is an interval or more after each time; the number of entries where none is."""
    at = np.searchsorted(entry, last + interval)
    size = len(entry)
    for _ in range(2):  # a sum may be rounded to either side of the difference, which decides
        below = np.maximum(at - 1, 0)
        at = np.where((at > 0) & (entry[below] - last >= interval), below, at)
        here = np.minimum(at, size - 1)
        at = np.where((at < size) & (entry[here] - last < interval), at + 1, at)
    return at


#: Groups that one of the next level is made of, and levels. A group of the last level is FAN ** LEVELS intervals long.
FAN, LEVELS = 128, 3


def throttled(lines: DataFrame, by: str, interval: float) -> DataFrame:
    """Lines at which a sample is due: the first that comes an interval or more after the last sample (or after the start).

    Each sample depends on the one before it. A stretch of time is a function all the same: from where a chain of samples may
    enter it, which is one of the times in its first interval or the first time after that, to the last sample in it. Such functions are composed
    level by level, FAN stretches at a time; what is left of a job, some times for each FAN ** LEVELS intervals, is walked from
    its start, and the samples are found on the way back down. So a job falls into as many tasks as it has stretches, and a task holds the
    possible entries of FAN stretches. Of lines of one time the first by their other columns counts. A line without a time is never due.
    """
    if interval <= 0:
        raise ValueError("an interval is more than nothing")
    keys = lines.select(F.col(by).alias("job"), F.col("at").cast("double").alias("entry"), F.col("started").cast("double").alias("started"))
    times = keys.where("entry - started >= %r" % interval).groupBy("job", "entry").agg(F.max("started").alias("started"))
    levels = [times.withColumn("last", F.col("entry"))]
    width = lambda k: interval * FAN**k
    group = lambda k: F.floor((F.col("entry") - F.col("started")) / width(k)).cast("long")
    kind = times.select("job").schema.simpleString()[len("struct<") : -1]
    rows = f"{kind}, entry double, started double, last double"

    def dealt(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("group", group(k)).repartition("job", "group").sortWithinPartitions("job", "group", "entry")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("entry").to_numpy(), table.column("last").to_numpy()

    def composed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (job, number), table in runs_of(batches, ["job", "group"]):
                entry, last = arrays(table)
                started = table.column("started")[0].as_py()
                early = int(np.searchsorted(entry, started + number * width(k) + 2 * interval))  # twice, for what rounding does
                ends = last[: early + 1].copy()
                while (follow := _following(entry, ends, interval)).min() < len(entry):
                    ends = np.where(follow < len(entry), last[np.minimum(follow, len(entry) - 1)], ends)
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([job] * n, table.schema.field("job").type), pa.array(entry[:n]), pa.array(np.full(n, started)), pa.array(ends)], ["job", "entry", "started", "last"])

        return run

    def walked(first: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The entries that a chain takes, from the one that `first` names in each run, or from the first of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (job, _), table in runs_of(batches, ["job", "group"]):
                entry, last = arrays(table)
                at, taken = int(np.searchsorted(entry, table.column(first)[0].as_py())) if first else 0, []
                while at < len(entry):
                    taken.append(at)
                    at = int(_following(entry, last[at : at + 1], interval)[0])
                yield pa.RecordBatch.from_arrays([pa.array([job] * len(taken), table.schema.field("job").type), pa.array(entry[taken])], ["job", "entry"])

        return run

    for k in range(1, LEVELS + 1):
        levels.append(dealt(levels[-1], k).mapInArrow(composed(k), rows))
    top = levels[-1].withColumn("group", F.lit(0).cast("long")).repartition("job").sortWithinPartitions("job", "entry")
    chosen = top.mapInArrow(walked(""), f"{kind}, entry double")
    starts = times.groupBy("job").agg(F.max("started").alias("started"))
    for k in range(LEVELS, 0, -1):
        entered = chosen.join(starts.withColumnRenamed("job", "_job"), F.col("job").eqNullSafe(F.col("_job"))).select("_job", group(k).alias("_group"), F.col("entry").alias("first"))
        inside = levels[k - 1].withColumn("group", group(k)).join(entered, F.col("job").eqNullSafe(F.col("_job")) & (F.col("group") == F.col("_group")))
        chosen = inside.repartition("job", "group").sortWithinPartitions("job", "group", "entry").mapInArrow(walked("first"), f"{kind}, entry double")

    ties = [f.name for f in lines.schema if f.name not in (by, "at") and isinstance(f.dataType, AtomicType)]
    due = lines.join(chosen.select(F.col("job").alias("_job"), F.col("entry").alias("_entry")), F.col(by).eqNullSafe(F.col("_job")) & (F.col("at").cast("double") == F.col("_entry")))
    first = F.min_by(F.struct(*lines.columns), F.struct(*ties)) if ties else F.any_value(F.struct(*lines.columns))
    return due.groupBy("_job", "_entry").agg(first.alias("_line")).select("_line.*")
