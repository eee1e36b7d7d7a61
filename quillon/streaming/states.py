"""Keyed state of job streams: which frames of a job have been seen, and what its state is.

Jobs are dealt into BUCKETS by their hash, and one processor for each bucket takes the frames of all its jobs at once: a call for each job would cost
more than the frames of most jobs. Its maps keep for each job the last start and the last end, and the offsets that were seen, in sorted blocks
which are split when they are full, so that a batch costs what it brings and never what came before. A timer gives up the state of a job once the watermark
is past its end: whatever frame of it comes then is late, and would be left out anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Offsets that one entry of state holds at most; a fuller one is split. Where a job's first one begins.
BLOCK, LEAST = 8192, -(1 << 63)
#: Groups of jobs whose state is kept side by side. Another number needs another checkpoint.
BUCKETS = 1024
#: The last start and the last end of a job; times are microseconds, which mean the same in every zone.
MOVE = "started_arrival long, started_at long, ended_arrival long, ended_at long, exit_code int"
#: A frame that was not seen before (what = 'frame'), or the state of a job that such frames have changed ('state').
OUT = f"what string, job string, kind string, offset long, at long, payload string, arrival long, {MOVE}"
_MOVE = ["started_arrival", "started_at", "ended_arrival", "ended_at", "exit_code"]
_TYPES = dict.fromkeys(["what", "job", "kind", "payload"], "object") | dict.fromkeys(["offset", "at", "arrival", *_MOVE], "Int64")
_COLUMNS = ["what", "job", "kind", "offset", "at", "payload", "arrival", *_MOVE]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _rows(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.reindex(columns=_COLUMNS).astype(_TYPES)


class JobProcessor(StatefulProcessor):
    """First writes of the frames of a bucket's jobs, and the jobs' states."""

    def __init__(self, timed: bool, strict: bool) -> None:
        self.timed, self.strict = timed, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "job string, begin long", "offsets binary")
        self.move = handle.getMapState("move", "job string", MOVE)
        self.blocks = handle.getMapState("blocks", "job string", "begins binary")  # of a job with more than one block
        self.due = handle.getMapState("due", "at long", "jobs array<string>")

    def _begins(self, job: str, filled: bool = True) -> np.ndarray:
        """Where the blocks of a job's offsets begin."""
        split = filled and self.blocks.containsKey((job,))
        return np.frombuffer(self.blocks.getValue((job,))[0], np.int64) if split else np.array([LEAST], np.int64)

    def _new(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The frames of which no frame of the same job and offset was seen; of those of one offset the first arrival."""
        rows = rows.sort_values("arrival", kind="stable").drop_duplicates(["job", "offset"])
        offsets, (codes, jobs) = rows["offset"].to_numpy(np.int64), pd.factorize(rows["job"], use_na_sentinel=False)
        order = np.lexsort((offsets, codes))
        bounds = np.r_[0, np.cumsum(np.bincount(codes))].tolist()
        fresh, filled = np.zeros(len(rows), bool), self.seen.exists()
        for job, low, high in zip(jobs, bounds[:-1], bounds[1:], strict=True):
            own, begins, added = order[low:high], self._begins(job, filled), []
            place = np.searchsorted(begins, offsets[own], "right") - 1
            for block in np.unique(place).tolist():
                new, begin, known = own[place == block], int(begins[block]), np.empty(0, np.int64)
                if filled and self.seen.containsKey((job, begin)):
                    known = np.frombuffer(self.seen.getValue((job, begin))[0], np.int64)
                    new = new[~np.isin(offsets[new], known)]
                if len(new):
                    fresh[new] = True
                    held = np.union1d(known, offsets[new])
                    parts = np.array_split(held, 1 if len(held) <= BLOCK else -(-len(held) // (BLOCK // 2)))
                    for part in parts:
                        self.seen.updateValue((job, begin if part is parts[0] else int(part[0])), (part.tobytes(),))
                    added += [int(part[0]) for part in parts[1:]]
            if added:
                self.blocks.updateValue((job,), (np.sort(np.r_[begins, np.array(added, np.int64)]).tobytes(),))
        return rows[fresh]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = pd.concat(rows)  # a bucket's frames of one batch, which the trigger bounds; two of one offset have to meet
        new = self._new(held)
        if len(new):
            yield _rows(new.drop(columns=["exit_code", "time"]).assign(what="frame"))
        moving = held.sort_values("arrival", kind="stable") if self.strict else new
        filled, moves, changed = self.move.exists(), {}, {}
        number = lambda v: None if pd.isna(v) else int(v)
        for kind in ("started", "ended"):
            last = moving[moving["kind"] == kind].drop_duplicates("job", keep="last").astype({"arrival": "Int64", "at": "Int64", "exit_code": "Int64"})
            for job, arrival, at, code in zip(*(last[c].tolist() for c in ("job", "arrival", "at", "exit_code")), strict=True):
                if job not in moves:
                    known = self.move.getValue((job,)) if filled and self.move.containsKey((job,)) else [None] * len(_MOVE)
                    moves[job] = dict(zip(_MOVE, known, strict=True))
                now = moves[job]
                if now[f"{kind}_arrival"] is None or arrival > now[f"{kind}_arrival"]:
                    now |= {f"{kind}_arrival": number(arrival), f"{kind}_at": number(at)} | ({"exit_code": number(code)} if kind == "ended" else {})
                    changed[job] = now
        due: dict[int, list[str]] = {}
        for job, now in changed.items():
            self.move.updateValue((job,), tuple(now[c] for c in _MOVE))
            if self.timed and self._over(now):
                due.setdefault(now["ended_at"] // 1000 + 1, []).append(job)
        for at, jobs in due.items():
            before = list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), ([*before, *jobs],))
            if not before:
                self.handle.registerTimer(at)
        if changed:
            yield _rows(pd.DataFrame([now | {"what": "state", "job": job} for job, now in changed.items()]))

    @staticmethod
    def _over(move: dict) -> bool:
        return move["ended_arrival"] is not None and move["ended_at"] is not None and (move["started_arrival"] is None or move["ended_arrival"] > move["started_arrival"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for job in self.due.getValue((at,))[0] if self.due.containsKey((at,)) else []:
            known = self.move.getValue((job,)) if self.move.containsKey((job,)) else None
            if known is None or not self._over(dict(zip(_MOVE, known, strict=True))):  # it was started again
                continue
            for begin in self._begins(job).tolist():
                self.seen.removeKey((job, begin))
            self.blocks.removeKey((job,))
            self.move.removeKey((job,))
        self.due.removeKey((at,))
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which keyed state needs; others keep what they have."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def first_writes(frames: DataFrame, delay: str | None = None, strict: bool = False) -> DataFrame:
    """A stream of frames (job, kind, offset, at, payload, arrival) as OUT: frames that are new, and states that they change.

    delay: how much later than others a frame may come, by its time; one that comes later is left out, and the state of a job is given up
    that long after its end. Without it all frames count, and all state is kept. With strict, frames that were seen before change states too.
    """
    code = F.get_json_object("payload", "$.exit_code").try_cast("int").alias("exit_code")
    timed = frames.withWatermark("at", delay) if delay else frames
    bucket = F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).alias("bucket")
    slim = timed.select(bucket, "job", "kind", "offset", F.unix_micros("at").alias("at"), "payload", "arrival", code, F.col("at").alias("time"))
    return slim.groupBy("bucket").transformWithStateInPandas(JobProcessor(delay is not None, strict), OUT, "Update", "EventTime" if delay else "None")
