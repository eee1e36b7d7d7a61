"""Logs as a stream source and a two-phase sink, and the keyed state of job streams."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.sources import files, logs
from quillon.streaming import jobs, states


def line(kind, at, job="j", second=0, payload="{}"):
    return json.dumps({"schema_version": 1, "job": job, "kind": kind, "offset": at, "at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "payload": payload}) + "\n"


class Log:
    """A writer of a log, as a job has one."""

    def __init__(self, folder: Path) -> None:
        self.folder, self.base, self.end = folder, 0, 0
        folder.mkdir()
        (folder / "live.ndjson").write_bytes(b"")

    def write(self, text: str) -> None:
        with (self.folder / "live.ndjson").open("ab") as f:
            f.write(text.encode())
        self.end += len(text.encode())

    def frame(self, kind: str, **more) -> int:
        at = self.end
        self.write(line(kind, at, **more))
        return at

    def roll(self) -> None:
        data = (self.folder / "live.ndjson").read_bytes()
        (self.folder / f"{self.base:020d}-{self.end:020d}.ndjson.zst").write_bytes(zstandard.compress(data))
        (self.folder / "live.ndjson").write_bytes(b"")
        self.base = self.end


def test_follow_a_log_over_restarts(spark, tmp_path):
    log = Log(tmp_path / "log")
    at = [log.frame("started"), log.frame("line", payload='{"text": "é"}')]
    log.roll()
    at += [log.frame("line"), log.frame("sample", payload='{"rss": 5}')]
    torn = line("line", log.end)
    log.write(torn[:30])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def caught_up():
        jobs.catch_up(jobs.log_stream(spark, str(log.folder), since=at[1]), out, check)
        return sorted(r.offset for r in jobs.stored_frames(spark, out).collect())

    assert caught_up() == at[1:]  # from a byte on, without the line that is not finished
    at.append(log.end - 30)
    log.write(torn[30:])
    log.roll()  # the bytes that are wanted next have moved to an archive
    at.append(log.frame("ended", payload='{"exit_code": 4}'))
    assert caught_up() == at[1:]
    assert caught_up() == at[1:]  # nothing has come
    assert [(r.job, r.state, r.exit_code) for r in jobs.job_states(spark, out).collect()] == [("j", "ended", 4)]
    batches = [r.n for r in jobs.stored_frames(spark, out).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert batches == [3, 2]


def test_lines_of_any_range(tmp_path, monkeypatch):
    log = Log(tmp_path / "log")
    texts = ["", "a", "é" * 9, "b" * 40, "", "c"]
    starts = []
    for n, t in enumerate(texts * 3):
        starts.append((log.end, t.encode()))
        log.write(t + "\n")
        if n in (4, 9):
            log.roll()
    assert logs.complete_end(str(log.folder)) == log.end
    log.write("torn")
    monkeypatch.setattr(logs, "BLOCK", 7)
    assert logs.complete_end(str(log.folder)) == log.end - 4
    for low in range(0, log.end, 3):
        for high in range(low, log.end + 4, 11):
            want = [s for s in starts if low <= s[0] < high]
            assert [x for x in logs.read_lines(str(log.folder), low, high) if x[0] < log.end - 4] == want
    reader = logs.LogReader({"path": str(log.folder), "since": "20", "partitionbytes": "10"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 4
    got = [x for p in parts for b in reader.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == [(a, t.decode()) for a, t in starts if a >= 20]
    assert logs.complete_end(str(tmp_path / "none")) == 0


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.range(400).select((F.col("id") * 10).alias("offset"), F.rpad(F.col("id").cast("string"), 9, "x").alias("line")).repartition(4)
    bad = rows.withColumn("line", F.when(F.col("offset") == 3990, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(PySparkException, match="broken"):
        logs.roll(bad, folder, 500)
    assert logs.segments(folder) == [] and not list(Path(folder).glob("*.zst"))
    assert logs.roll(rows, folder, 500) == 4000
    assert [(s.start, s.end) for s in logs.segments(folder)] == [(k, k + 500) for k in range(0, 4000, 500)]
    assert [p.name for p in Path(folder).iterdir() if not p.name.endswith(".zst")] == []
    assert logs.roll(rows, folder, 500) == 4000  # written again, under the same names
    assert [x[0] for x in logs.read_lines(folder, 0, 4000)] == list(range(0, 4000, 10))
    assert files.segments(spark, folder).count() == 8
    assert logs.roll(rows.where("false"), str(tmp_path / "none"), 500) == 0


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_state_is_given_up_after_the_end(spark, tmp_path):
    """Frames of a job are known for as long as they may come again, and no longer; replays change nothing."""
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    arrival = iter(range(1000))

    def batch(name, *frames_):
        text = "".join(json.dumps(json.loads(f) | {"arrival": next(arrival)}) + "\n" for f in frames_)
        (folder / name).write_text(text)
        jobs.catch_up(jobs.frame_stream(spark, str(folder)), out, check, delay="60 seconds")

    with_jobs = lambda n: [line("started", 0, f"j{k}", 0) for k in range(n)] + [line("line", 1 + m, f"j{k}", 1) for k in range(n) for m in range(20)]
    batch("a.json", *with_jobs(5))
    with states.rocks(spark):
        assert state_rows(spark, check, "move") == 5 and state_rows(spark, check, "seen") == 5  # a block for a job, whatever its frames
    batch("b.json", *[line("ended", 50, f"j{k}", 10, '{"exit_code": 1}') for k in range(3)], *with_jobs(2))  # and a replay
    assert jobs.stored_frames(spark, out).count() == 5 * 21 + 3
    batch("c.json", line("line", 60, "j4", 200))
    batch("d.json", line("line", 61, "j4", 201), line("started", 0, "j0", 0))  # a replay beyond the delay is late
    with states.rocks(spark):
        assert state_rows(spark, check, "move") == 2 and state_rows(spark, check, "seen") == 2
    assert {r.job: r.state for r in jobs.job_states(spark, out).collect()} == {"j0": "ended", "j1": "ended", "j2": "ended", "j3": "running", "j4": "running"}
    assert jobs.stored_frames(spark, out).count() == 5 * 21 + 3 + 2
