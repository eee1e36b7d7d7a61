"""What larger tables show: results that must not depend on how rows are dealt, and work that must not grow with keys, files or slices."""

from __future__ import annotations

import random
from functools import reduce

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.operators import costs, runs
from quillon.sources import logs, sinks
from quillon.streaming import states


@pytest.fixture
def dealt(spark):
    """Many small partitions, which adaptive execution joins by their bytes."""
    asked = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_commands_are_numbered_over_ranges_that_are_drawn_once(dealt):
    k = F.col("id")
    commands = dealt.range(0, 60_000, 1, 8).select(k.alias("ordinal"), F.concat(F.lit("command-"), F.sha2(k.cast("string"), 256)).alias("command"), F.array(k.cast("string")).alias("args"))
    rows = sinks.command_events(commands, 100)
    right = (F.col("id") == F.col("ordinal") + 101) & (F.length("command") == 72)  # the text is asked for, so that its ranges are those of whole rows
    assert rows.groupBy(right.alias("right")).count().collect() == [(True, 60_000)]


def test_durations_of_trace_events_are_summed_whole(spark, tmp_path):
    draw = random.Random(1)
    draw_all = [[draw.randrange(0, 9) for _ in range(40)] for _ in range(2)]
    taxes = draw_all[1]  # their microseconds, summed one by one, give 18.499999999999996
    assert sum(taxes) * 100 == 18_500 and reduce(lambda a, t: a + t / 10, taxes, 0.0) < 18.5
    con = duckdb.connect()
    part = con.execute("SELECT * FROM read_parquet('/root/testdata/sf0.001/part.parquet') LIMIT 1").to_arrow_table()
    con.register("one", part)
    con.execute(f"COPY one TO '{tmp_path}/part.parquet'")
    lines = con.execute("SELECT * REPLACE ((SELECT p_partkey FROM one) AS l_partkey, 0.01 AS l_discount) FROM read_parquet('/root/testdata/sf0.001/lineitem.parquet') LIMIT 40").to_arrow_table()
    lines = lines.set_column(lines.column_names.index("l_tax"), "l_tax", [[t / 100 for t in taxes]])
    con.register("lines", lines)
    con.execute(f"COPY lines TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    out = entry.queries()["trace_events"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({entry.oracle_sql()['trace_events']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {r.dur for r in out.where("tid = 2").collect()} == {19}


@pytest.mark.parametrize("held", [costs.HELD, 10])
def test_quantiles_work_rows_out_once(spark, monkeypatch, held):
    monkeypatch.setattr(costs, "HELD", held)
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 6000, 1, 3).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 1000).cast("double").alias("v")).mapInArrow(seen, "k long, v double")
    got = {r.k: (r.samples, r.mean, r.q0, r.q1) for r in costs.quantiles(rows, ["k"], "v", (0.5, 0.9)).collect()}
    assert worked.value == 6000
    for k in (0, 1):
        v = [float(i * 7919 % 1000) for i in range(k, 6000, 2)]
        assert got[k] == (3000, pytest.approx(np.mean(v)), pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9)))


class Map(dict):
    """A map state in memory."""

    exists, getValue, containsKey, updateValue = dict.__len__, dict.get, dict.__contains__, dict.__setitem__


class Handle:
    def getMapState(self, *_):  # noqa: N802
        return Map()


@pytest.mark.parametrize("block", [states.BLOCK, 4])
def test_one_call_takes_all_jobs_of_a_bucket(monkeypatch, block):
    monkeypatch.setattr(states, "BLOCK", block)
    processor = states.JobProcessor(False, False)
    processor.init(Handle())
    draw = random.Random(4)
    frames = [(f"j{draw.randrange(300)}", draw.choice(["started", "ended", "line"]), draw.randrange(200_000), n) for n in range(4000)]
    frames += [(job, "ended", offset, 5000 + n) for n, (job, _, offset, _) in enumerate(frames[:500])]  # replays
    seen, got, moved = {}, [], {}
    for part in (frames[:1500], frames[1500:]):
        rows = pd.DataFrame([(j, k, o, a * 10, "{}", a, None, None) for j, k, o, a in part], columns=["job", "kind", "offset", "at", "payload", "arrival", "exit_code", "time"])
        for out in processor.handleInputRows((7,), iter([rows[:700], rows[700:]]), None):
            got += [(r.job, r.offset, r.arrival) for r in out[out.what == "frame"].itertuples()]
            moved |= {r.job: (r.started_arrival, r.ended_arrival) for r in out[out.what == "state"].itertuples()}
    for job, kind, offset, arrival in frames:
        seen.setdefault((job, offset), (arrival, kind))
    assert sorted(got) == sorted((j, o, a) for (j, o), (a, _) in seen.items())
    last = lambda job, kind: max((a for (j, _), (a, k) in seen.items() if j == job and k == kind), default=pd.NA)
    assert {j: tuple(map(str, m)) for j, m in moved.items()} == {j: (str(last(j, "started")), str(last(j, "ended"))) for j in moved} and len(moved) > 250
    assert max(len(v[0]) for v in processor.seen.values()) <= 8 * block
    assert block == 4 or len(processor.seen) == len({j for j, _ in seen})  # one entry for each job, however far apart its offsets are


def test_archives_are_read_together(tmp_path, monkeypatch):
    """A task reads many small archives, and does not list the folder for it."""
    at = 0
    for n in range(200):
        data = "".join(f"{n}-{k}\n" for k in range(5)).encode()
        with pa.CompressedOutputStream(pa.OSFile(str(tmp_path / f"{at:020d}-{at + len(data):020d}.ndjson.zst"), "wb"), "zstd") as f:
            f.write(data)
        at += len(data)
    reader = logs.LogReader({"path": str(tmp_path), "since": "11", "partitionbytes": "1000"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert at // 1000 <= len(parts) <= at // 800 + 1
    monkeypatch.setattr(logs, "segments", None)
    got = [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()]
    assert got == [f"{n}-{k}" for n in range(200) for k in range(5)][3:]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_small_runs_are_taken_together(size):
    draw = random.Random(size)
    keys = sorted((draw.choice([None, 1, 2]) or 0, draw.randrange(400)) for _ in range(3000))
    table = pa.table({"track": [k or None for k, _ in keys], "slice": [s for _, s in keys], "n": range(3000)})
    batches = table.to_batches(max_chunksize=size)
    got, tables = [], 0
    for part, bounds in runs.groups_of(iter(batches), ["track", "slice"]):
        tables += 1
        got += [part.column("n").to_pylist()[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [t.column("n").to_pylist() for _, t in runs.runs_of(iter(batches), ["track", "slice"])] and tables <= len(batches) + 1
