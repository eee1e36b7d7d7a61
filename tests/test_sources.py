"""Literal cases of listings, file sources, sinks and streams."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon import schemas
from quillon.plans import queries
from quillon.sources import files, market, parsers, sinks, sqlite
from quillon.streaming import jobs


def blobs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, value string")


def test_listings_are_bounded(spark):
    n = 3 * queries.LISTED
    orders = spark.range(n).select(F.lit(7).alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    out = queries.listings(orders)
    assert [r.n for r in out.select((F.size(F.split("value", "\n")) - 2).alias("n")).collect()] == [queries.LISTED] * 3
    jobs = parsers.squeue(out)
    assert jobs.count() == n and jobs.select("job_id").distinct().count() == n and {r.id for r in jobs.select("id").distinct().collect()} == {7}


def test_squeue(spark):
    out = parsers.squeue(blobs(spark, "123|train|RUNNING|gpu|00:05:00\n\nshort|row\n")).collect()
    assert [(r.job_id, r.name, r.state, r.partition, r.elapsed) for r in out] == [("123", "train", "RUNNING", "gpu", "00:05:00")]


def test_sacct(spark):
    b = blobs(spark, "7.batch|FAILED|1:0\n7|CANCELLED by 1000|0:9\n7|COMPLETED|0:0", "8|COMPLETED|0:0").withColumn("job_id", F.lit("7"))
    assert [(r.id, r.state, r.exit_code) for r in parsers.sacct(b).collect()] == [(0, "CANCELLED", 9)]


def test_sinfo(spark):
    out = parsers.sinfo(blobs(spark, "gpu*\ncpu\ngpu*\n")).orderBy("line").collect()
    assert [r.name for r in out] == ["gpu", "cpu"]


def test_qstat_layouts(spark):
    standard = "\nJob ID  Name User Time S Queue\n---- ---- ---- ---- - ----\n1.srv train me 00:01 R gpu\n2.srv x me Q small\nshort row\n"
    wide = "JOB_ID JOB_NAME STATUS PROJECT QUEUE START ELAPSE TOKEN\n------\n9 run RUNNING p gpu a b c\n8 few RUNNING p\n"
    out = {(r.id, r.job_id, r.name, r.state, r.queue) for r in parsers.qstat(blobs(spark, standard, wide, "nothing")).collect()}
    assert out == {(0, "1.srv", "train", "R", "gpu"), (0, "2.srv", "x", "Q", "small"), (1, "9", "run", "R", "gpu")}


def test_qstat_full(spark):
    text = "Job Id: 5.srv\n    Job_Name = a = b\n    job_state = F\n    Exit_status = 3\n    queue = gpu\nJob Id: 6.srv\n    Job_Name = c\n"
    out = {(r.job_id, r.name, r.state, r.queue, r.exit_status) for r in parsers.qstat_full(blobs(spark, text)).collect()}
    assert out == {("5.srv", "a = b", "F", "gpu", 3), ("6.srv", "c", "Q", "", None)}


def test_queues(spark):
    q = parsers.qstat_queues(blobs(spark, "server: x\n\nQueue Mem\n----- ---\ngpu -- 3\ncpu -- 1\n      ---\n      4\n")).orderBy("line").collect()
    assert [r.name for r in q] == ["gpu", "cpu"]
    r = parsers.resource_queues(blobs(spark, "route\n|-- gpu [ENABLE, START]\n`-- old [DISABLE]\n")).collect()
    assert [x.name for x in r] == ["gpu"]


def test_pueue(spark):
    doc = {"tasks": {"1": {"id": 1, "label": "a", "status": {"Running": {"start": "2024-01-01"}}}, "2": {"id": 2, "status": {"Done": {"result": "Success"}}}, "3": {"id": 3, "status": {"Done": {"result": {"Failed": 9}}}}}}
    out = sorted((r.task, r.label, r.state, r.result, r.exit_code) for r in parsers.pueue(blobs(spark, json.dumps(doc))).collect())
    assert out == [(1, "a", "Running", None, None), (2, None, "Done", "Success", 0), (3, None, "Done", "Failed", 9)]


def test_capabilities(spark):
    text = "root=/w=x\nkind=slurm\naccount=\nqueue=q\ngpu=A100, 81920\nmem=65960000\nplatform=linux-64\npixi=\nuv=1\nnoise"
    r = parsers.capabilities(blobs(spark, text)).first()
    assert (r.root, r.gpu_name, r.gpu_mem_mb, r.sysmem_gb) == ("/w=x", "A100", 81920, 63)


def test_small_listings(spark):
    hosts = parsers.ssh_hosts(blobs(spark, "Host a b*\n  HostName x\nhost\tc a\nHost *\n")).orderBy("line", "at").collect()
    assert [r.alias for r in hosts] == ["a", "c"]
    env = parsers.dotenv(blobs(spark, "# c\nexport A='x y'\nB=1=2\nA=z\nnone\nHOME=/root"), spark.createDataFrame([("HOME",)], "name string")).collect()
    assert {r.name: r.value for r in env} == {"A": "x y", "B": "1=2"}
    cpu = parsers.cpu_records(blobs(spark, "a : 1\nb: 2:3\na: 4\n\nb : 5\n")).orderBy("ordinal").collect()
    assert [r.fields for r in cpu] == [{"a": "4", "b": "2:3"}, {"b": "5"}]
    group = parsers.cgroup(blobs(spark, "5:cpu,memory:/v1\n0::/v2/x\n", "3:memory:/only\n")).orderBy("id").collect()
    assert [(r.version, r.path) for r in group] == [(2, "/v2/x"), (1, "/only")]
    crates = parsers.installed_crates(blobs(spark, '[v1]\n"ripgrep 14.1.0 (registry+x)" = ["rg"]\n')).collect()
    assert [(r.name, r.version) for r in crates] == [("ripgrep", "14.1.0")]


def test_market(spark):
    rows = spark.createDataFrame([("vastai", "A", 1, 1.5, None, None), ("b", "B", 1, 0.0, None, None), ("c", "C", 1, None, None, None)], "provider string, gpu_name string, gpu_count int, price double, spot boolean, location string")
    assert [r.provider for r in market.from_feed(rows).collect()] == ["vast"]
    family = spark.createDataFrame([("H", [("r", "1", [(8, "t1", "Out", [("perHour", 2.0)]), (4, "t2", "InStock", [("perDay", 1.0)]), (2, "t3", "InStock", [("perDay", 9.0), ("perHour", 5.0)])])])], f"gpuName string, regionInfos {market.REGIONS}")
    assert [(r.instance_type_id, r.usd_hr) for r in market.console_catalog(family).collect()] == [("t2", 0.0), ("t3", 5.0), ("t1", 2.0)]


def test_ledgers(spark, tmp_path):
    assert files.observations(spark, str(tmp_path / "none.ndjson")).count() == 0
    (tmp_path / "costs.ndjson").write_text('{"provider":"a"}\n\n{"provider":"b","gpu":"g","t_submit":1.5}\n')
    assert files.observations(spark, str(tmp_path / "costs.ndjson"), gpu="g").first().t_submit == 1.5
    assert files.observations(spark, str(tmp_path / "costs.ndjson"), provider="a").first().t_running == 0.0
    (tmp_path / "s1.jsonl").write_text('{"at":"1","kind":"created","name":"n"}\n{"at":"2","kind":"submitted","handle":"7"}\n')
    rows = files.study_events(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.study_id, r.kind, r.ordinal) for r in rows] == [("s1", "created", 1), ("s1", "submitted", 2)]


def frame(offset, kind="line", job="j", arrival=0, payload="{}"):
    return json.dumps({"schema_version": 1, "job": job, "kind": kind, "offset": offset, "at": "2024-01-01T00:00:00Z", "payload": payload, "arrival": arrival})


def test_log_segments(spark, tmp_path):
    import zstandard

    old = (frame(0) + "\n" + frame(100) + "\n").encode()
    name = f"{0:020d}-{len(old):020d}.ndjson.zst"
    (tmp_path / name).write_bytes(zstandard.compress(old))
    (tmp_path / "live.ndjson").write_text(frame(300) + "\n" + frame(400)[:20])
    assert [(r.start, r.end) for r in files.segments(spark, str(tmp_path)).orderBy("start").collect()][0] == (0, len(old))
    assert sorted(r.offset for r in files.frames_from(spark, str(tmp_path), 0).collect()) == [0, 100, 300]
    assert [r.offset for r in files.frames_from(spark, str(tmp_path), len(old)).collect()] == [300]
    assert files.heartbeat(spark, str(tmp_path)).count() == 0


def test_corrupt_line_fails(spark, tmp_path):
    (tmp_path / "live.ndjson").write_text("nonsense\n" + frame(3) + "\n")
    with pytest.raises(PySparkException):
        files.frames_from(spark, str(tmp_path)).collect()


def test_table_and_profile(spark, tmp_path):
    folder = str(tmp_path / "t")
    read = lambda: {r.k: r.v for r in sinks.current(spark, folder, "k int, v string", ["k"]).collect()}
    assert read() == {}
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, arrival long")
    sinks.put(rows((1, "a", 0), (2, "b", 0), (1, "c", 1)), folder, 0)
    sinks.put(rows((2, "d", 0)), folder, 1)
    sinks.put(rows((2, "d", 0)), folder, 1)  # a batch that is written again
    assert read() == {1: "c", 2: "d"}
    kernels = spark.createDataFrame([("b", 5, 1), ("a", 2, 0)], "name string, start_ns long, ordinal int")
    sinks.profile_document("gpu", "host", kernels=kernels).coalesce(1).write.text(str(tmp_path / "p"))
    doc = files.profiles(spark, str(tmp_path / "p"))
    back = files.profile_records(doc, "kernels").orderBy("ordinal").collect()
    assert [(r.name, r.start_ns, r.grid) for r in back] == [("a", 2, ""), ("b", 5, "")]


def test_sqlite(spark, tmp_path):
    path = tmp_path / "s.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE runs (target TEXT, handle TEXT, data TEXT, submitted_at TEXT)")
        c.executemany("INSERT INTO runs VALUES ('t', ?, ?, '1')", [(str(i), json.dumps({"verdict": "ok" if i % 2 else None})) for i in range(50)])
    out = sqlite.runs(spark, str(path))
    assert out.count() == 50 and out.where("verdict = 'ok'").count() == 25


def test_sqlite_answers_filters(spark, tmp_path):
    """What a filter leaves out is never read, and what SQLite would decide otherwise is left to Spark."""
    from pyspark.sql import functions as F
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith
    from pyspark.sql.types import StructType

    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (name TEXT, n INTEGER, x REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(None if i % 10 == 3 else f"Name{i % 7}", i, i / 4) for i in range(1000)])
    schema = "name string, n int, x double"

    def read(*filters):
        reader = sqlite.SqliteReader({"path": path, "table": "t"}, StructType.fromDDL(schema))
        left = list(reader.pushFilters(list(filters)))
        return left, sum(len(list(reader.read(p))) for p in reader.partitions())

    assert read() == ([], 1000)
    assert read(EqualTo(("name",), "Name3")) == ([], sum(i % 7 == 3 and i % 10 != 3 for i in range(1000)))
    assert read(EqualTo(("name",), "name3"))[1] == 0 and read(StringStartsWith(("name",), "name"))[1] == 0  # letters as they are
    assert read(GreaterThan(("n",), 989), IsNotNull(("name",))) == ([], 9)
    assert read(Not(IsNull(("name",))), In(("n",), (3, 4, 5))) == ([], 2)
    for f in (EqualTo(("n",), "3"), EqualTo(("x",), 0.25), In(("n",), (1, None))):
        assert read(f) == ([f], 1000)
    rows = sqlite.table(spark, path, "t", schema)
    want = [(f"Name{i % 7}", i, i / 4) for i in range(1000) if i % 10 != 3 and i % 7 == 3 and i / 4 > 100]
    found = rows.where((F.col("name") == "Name3") & (F.col("x") > 100))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    assert rows.where("NOT (name = 'Name3')").count() == sum(i % 10 != 3 and i % 7 != 3 for i in range(1000))


def test_ledger_lines_are_counted_by_split(spark, tmp_path):
    for name, n in (("s1", 5000), ("s2", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"at": str(i), "kind": "note"}) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = files.study_events(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 5003 and all(r.ordinal == int(r.at) + 1 for r in rows)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    from quillon.operators import frames

    (tmp_path / "in").mkdir()
    lines = [frame(0, "started", arrival=0), frame(5, "sample", arrival=1, payload='{"rss": 7}'), frame(9, "ended", arrival=2, payload='{"exit_code": 3}')]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    stream = lambda: jobs.frame_stream(spark, str(tmp_path / "in"), 1)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.catch_up(stream(), out, check)
    (tmp_path / "in" / "b.json").write_text("\n".join([frame(0, "started", arrival=5), frame(1, "started", "k", 6)]))
    assert [r.offset for r in jobs.follow(stream(), out, check, "j", since=3, passes=2).collect()] == [5, 9]
    states = {r.job: (r.state, r.exit_code) for r in jobs.job_states(spark, out).collect()}
    assert states == {"j": ("ended", 3), "k": ("running", None)}
    batch = spark.read.schema(schemas.FRAME.replace("at string", "at timestamp") + ", arrival long").json(str(tmp_path / "in"))
    want = {r.job: (r.state, r.exit_code) for r in frames.project(frames.first_writes(batch)).collect()}
    assert states == want
    assert [r.rss for r in jobs.stored_samples(spark, out).collect()] == [7]
    second = sinks.batches(spark, f"{out}/moves", jobs.MOVES).where("batch = 1")
    assert second.count() == 1 and second.first().job == "k"  # the second batch only wrote the job that it touched
    jobs.ingest(out)(batch, 1)  # a batch that is run again
    assert {r.job: (r.state, r.exit_code) for r in jobs.job_states(spark, out).collect()} == want and jobs.stored_frames(spark, out).count() == 4
    back = str(tmp_path / "strict")
    jobs.ingest(back, strict_compat=True)(batch, 0)
    assert {r.job: r.state for r in jobs.job_states(spark, back).collect()} == {"j": "running", "k": "running"}
    query = jobs.watch(stream(), str(tmp_path / "watched"), str(tmp_path / "watching"), 0.2)
    query.processAllAvailable()
    query.stop()
    assert {r.job: (r.state, r.exit_code) for r in jobs.job_states(spark, str(tmp_path / "watched")).collect()} == want
