"""Literal cases of operators that no registered query runs."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import numeric, text
from quillon.operators import config, costs, fleet, frames, lab, packages, render, state, trace
from quillon.sources import files, market, parsers, logs, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_commands(spark):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "id int, command string")
    assert [r.id for r in state.recent_commands(rows, 2).collect()] == [3, 4]
    new = spark.createDataFrame([("run", [None, "host", "x"], 0), ("ls", [], 1)], "command string, args array<string>, ordinal int")
    assert [(r.id, r.target) for r in sinks.command_events(new, 4).orderBy("id").collect()] == [(5, "host"), (6, None)]


def test_host_facts(spark):
    doc = {"hostname": "h", "gpus": [{"name": "A"}], "later": 1}
    rows = spark.createDataFrame([("motd {not yet\n".replace("{", "") + json.dumps(doc),)], "value string")
    assert files.host_facts(rows).first().gpus[0].name == "A"
    with pytest.raises(PySparkException, match="no record"):
        files.host_facts(spark.createDataFrame([("nothing",)], "value string")).collect()


def test_candidates_and_drives(spark):
    rows = spark.createDataFrame([("a", True, 2), ("b", True, 1), ("c", False, 0)], "path string, usable boolean, priority int")
    assert fleet.first_usable(rows).first().path == "b"
    assert fleet.first_usable(rows.where("not usable")).count() == 0
    blocks = spark.createDataFrame([("h", "sda", "100"), ("h", "loop0", "9"), ("h", "sdb", "x"), ("h", "nvme0", "5")], "host string, name string, size string")
    own = fleet.drives(blocks)
    assert [r.name for r in own.collect()] == ["nvme0", "sda"] and fleet.total_bytes(own).first().total_bytes == 105
    parts = spark.createDataFrame([("h", "sda1", "rw,noatime", 5, 10), ("h", "sdaa1", "ro,x", 0, 0), ("h", "sdb1", "", 1, 1)], "host string, device string, options string, used_bytes long, total_bytes long")
    out = sorted((r.device, r.drive, r.readonly, r.utilization_pct) for r in fleet.drive_partitions(own, parts).collect())
    assert out == [("sda1", "sda", False, 50.0), ("sdaa1", "sda", True, 0.0)]


def test_append_and_roll(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "provider string, x int")
    sinks.append(rows, str(tmp_path / "l"))
    sinks.append(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    sinks.replace(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    sinks.heartbeat(spark, str(tmp_path), "running", 7, 0, "t")
    assert files.heartbeat(spark, str(tmp_path)).first().offset == 7
    lines = frames.stamped(spark.createDataFrame([(i, f'{{"job":"j","offset":{7 * i}}}') for i in range(20)], "ordinal int, line string"), [])
    end = logs.roll(lines, str(tmp_path / "r"), 100)
    found = files.segments(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert len(found) > 3 and found[-1].end == end and all(a.end == b.start for a, b in zip(found, found[1:], strict=False))
    assert files.frames_from(spark, str(tmp_path / "r")).count() == 20


def test_frames_are_encoded(spark):
    rows = spark.createDataFrame([("j", "line", 5, 1, '{"text": "é"}')], "job string, kind string, offset long, schema_version int, payload string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    line = frames.encode(rows).first()
    assert json.loads(line.line)["payload"] == {"text": "é"} and line.encoded_length == len(line.line.encode()) + 1


def test_merge_document(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, sync string, clock string, offset_ns long, ordinal int")
    doc = json.loads(render.merge_document(rows(("b.json", "s", None, 0, 1), ("a.pb", None, "mono", 5, 0))).first()[0])
    assert doc == {"sources": [{"path": "a.pb", "clock": "mono", "offset_ns": 5}, {"path": "b.json", "sync": "s"}]}
    with pytest.raises(PySparkException, match="no sync target"):
        render.merge_document(rows(("b.json", None, None, 0, 0))).collect()


def test_report_text(spark):
    k = spark.createDataFrame([("gemm", 0, 100, 0)], "name string, start_ns long, end_ns long, ordinal int")
    c = spark.createDataFrame([(0, 10, 40)], "start_ns long, end_ns long, bytes_moved long")
    none = spark.createDataFrame([], "avg_memory_util_pct double, avg_util_pct double, peak_memory_bytes long, avg_memory_bytes long")
    report = trace.profile_report(k, c, none, 3, 8.0, 1, 7)
    value = trace.report_text(report).first()[0]
    assert "compute-bound after 3" in value and "gemm" in value and "memcpy, memset" in value and "4.0 of 8.0" in value
    assert trace.profile_report(k.where("false"), c.where("false"), none, 1, 0.0).first().bound == "unknown"


def test_small_predicates(spark):
    assert one(spark, text.inherited(F.lit("Queued"), F.lit(None).cast("string"), F.lit("2024-01-01"))) is True
    assert one(spark, text.inherited(F.lit("Running"), F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-01"))) is False
    assert one(spark, text.inherited(F.lit("Done"), F.lit(None).cast("string"), F.lit("2024-01-01"))) is False
    assert one(spark, fleet.scheduler(F.array(F.lit("pueue"), F.lit("slurm")))) == "slurm"
    assert one(spark, fleet.scheduler(F.array().cast("array<string>"))) == "none"
    assert one(spark, fleet.release_flags(F.lit("aarch64"), F.lit("NeoVerse-V2"))) == ["-mcpu=neoverse-v2"]
    assert one(spark, fleet.release_flags(F.lit("sparc"), F.lit(""))) == []
    assert one(spark, fleet.route(F.lit("slurm"), ("vast",))) == "ssh-family" and one(spark, fleet.route(F.lit("vast"), ("vast",))) == "vast"
    with pytest.raises(PySparkException, match="unknown kind"):
        one(spark, fleet.route(F.lit("x"), ("vast",)))
    assert one(spark, numeric.resolved_activities(F.lit(numeric.ALL_ACTIVITIES), F.lit(5))) == 5
    with pytest.raises(PySparkException, match="unsupported"):
        one(spark, numeric.resolved_activities(F.lit(2), F.lit(5)))
    assert one(spark, numeric.device_busy(F.lit(None).cast("int"), F.lit(None).cast("double"))) is False
    assert one(spark, numeric.device_busy(F.lit(10), F.lit(90.1))) is True
    assert one(spark, config.resolved_plan(F.lit("base"), F.lit("none"))) == ""
    assert one(spark, config.resolved_plan(F.lit("base"), F.lit(""))) == "base"
    assert one(spark, text.looked_up(F.lit("Stopped"), {"stopped": "ok"})) == "ok" and one(spark, text.looked_up(F.lit("x"), {"stopped": "ok"})) == "unknown"
    rows = spark.createDataFrame([([], []), ([1], [])], "summaries array<int>, kernels array<int>")
    assert [r.failed for r in lab.has_failed(rows).collect()] == [True, False]


def test_sections(spark):
    gates = spark.createDataFrame([
        ("a", "r", False, 0, [], ""), ("b", "r", False, 1, ["x", "y"], ""), ("c", "r", False, 1, [], "z"), ("d", "", False, 2, [], "last"), ("e", "", True, 0, [], ""), ("f", "", False, 3, [], ""),
    ], "run string, report string, timed_out boolean, status int, breakages array<string>, last_line string")
    out = {r.run: (r.verdict, r.detail) for r in fleet.gate_section(gates).collect()}
    assert [out[k][0] for k in "abcdef"] == ["pass", "fail", "warn", "fail", "warn", "fail"]
    assert out["b"][1] == "2 breakages: x, y" and out["d"][1] == "last" and out["f"][1] == "`f` exited 3"
    paths = spark.createDataFrame([("l", "here"), ("r", "ready"), ("u", "unreachable"), ("k", "unkeyed")], "name string, access string")
    section = fleet.fleet_section(paths).first()
    assert (section.usable, section.unreachable, section.verdict) == (2, ["u"], "warn")
    assert one(spark, fleet.worst(F.array(F.lit("pass"), F.lit("fail"), F.lit("warn")))) == "fail"
    providers = spark.createDataFrame([("a", False, None, None), ("b", True, "down", None), ("c", True, None, True), ("d", True, None, False)], "name string, has_account boolean, fault string, keyed boolean")
    assert [r.access for r in fleet.provider_access(providers).orderBy("name").collect()] == ["unkeyed", "unreachable", "keyed", "unkeyed"]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    env = packages.environment_section(df([("a", "1"), ("b", "2"), ("c", "3")], "name string, digest string"), df([("a", False), ("b", True)], "name string, damaged boolean"), df([("a", "0"), ("b", "2")], "name string, digest string")).first()
    assert (env.stale, env.damaged, env.absent, env.verdict) == (["a"], ["b"], ["c"], "fail")


def test_queue_states(spark):
    handles = spark.createDataFrame([("1.srv",), ("2",), ("3",)], "handle string")
    records = spark.createDataFrame([("1", "R", None, 0), ("2.opbs", "F", 0, 1), ("2.opbs", "F", 2, 2)], "job_id string, state string, exit_status int, ordinal int")
    assert sorted((r.handle, r.verdict) for r in state.queue_states(handles, records).collect()) == [("1.srv", "running"), ("2", "failed")]
    rentals = spark.createDataFrame([("a", "exited", "exit=0\n"), ("b", "exited", "no"), ("c", "running", "")], "handle string, status string, log string")
    asked = spark.createDataFrame([(h,) for h in "abcd"], "handle string")
    assert [r.verdict for r in fleet.fleet_states(asked, rentals).orderBy("handle").collect()] == ["ok", "unknown", "running", "vanished"]


def test_layer_order(spark):
    scopes = spark.createDataFrame([("base", None, None, 0), ("base", None, "linux", 1), ("dev", None, None, 2), ("env", "gpu", None, 3), ("env", "gpu", "linux", 4), ("env", "x", None, 5)], "kind string, name string, platform string, ordinal int")
    of = lambda *a: [r.ordinal for r in config.layer_order(scopes, *a).orderBy("layer").collect()]
    assert of("default") == [0, 1, 2] and of("gpu") == [0, 1, 3, 4] and of("gpu", True) == [3, 4]


def test_filled_and_expanded(spark):
    profiles = spark.createDataFrame([("a", "auto", "", "mine"), ("b", "pbs", "/r", "")], "name string, kind string, root string, account string")
    facts = spark.createDataFrame([("a", "slurm", "/w", "acc"), ("b", "slurm", "/w", "acc")], "name string, kind string, root string, account string")
    assert sorted(map(tuple, config.filled(profiles, facts).collect())) == [("a", "slurm", "/w", "mine"), ("b", "pbs", "/r", "acc")]
    platforms = spark.createDataFrame([("linux-64",), ("osx-arm64",)], "name string")
    envs = spark.createDataFrame([("all", None), ("gpu", ["linux-64"])], "name string, platforms array<string>")
    assert sorted(map(tuple, config.expanded(platforms, envs).collect())) == [("linux-64", "all"), ("linux-64", "gpu"), ("osx-arm64", "all")]
    deps = spark.createDataFrame([("a", "../x", 0), ("a", "../y", 1), ("b", None, 0)], "name string, source_path string, layer int")
    assert [tuple(r) for r in config.local_paths(deps).collect()] == [("a", "../y")]


def test_budgets(spark):
    envs = spark.createDataFrame([("a", False, 10.0, 1.0, 0), ("b", True, 5.0, 2.0, 1), ("c", True, None, 2.0, 2)], "name string, is_default boolean, budget_usd double, usage_usd double, ordinal int")
    assert tuple(costs.budgeted(envs).first()) == ("b", 3.0)
    assert costs.budgeted(envs.where("budget_usd IS NULL")).count() == 0
    usd = lambda *v: spark.createDataFrame([(x,) for x in v], "usd double")
    assert costs.standing(usd(5.0), usd(1.0, 2.0)).first().remaining_usd == 2.0
    assert costs.standing(usd(), usd(1.0)).first().note == "no declared credit"


def test_devices_and_files(spark):
    devices = spark.createDataFrame([("h", 8, 10), ("h", 9, 0)], "host string, major int, minor int")
    top = fleet.best_capability(devices).first()
    assert (top.major, top.family, top.target) == (9, "Hopper", "sm_90")
    tree = spark.createDataFrame([("t", "a.rs", 5), ("t", "b.txt", 9)], "tree string, path string, mtime long")
    assert packages.newest(tree, ["tree"], r"\.rs$").first().newest == 5
    import hashlib

    files_in = spark.createDataFrame([("b", None), ("a", bytearray(b"xy"))], "path string, content binary")
    digest = packages.resolution_digest(spark.createDataFrame([("{}",)], "value string"), files_in).first()[0]
    assert digest == hashlib.sha256(b"{}xy\x00").hexdigest()
    assert [r[0] for r in packages.names(spark.createDataFrame([("b",), ("A",), ("b",)], "name string")).collect()] == ["A", "b"]
    assert [r.value for r in packages.sync_state(spark.createDataFrame([("b", "2"), ("a", "1")], "name string, digest string")).collect()] == ["a 1", "b 2"]


def test_flags(spark):
    job = spark.createDataFrame([(2, "01:00:00", "q", "", 8, 1, "job.sh"), (0, None, None, None, None, 1, "job.sh")], "gpus int, walltime string, queue string, account string, mem_gb int, nodes int, script string")
    assert [r[0] for r in job.select(fleet.submit_flags("slurm")).collect()] == [["sbatch", "--output=logs/%j.log", "--gpus=2", "--time=01:00:00", "--partition=q", "--mem=8G", "job.sh"], ["sbatch", "--output=logs/%j.log", "job.sh"]]
    assert [r[0] for r in job.select(fleet.submit_flags("pbs")).collect()] == [["-q", "q", "-l", "walltime=01:00:00", "-l", "select=1:mem=8gb"], []]


def test_receipts(spark):
    gates = spark.createDataFrame([("r", 0, True, None, "busy"), ("r", 1, False, None, "busy"), ("r", 2, True, "boom", "x")], "run_id string, ordinal int, passed boolean, error string, blocked string")
    checked = lab.gate_status(gates)
    outcome = lab.trial_outcomes(checked, ["run_id"])
    assert (outcome.first().outcome, outcome.first().reason) == ("blocked", "busy")
    line = json.loads(lab.receipts(outcome, checked).first().line)["receipt"]
    assert line["outcome"] == "blocked" and [g["status"] for g in line["gates"]] == ["passed", "blocked", "failed"]


def test_market_rows(spark):
    rows = spark.createDataFrame([("A", 2, None, 0.5, 1.5, True)], "gpu_name string, num_gpus int, geolocation string, min_bid double, dph_total double, rentable boolean")
    assert market.from_market(rows, spot=True).first().rate_usd_hr == 0.5 and market.from_market(rows).first().rate_usd_hr == 1.5


def test_records(spark):
    blob = spark.createDataFrame([(0, '"a,b.so",x,1\nc.py,y,2\nd.pyd,,\n')], "id int, value string")
    assert [r.path for r in parsers.record_artifacts(blob).orderBy("line").collect()] == ["a,b.so", "d.pyd"]
    assert parsers.exit_markers(blob.withColumn("value", F.lit("exit=2"))).first().exit_code == 2
    assert parsers.breakages(blob.withColumn("value", F.lit('{"a": ["x"]}')), "a").first().breakages == ["x"]
