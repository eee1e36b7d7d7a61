"""Literal cases of run and study state, frames, costs, configuration, packages and trials."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import config, costs, fleet, frames, lab, packages, render, state
from quillon.operators.runs import runs_of

RUN = "target string, handle string, submitted_at string, name string, state string, exit_code int, verdict string, reported string"
EVENT = "study_id string, kind string, handle string, state string, name string, at string, ordinal int"


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), RUN)


def test_merge_of_ledger_and_runs(spark):
    events = spark.createDataFrame([
        ("a", "submitted", "1", None, None, "t1", 0), ("b", "submitted", "2", None, None, "t1", 0), ("c", "submitted", "3", None, None, "t1", 0), ("c", "verdict", "3", "ok", None, "t2", 1),
        ("d", "created", None, None, "name", "t0", 0), ("d", "verdict", "5", None, None, "t3", 1),
    ], EVENT)
    r = runs(
        spark, ("h", "2", "1", "study:b/trial", None, 1, "failed", None), ("h", "3", "1", "study:c", None, None, None, None), ("h", "4", "1", "study:d", None, None, None, None),
        ("h", "9", "1", "study:other", None, None, "ok", None), ("h", "8", "1", "", None, None, "ok", None),
    )
    out = {p.study_id: (p.submitted, p.ok, p.failed, p.running) for p in state.progress(state.merged_states(r, events), ["study_id"]).collect()}
    assert out == {"a": (1, 0, 0, 1), "b": (1, 0, 1, 0), "c": (1, 1, 0, 0), "d": (1, 0, 0, 1), "other": (1, 1, 0, 0)}
    names = {(s.study_id, s.name, s.oldest_at, s.newest_at) for s in state.study_summaries(events).collect()}
    assert ("d", "name", "t0", "t3") in names and ("a", None, "t1", "t1") in names


def test_oldest_verdict_wins(spark):
    r = runs(spark, ("h", "1", "1", "study:a", None, None, "failed", None), ("h", "1", "2", "study:a", None, None, "ok", None), ("h", "1", "0", "study:a", None, None, None, None))
    none = spark.createDataFrame([], EVENT)
    assert [s.state for s in state.merged_states(r, none).collect()] == ["failed"]


def test_tracked(spark):
    r = runs(spark, *[("h", str(i), "1", "", None, None, v, p) for i, (v, p) in enumerate([(None, None), ("running", None), ("ok", None), ("ok", "ok"), ("failed", "ok")])])
    assert sorted(x.handle for x in state.tracked(r).collect()) == ["0", "1", "2", "4"]


def test_registry_keeps_one_row_and_both_writes(spark):
    base = runs(spark, ("h", "1", "t", "", None, None, None, None))
    again = state.upsert(base, base.withColumn("arrival", F.lit(1)), state.RUN_KEY)
    done = state.resolved(again, again.select(*state.RUN_KEY, F.lit("F").alias("state"), F.lit(0).alias("exit_code"), F.lit("ok").alias("verdict")))
    told = state.reported(done, done.select(*state.RUN_KEY, "verdict")).collect()
    assert len(told) == 1 and (told[0].verdict, told[0].reported, told[0].exit_code) == ("ok", "ok", 0)


def test_several_targets_are_an_error(spark):
    r = runs(spark, ("a", "1", "1", "", None, None, None, None), ("b", "1", "2", "", None, None, None, None))
    assert state.run_of(r, "1", "a").first().submitted_at == "1"
    with pytest.raises(PySparkException, match="several targets"):
        state.run_of(r, "1").collect()


def test_violations(spark):
    rows = [("j", i, v) for i, v in enumerate(["running", "ok", "ok", "running", "unknown"])] + [("k", 0, "queued"), ("k", 1, "ok")]
    out = state.violations(spark.createDataFrame(rows, "job string, ordinal int, verdict string"), ["job"]).collect()
    assert sorted((r.job, r.before, r.verdict) for r in out) == [("j", "ok", "running"), ("j", "running", "unknown")]


def test_sweep(spark):
    r = runs(spark, ("up", "1", "1", "", None, None, None, None), ("up", "2", "1", "", None, 137, "failed", None), ("down", "3", "1", "", None, None, None, None), ("up", "4", "1", "", None, None, None, None))
    probes = spark.createDataFrame([("up", "1", "running", None, "running", None), ("up", "2", "F", 0, "ok", None), ("down", "3", None, None, None, "no route"), ("up", "4", "F", 0, "ok", None)], "target string, handle string, state string, exit_code int, verdict string, fault string")
    out = {x.handle: (x.outcome, x.verdict) for x in state.sweep(r, probes).collect()}
    assert out == {"1": ("running", "running"), "2": ("failed", "failed"), "3": ("unreachable", None), "4": ("finished", "ok")}
    assert state.changes(state.sweep(r, probes)).count() == 3


FRAME = "job string, kind string, offset long, at timestamp, payload string, arrival long"


def frame_rows(spark, *rows):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("j", k, o, at + dt.timedelta(seconds=i), p, i) for i, (k, o, p) in enumerate(rows)], FRAME)


def test_ingest_is_idempotent(spark):
    rows = frame_rows(spark, ("line", 10, "{}"), ("line", 0, "{}"), ("line", 10, '{"x":1}'))
    first = frames.first_writes(rows)
    assert sorted((r.offset, r.payload) for r in first.collect()) == [(0, "{}"), (10, "{}")]
    assert frames.first_writes(rows, first).count() == 0
    assert [r.offset for r in frames.tail(first, "j", 0).collect()] == [10]


def test_projection_and_replay(spark):
    rows = frame_rows(spark, ("started", 0, "{}"), ("sample", 5, '{"rss": 4096}'), ("ended", 9, '{"exit_code": 3}'), ("started", 0, "{}"))
    job = frames.project(frames.first_writes(rows)).first()
    assert (job.state, job.exit_code) == ("ended", 3)
    assert frames.project(rows).first().state == "running"
    assert [r.rss for r in frames.samples(rows).collect()] == [4096]


def test_torn_tail(spark):
    good = '{"job":"j","kind":"line","offset":0,"at":"2024-01-01T00:00:00Z"}'
    lines = lambda *rows: spark.createDataFrame(list(rows), "value string, unterminated boolean")
    assert frames.decode(lines((good, False), ("", False), ('{"job":', True))).count() == 1
    assert frames.decode(lines(('{"job":', True))).count() == 0
    with pytest.raises(PySparkException):
        frames.decode(lines(('{"job":', False), (good, False))).collect()


def test_fits_and_quotes(spark):
    obs = lambda *rows: spark.createDataFrame([(p, g, "", 100.0, 100.0 + s, 200.0, 0.0) for p, g, s in rows], "provider string, gpu string, region string, t_submit double, t_running double, t_ended double, billed_usd double")
    assert costs.setup_fits(obs(("a", "x", 4.0), ("a", "x", 6.0))).count() == 0
    fit = costs.setup_fits(obs(("a", "x", 5.0), ("a", "x", 8.0), ("a", "x", 30.0))).first()
    assert (fit.samples, fit.p50_s) == (3, 8.0) and fit.mean_s == pytest.approx(43 / 3) and fit.p90_s == pytest.approx(25.6)
    offers = spark.createDataFrame([("a", "GB200", 11.0, 1, 0, 0.0, 0), ("b", "GB200", 7.5, 60, 60, 0.0, 1)], "provider string, gpu string, rate_usd_hr double, granularity_s int, minimum_s int, fees_usd double, ordinal int")
    out = costs.quotes(offers, obs(*[("a", "GB200", 2.0)] * 3), 30.0, "gb200").collect()
    assert [(r.provider, r.setup_samples) for r in out] == [("a", 3), ("b", 0)]
    assert out[0].expected_usd == pytest.approx(11.0 * 32 / 3600) and out[1].p90_usd == pytest.approx(7.5 * 360 / 3600)
    assert costs.quotes(offers, None, 30.0).count() == 2
    with pytest.raises(PySparkException, match="no offer"):
        costs.pick(offers.where("false").withColumn("reliability", F.lit(1.0))).collect()


def test_layers(spark):
    rows = [(0, "torch", "version", ">=2"), (1, "torch", "version", "*"), (0, "numpy", "version", "1"), (2, "numpy", "version", "2")]
    out = {r.path: r.value for r in config.merged_layers(spark.createDataFrame(rows, "layer int, path string, kind string, value string")).collect()}
    assert out == {"torch": ">=2", "numpy": "2"}


def test_selectors_and_ancestors(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(config.selectors(F.lit("linux-64"))) == ["linux-64", "linux", "unix"]
    assert one(config.selectors(F.lit("linux"))) == ["linux", "unix"]
    assert one(config.selectors(F.lit("win-64"))) == ["win-64", "win"]
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d.py",)], "path string")
    assert sorted(r.file for r in config.ancestors(paths, ".ignore").collect()) == [".ignore", "a/.ignore", "a/b/.ignore"]


def test_lanes(spark):
    out = lab.block_orders(spark.range(6).withColumnRenamed("id", "block"), ["a", "b", "c"]).orderBy("block").collect()
    assert [tuple(r.lanes) for r in out] == list(itertools.permutations(["a", "b", "c"]))
    assert [tuple(r.lanes) for r in lab.block_orders(spark.range(3).withColumnRenamed("id", "block"), ["cold", "warm"]).orderBy("block").collect()] == [("cold", "warm"), ("warm", "cold"), ("cold", "warm")]
    counts = spark.createDataFrame([(4,), (3,)], "n int").select(lab.balanced(F.col("n"), ["a", "b"]).alias("two"), lab.balanced(F.col("n"), []).alias("none")).collect()
    assert [(r.two, r.none) for r in counts] == [(True, True), (False, True)]


def test_guarded_runs(spark):
    def work(row):
        return 10 / row["id"]

    out = {r.id: (r.value, r.error) for r in lab.guarded_runs(spark.range(3), work).collect()}
    assert out[2] == (5.0, None) and out[0][0] is None and "ZeroDivisionError" in out[0][1]


def test_quantiles_in_rounds(spark, monkeypatch):
    """Quantiles of keys that no buffer may hold, with ties, one value, wide ranges and a null key."""
    import numpy as np

    draw = np.random.RandomState(1)
    values = {"hot": draw.lognormal(3, 4, 3000), "ties": draw.randint(1, 4, 500).astype(float), "one": np.full(50, 7.5), "wide": np.array([1e-300, 1.0, 1e300, 5.0, 1e299]), None: draw.normal(size=101)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double").repartition(6)
    for held, bins in ((10**6, 1024), (10, 1024), (10, 3)):
        monkeypatch.setattr(costs, "HELD", held)
        monkeypatch.setattr(costs, "BINS", bins)
        got = {r.k: (r.samples, r.q0, r.q1, r.q2) for r in costs.quantiles(rows, ["k"], "v", (0.5, 0.9, 1.0)).collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            assert got[k][0] == len(vs) and got[k][1:] == pytest.approx(tuple(np.quantile(vs, [0.5, 0.9, 1.0])), rel=1e-9), (k, held, bins)


def test_throttled(spark):
    rows = spark.createDataFrame([("j", 0.0, float(t)) for t in (1, 4, 5, 6, 10, 11)], "job string, started double, at double")
    assert [r.at for r in lab.throttled(rows, "job", 5.0).orderBy("at").collect()] == [5.0, 10.0]


def test_throttled_jobs_of_many_batches(spark):
    n = 25_000  # of one job; batches have 1000 rows here
    rows = spark.range(n).select(F.lit("hot").alias("job"), F.lit(0.0).alias("started"), (F.col("id") * 1.0).alias("at"), "id")
    few = spark.createDataFrame([("a", 5.0, 6.0, 1), ("a", 5.0, None, 2), ("a", 5.0, 15.0, 4), ("a", 5.0, 15.0, 3), (None, 0.0, 12.0, 5), ("b", None, 99.0, 6)], "job string, started double, at double, id long")
    out = lab.throttled(rows.unionByName(few).repartition(7), "job", 10.0)
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # no job is one frame
    got = sorted(((r.job or "", r.id) for r in out.collect()))
    assert got == [("", 5), ("a", 3), *(("hot", i) for i in range(10, n, 10))]


@pytest.mark.parametrize(("interval", "fan"), [(1.0, 2), (0.1, 3), (7.0, 4)])
def test_throttled_by_brute_force(spark, monkeypatch, interval, fan):
    """Chains of samples over gaps, ties and rounded times, composed of small stretches."""
    monkeypatch.setattr(lab, "FAN", fan)
    draw = random.Random(fan)
    rows, want = [], []
    for job in range(6):
        at = started = draw.choice([0.0, 3.3, -5.0])
        last, own = started, []
        for n in range(draw.choice([1, 30, 300])):
            at = round(at + draw.choice([0.0, 0.1, 0.1, 0.3, 1.0, 2.5, 40.0 if n % 50 == 7 else 0.2]), 1)
            own.append((f"j{job}", started, at, n))
        for r in own:
            if r[2] - last >= interval:
                want.append(r)
                last = r[2]
        rows += own
    lines = spark.createDataFrame(rows, "job string, started double, at double, id long").repartition(5)
    assert sorted(map(tuple, lab.throttled(lines, "job", interval).collect())) == sorted(want)


def test_one_job_falls_into_many_runs(spark, monkeypatch):
    """What a task holds at once is a stretch of a job, never the job."""
    monkeypatch.setattr(lab, "FAN", 4)
    lines = spark.range(20_000).select(F.lit("hot").alias("job"), F.lit(0.0).alias("started"), (F.col("id") / 10).alias("at"))
    assert lab.throttled(lines, "job", 1.0).count() == 1999
    stretches = lines.withColumn("group", F.floor(F.col("at") / 4)).sort("group", "at").toArrow().to_batches(max_chunksize=7)
    assert {t.num_rows for _, t in runs_of(iter(stretches), ["job", "group"])} == {40}


CELLS = ["plain", "tab\there", "line\nend", '"quoted"', "", None, "é ünï", '{"a": "b"}']


def test_tab_separated_round_trip(spark):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(CELLS)], "k string, v string")
    back = render.decode(render.encode(df), render.header(df))
    assert {r.k: r.v for r in back.collect()} == {str(i): c or "" for i, c in enumerate(CELLS)}
    with pytest.raises(PySparkException, match="number of cells"):
        render.decode(spark.createDataFrame([("a\tb\tc",)], "value string"), "k\tv").collect()


def test_pairs_and_flat(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('a', 1) AS s, array(1, 2) AS l, 'x' AS t")
    assert render.flat(df).first().asDict() == {"k": 1, "s": '{"a":1}', "l": "[1,2]", "t": "x"}
    assert [(r.field, r.value) for r in render.pairs(df, ["k"], ["t", "none"]).collect()] == [("t", "x")]


def test_hosts(spark):
    hosts = spark.createDataFrame([("big", 81920, None, 0), ("small", 24576, None, 1), ("cpu", None, 32, 2)], "name string, gpu_mem_mb int, sysmem_gb int, ordinal int")
    assert fleet.smallest_fit(hosts, 20).first().name == "small"
    with pytest.raises(PySparkException, match="no host"):
        fleet.smallest_fit(hosts, 1000).collect()
    records = spark.createDataFrame([("h", "0x41", "0xd4f", None, i) for i in range(3)] + [("h", "0x41", "0xd08", None, 3)], "hostname string, implementer string, part string, vendor_id string, ordinal int")
    assert fleet.core_mix(records).first().cores == "3x Arm Neoverse-V2 + Arm Cortex-A72"
    assert fleet.vendor(records).first().vendor == "arm"


def test_packages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(packages.module_reference(F.lit("m"), F.lit("1.2.3"))) == "m@v1.2.3"
    assert one(packages.module_reference(F.lit("m"), F.lit("*"))) == "m@latest"
    with pytest.raises(PySparkException):
        one(packages.module_reference(F.lit("m"), F.lit(">=1")))
    assert [one(packages.shifted_path(F.lit(p))) for p in ("a/b", "", "/x")] == ["../a/b", "..", "/x"]


def test_offers_without_names_take_the_fit_over_all(spark):
    obs = spark.createDataFrame([("a", "x", "", 0.0, s, 0.0, 0.0) for s in (1.0, 2.0, 3.0)], "provider string, gpu string, region string, t_submit double, t_running double, t_ended double, billed_usd double")
    obs = obs.withColumn("t_submit", F.lit(100.0)).withColumn("t_running", F.col("t_running") + 100)
    rows = [("a", "x", 0), ("a", "", 1), ("", "x", 2), ("", "", 3), ("b", "", 4)]
    offers = spark.createDataFrame([(p, g, 3600.0, 1, 0, 0.0, i) for p, g, i in rows], "provider string, gpu string, rate_usd_hr double, granularity_s int, minimum_s int, fees_usd double, ordinal int")
    out = {r.ordinal: (r.setup_samples, r.expected_usd) for r in costs.quotes(offers, obs, 10.0).collect()}
    assert out == {0: (3, 12.0), 1: (3, 12.0), 2: (3, 12.0), 3: (3, 12.0), 4: (0, 310.0)}


def test_unknown_names_are_errors(spark):
    table = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    profiles = table("name string, env string, container string, vars map<string,string>", ("h", "e", "c", {"a": "1"}))
    plans = lambda *asked: config.plans(table("host string, env string, container string", asked), profiles, table("name string", ("e",)), table("name string, image string", ("c", "i"))).collect()
    assert [(r.host, r.env, r.container, r.image, r.vars) for r in plans("h", "", "")] == [("h", "e", "c", "i", {"a": "1"})]
    assert [(r.container, r.image) for r in plans("h", "", "none")] == [(None, None)]
    for asked, word in ((("x", "", ""), "no host x"), (("h", "y", ""), "no environment y"), (("h", "", "z"), "no container z")):
        with pytest.raises(PySparkException, match=word):
            plans(*asked)
