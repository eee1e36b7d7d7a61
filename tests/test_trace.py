"""Literal cases of trace analytics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import render, trace
from quillon.plans import queries

SPAN = "track string, name string, start long, end long"


def spans(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], SPAN)


def line(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("k", 0, 1000)], (1000, 1000, 0, 1, 0)),
        ([("long", 0, 1000), ("nested", 100, 200)], (1000, 1000, 0, 2, 0)),
        ([("k", 0, 1000), ("copy", 500, 1500)], (1500, 1500, 0, 2, 0)),
        ([("a", 0, 100), ("b", 105, 200)], (200, 195, 5, 2, 0)),
        ([("a", 0, 100), ("b", 200, 300)], (300, 200, 100, 2, 1)),
        ([("a", 0, 100), ("b", 100, 200)], (200, 200, 0, 2, 0)),
    ],
)
def test_interval_union(spark, rows, expected):
    out = line(trace.timeline(spans(spark, *rows), ["track"], min_gap=10))
    assert (out.span, out.busy, out.idle, out.activities, out.gaps) == expected


def test_no_intervals(spark):
    assert trace.timeline(spans(spark, ("noop", 100, 100)), ["track"]).count() == 0


def test_gaps_are_ranked(spark):
    rows = spans(spark, ("a", 0, 100), ("b", 1100, 1200), ("c", 1300, 1400), ("d", 3400, 3500))
    top = trace.top_gaps(rows, ["track"], top=2, min_gap=50).orderBy("rank").collect()
    assert [(r.gap_length, r.before, r.after) for r in top] == [(2000, "c", "d"), (1000, "a", "b")]


def test_union_against_a_sweep(spark):
    draw = random.Random(5)
    rows = [(f"n{i}", s, s + draw.randrange(1, 40)) for i in range(400) for s in [draw.randrange(4000)]]
    busy = set()
    for _, s, e in rows:
        busy.update(range(s, e))
    plain = spans(spark, *rows)
    out = line(trace.timeline(plain, ["track"], 1))
    assert out.busy == len(busy)
    for width in (1, 7, 100, 10_000):
        assert line(trace.timeline(plain, ["track"], 1, width=width)) == out
        assert sorted(trace.gaps(plain, ["track"], 1, width=width).collect()) == sorted(trace.gaps(plain, ["track"], 1).collect())
    merged = trace.runs(plain, ["track"]).groupBy("run").agg({"start": "min", "end": "max"}).collect()
    assert sum(r["max(end)"] - r["min(start)"] for r in merged) == len(busy)


def kernels(spark, *rows):
    schema = "name string, start_ns long, end_ns long, grid string, block string, registers int, ordinal int"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_regions_and_ranking(spark):
    windows = spark.createDataFrame([("encode", 0, 1000, 2_000_000, 0), ("decode", 1000, 2000, 1_000_000, 1)], "name string, start long, end long, wall long, ordinal int")
    k = kernels(spark, ("gemm", 0, 600, "", "", 0), ("gemm", 1000, 1400, "", "", 0), ("relu", 600, 700, "", "", 0))
    points = k.withColumnsRenamed({"start_ns": "start", "end_ns": "end"})
    for width in (None, 700):
        out = trace.hot_regions(points, windows, [], width=width).collect()
        assert [(r.region, r.total, r.calls, r.wall) for r in out] == [("encode", 700, 2, 2_000_000), ("decode", 400, 1, 1_000_000)]
    hot = trace.hot_kernels(k).collect()
    assert [(r.name, r.calls, r.total_ns) for r in hot] == [("gemm", 2, 1000), ("relu", 1, 100)]
    assert hot[0].share_pct == pytest.approx(90.90909090909)
    copies = spark.createDataFrame([("HtoD", 0, 100, 4096)], "kind string, start_ns long, end_ns long, bytes_moved long")
    split = line(trace.time_split(k, copies))
    assert (split.kernel_ns, split.copy_ns, split.bound) == (1100, 100, "compute")
    assert split.compute_pct == pytest.approx(91.6666666)


def test_innermost_window(spark):
    windows = spark.createDataFrame([("inner", 100, 300, 1), ("outer", 0, 1000, 0), ("twin", 100, 300, 2)], "name string, start long, end long, ordinal int")
    points = spark.createDataFrame([(150, 0), (300, 1), (2000, 2)], "start long, ordinal int")
    for width in (None, 64):
        out = {r.start: r.region for r in trace.innermost(points, windows, [], width=width).collect()}
        assert out == {150: "inner", 300: "outer", 2000: trace.OUTSIDE}


def test_span_paths(spark):
    rows = [("t", "day", 0, 240, 0), ("t", "hour", 0, 10, 1), ("t", "hour", 10, 20, 2), ("t", "mark", 20, 20, 3), ("t", "twin", 0, 10, 4), ("u", "day", 0, 64, 5), ("u", "mark", 64, 64, 6)]
    spans = spark.createDataFrame(rows, "track string, name string, start long, end long, ordinal int")
    want = {0: "day", 1: "day.hour", 2: "day.hour", 3: "day.hour.mark", 4: "day.hour.twin", 5: "day", 6: "day.mark"}
    for width in (None, 1, 10, 64, 1000):
        assert {r.ordinal: r.path for r in trace.span_paths(spans, ["track"], width=width).collect()} == want


def nested(draw, low, high, depth=0):
    """Spans that nest: (start, end, depth)."""
    out = [(low, high, depth)]
    at = low
    while depth < 6 and high - at > 4 and draw.random() < 0.8:
        begin = draw.randrange(at, high)
        end = draw.randrange(begin + 1, high + 1)
        out += nested(draw, begin, end, depth + 1)
        at = end
    return out


@pytest.mark.parametrize("width", [None, 7, 100])
def test_span_paths_by_brute_force(spark, width):
    draw = random.Random(3)
    rows, want = [], {}
    for track in range(4):
        for base in (0, 1000):
            for low, high, depth in nested(draw, base, base + 500):
                rows.append((track, f"n{depth}", low, high, len(rows)))
    for t, name, low, high, n in rows:
        holds = [r for r in rows if r[0] == t and r[2] <= low and r[3] >= high and (r[2] < low or r[3] > high or r[4] <= n)]
        holds.sort(key=lambda r: (r[2] - r[3], r[4]))
        want[n] = (".".join(r[1] for r in holds), len(holds), holds[-2][4] if len(holds) > 1 else None)
    spans = spark.createDataFrame(rows, "track int, name string, start long, end long, ordinal long").repartition(5)
    paths = {r.ordinal: r.path for r in trace.span_paths(spans, ["track"], width).collect()}
    found = {r.ordinal: (paths[r.ordinal], r.depth, r.parent) for r in trace.span_parents(spans, ["track"], width).collect()}
    assert found == want


def test_a_deep_chain_of_spans(spark):
    """Each of 100 000 spans holds the next; slices of 10 000 hand on what is open."""
    n = 100_000
    spans = spark.range(n).select(F.lit("s").alias("name"), F.col("id").alias("start"), (F.lit(2 * n) - F.col("id")).alias("end"), F.col("id").alias("ordinal"))
    out = trace.span_parents(spans, [], width=10_000)
    assert out.where("depth <> ordinal + 1 or coalesce(parent, -1) <> ordinal - 1").count() == 0 and out.count() == n


@pytest.mark.parametrize("width", [None, 1, 16, 1000])
def test_innermost_by_brute_force(spark, width):
    draw = random.Random(9)
    windows = [(t, f"w{n}", a, a + draw.choice([0, 1, 5, 40, 300, 5000]), n) for n in range(150) for t, a in [(draw.randrange(3), draw.randrange(-2000, 4000))]]
    points = [(draw.randrange(3), draw.randrange(-2500, 9000), n) for n in range(400)]
    want = {}
    for t, at, n in points:
        holds = [(e - s, o, name) for u, name, s, e, o in windows if u == t and s <= at < e]
        want[n] = min(holds)[2] if holds else trace.OUTSIDE
    w = spark.createDataFrame(windows, "track int, name string, start long, end long, ordinal int")
    p = spark.createDataFrame(points, "track int, start long, ordinal int")
    assert {r.ordinal: r.region for r in trace.innermost(p, w, ["track"], width=width).collect()} == want


def test_windows_are_laid_into_few_intervals(spark):
    """The intervals of a window cover it once, and are no more than two for each bit of its length."""
    draw = random.Random(2)
    pairs = [(a, a + draw.randrange(0, 2**draw.randrange(1, 40))) for a in (draw.randrange(-(2**40), 2**40) for _ in range(200))]
    rows = spark.createDataFrame(pairs, "low long, high long")
    for r in rows.select("low", "high", trace.covering(F.col("low"), F.col("high")).alias("n")).collect():
        parts = sorted((x.number << x.level, (x.number + 1) << x.level) for x in r.n)
        assert len(parts) <= 2 * (r.high - r.low).bit_length()
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert (parts[0][0], parts[-1][1]) == (r.low, r.high) if r.high > r.low else not parts


def test_efficiency(spark):
    k = kernels(spark, ("gemm", 0, 100, "3x1x1", "256x1x1", 32), ("gemm", 100, 200, "3x1x1", "256x1x1", 32), ("relu", 200, 700, "4x1x1", "1x1x1", 8), ("stalled", 5, 5, "1x1x1", "1x1x1", 1))
    out = trace.kernel_efficiency(k, 2).collect()
    assert [(r.name, r.calls, r.waves, r.tail_waste_pct) for r in out] == [("relu", 1, 2.0, 0.0), ("gemm", 2, 1.5, 25.0)]
    report = line(trace.efficiency_report(k, 2, 2.0, 10**9, top=1))
    assert report.total_ms == pytest.approx(0.0005)


def test_diff(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "name string, wall_ms double")
    out = trace.profile_diff(side(("r", 2.0)), side(("r", 1.0), ("new", 5.0))).collect()
    assert [(r.name, r.delta_ms, r.speedup) for r in out] == [("new", 5.0, 0.0), ("r", -1.0, 2.0)]


def test_region_stats(spark):
    schema = "name string, wall_ms double, peak_memory_bytes long, avg_util_pct double, avg_power_w double, ordinal int"
    out = line(trace.region_stats(spark.createDataFrame([("r", 1.0, 5, 1.0, 1.0, 0), ("r", 3.0, 2, 9.0, 0.0, 1)], schema)))
    assert (out.calls, out.total_ms, out.mean_ms, out.peak_memory_bytes, out.peak_util_pct) == (2, 4.0, 2.0, 5, 9.0)


@pytest.mark.parametrize(
    ("values", "verdict"),
    [((1000, 100, 0, 0), "compute"), ((100, 1000, 0, 0), "memory"), ((0, 0, 80, 5), "memory"), ((0, 0, 3, 90), "compute"), ((0, 0, 0, 0), "unknown")],
)
def test_bound(spark, values, verdict):
    from pyspark.sql import functions as F

    columns = [F.lit(v) for v in values]
    assert spark.range(1).select(trace.bound(*columns)).first()[0] == verdict


def test_sample_belongs_to_every_open_span(spark):
    samples = spark.createDataFrame([(5,), (15,)], "at long")
    open_spans = spark.createDataFrame([("outer", 0, 20), ("inner", 0, 10)], "name string, start long, end long")
    out = sorted((r.at, r.span) for r in trace.samples_in_spans(samples, open_spans, [], width=8).collect())
    assert out == [(5, "inner"), (5, "outer"), (15, "outer")]


def test_trace_lines(spark):
    k = kernels(spark, ("gemm", 1000, 3000, "1x1x1", "1x1x1", 4))
    none = k.where("false")
    copies = none.selectExpr("name AS kind", "start_ns", "end_ns", "0L AS bytes_moved")
    activities = none.selectExpr("name", "name AS kind", "start_ns", "end_ns", "0L AS correlation_id")
    events = render.trace_events(none, k, copies, activities)
    row = line(events)
    assert (row.ts, row.dur, row.tid) == (0.0, 2.0, render.KERNELS)
    assert render.trace_lines(events).count() == 6
