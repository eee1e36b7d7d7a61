"""Trace analytics: interval union and gaps, range joins, kernel and region statistics, verdicts, comparisons.

Tables of intervals may have a `track` (a device, a host): every operator takes the columns that part its work in
`by`, so that tracks are worked on side by side. `ordinal` stands for the place in a list: what comes first or last,
and which of equals leads, is decided by it and never by the order in which rows happen to arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillon.functions import numeric
from quillon.operators.runs import groups_of

OUTSIDE = "(outside regions)"


def _long(x: Column) -> Column:
    return x.cast("long")


# Interval union ------------------------------------------------------------------------------------------------


def openings(spans: DataFrame, by: list[str], width: int | None = None, start: str = "start", end: str = "end", name: str = "name") -> DataFrame:
    """Each interval with opens (whether it begins a new run), and for those after a gap gap_ns and before.

    Intervals are taken in the order of (start, end, name). One opens a run if it starts after the furthest end so far;
    `before` is the name of the interval that reached that end first. Intervals without length are left out.

    With a width, tracks are cut into slices of time of that width: running ends are worked out inside slices, and one
    row a slice carries the furthest end on to the slices after it. Then no task sees a whole track, however long.
    """
    keys = [*by, "_slice"] if width else list(by)
    rows = spans.where(F.col(end) > F.col(start))
    rows = rows.withColumn("_slice", F.floor(F.col(start) / width).cast("long") if width else F.lit(0).cast("long"))
    order = Window.partitionBy(*keys).orderBy(start, end, name)
    rows = rows.withColumn("_n", F.row_number().over(order))
    # of equal ends the one in the earlier slice, and there the earlier row, was first
    reach = F.struct(F.col(end).alias("end"), (-F.col("_slice")).alias("s"), (-F.col("_n")).alias("n"), F.col(name).alias("name"))
    seen = rows.withColumn("_far", F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    if width:
        tops = rows.groupBy(*keys).agg(F.max(reach).alias("_top"))
        ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.max("_top").over(ahead).alias("_carry"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        seen = seen.join(carried, same, "left").drop(*[f"_k_{k}" for k in keys])
        seen = seen.withColumn("_far", F.greatest("_far", "_carry")).drop("_carry")
    opens = F.col("_far").isNull() | (F.col(start) > F.col("_far.end"))
    gap = F.when(opens & F.col("_far").isNotNull(), F.col(start) - F.col("_far.end"))
    seen = seen.withColumns({"opens": opens, "gap_ns": gap})
    return seen.withColumn("before", F.when(F.col("gap_ns").isNotNull(), F.col("_far.name"))).drop("_n", "_far", "_slice")


def runs(spans: DataFrame, by: list[str], start: str = "start", end: str = "end", name: str = "name", width: int | None = None) -> DataFrame:
    """openings() with the number of the merged run that each interval is in. With a width, runs are counted in slices of
    time, and one row a slice carries the count on to the slices after it."""
    opened = openings(spans, by, width, start, end, name)
    if not width:
        order = Window.partitionBy(*by).orderBy(start, end, name).rowsBetween(Window.unboundedPreceding, 0)
        return opened.withColumn("run", _long(F.sum(_long(F.col("opens"))).over(order)))
    opened = opened.withColumn("_slice", F.floor(F.col(start) / width).cast("long"))
    counts = opened.groupBy(*by, "_slice").agg(F.sum(_long(F.col("opens"))).alias("_c"))
    ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*by, "_slice", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_slice").orderBy(start, end, name).rowsBetween(Window.unboundedPreceding, 0)
    counted = opened.withColumn("_own", F.sum(_long(F.col("opens"))).over(inside)).join(carried, [*by, "_slice"])
    return counted.withColumn("run", _long(F.col("_own") + F.col("_ahead"))).drop("_slice", "_own", "_ahead").select(*spans.columns, "opens", "gap_ns", "before", "run")


def _with_share(per: DataFrame, amount: str) -> DataFrame:
    """Rows with share_pct: their part of the whole, which is one row that is worked out by parts and sent to all."""
    whole = per.agg(F.sum(amount).alias("_whole"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share_pct", numeric.share(F.col(amount), F.col("_whole"))).drop("_whole")  # one row


def timeline(spans: DataFrame, by: list[str], min_gap: int = 10_000, start: str = "start", end: str = "end", name: str = "name", width: int | None = None) -> DataFrame:
    """Per track: span, busy, idle, activities, gaps (of at least min_gap), gap_total, occupancy_pct.

    One shuffle by track, or with a width by slices of tracks (see openings()); nothing but counters leaves a slice.
    """
    merged = openings(spans, by, width, start, end, name)
    long_gap = F.col("gap_ns") >= min_gap
    out = merged.groupBy(*by).agg(
        _long(F.max(end) - F.min(start)).alias("span"), _long(F.coalesce(F.sum("gap_ns"), F.lit(0))).alias("_all_gaps"), _long(F.count("*")).alias("activities"),
        _long(F.count_if(long_gap)).alias("gaps"), _long(F.coalesce(F.sum(F.when(long_gap, F.col("gap_ns"))), F.lit(0))).alias("gap_total"),
    )
    out = out.withColumn("busy", F.col("span") - F.col("_all_gaps")).drop("_all_gaps")
    return out.withColumns({"idle": numeric.idle("span", "busy"), "occupancy_pct": numeric.occupancy("busy", "span")})


def gaps(spans: DataFrame, by: list[str], min_gap: int = 10_000, start: str = "start", end: str = "end", name: str = "name", width: int | None = None) -> DataFrame:
    """Every gap of at least min_gap: its start, end, length, and the names before and after it."""
    found = openings(spans, by, width, start, end, name).where(F.col("gap_ns") >= min_gap)
    return found.select(*by, (F.col(start) - F.col("gap_ns")).alias("gap_start"), F.col(start).alias("gap_end"), F.col("gap_ns").alias("gap_length"), "before", F.col(name).alias("after"))


def top_gaps(spans: DataFrame, by: list[str], top: int = 10, min_gap: int = 10_000, start: str = "start", end: str = "end", name: str = "name", width: int | None = None) -> DataFrame:
    """The longest gaps of each track, earlier ones first among equals, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("gap_length").desc(), "gap_start")
    ranked = gaps(spans, by, min_gap, start, end, name, width).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top)


# Range joins ---------------------------------------------------------------------------------------------------


def _buckets(low: Column, high: Column, width: int) -> Column:
    """Numbers of the buckets that [low, high) touches."""
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(F.greatest(high - 1, low) / width).cast("long")))


def covering(low: Column, high: Column) -> Column:
    """The dyadic intervals that make up the cells [low, high), as structs (level, number): number n of level k is the cells from
    n * 2^k up to (n + 1) * 2^k. At most two are of one level, so there are at most twice as many as the length has bits."""
    up = lambda k: -F.call_function("shiftright", -low, k)  # noqa: E731 - rounded up
    down = lambda k: F.call_function("shiftright", high, k)
    node = lambda k, number: F.struct(k.cast("int").alias("level"), number.alias("number"))
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    both = lambda k: F.array(F.when((up(k) < down(k)) & odd(up(k)), node(k, up(k))), F.when((up(k) < down(k)) & odd(down(k)), node(k, down(k) - 1)))
    bits = F.ceil(F.log2(F.greatest(high - low, F.lit(1)).cast("double") + 1)).cast("int")
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), bits), both)), lambda n: n.isNotNull())


def innermost(points: DataFrame, windows: DataFrame, by: list[str], at: str = "start", width: int | None = None) -> DataFrame:
    """Each point with `region`: the name of the narrowest window [start, end) that holds it, the first listed of equals.

    Points outside of all windows get `(outside regions)`. Time is cut into cells of `width` (by default the unit of whole numbers). A
    window is laid into the dyadic intervals that make up the cells which it fills, a logarithm of its length, and of the windows of one interval
    only the best is kept; a point asks the intervals that its cell is in, one of each level that occurs. So each asks for one row, by equality.
    Cells that a window fills in part are met by cell, and compared. Points need a unique `ordinal`; points that share one have to be equal.
    """
    cell = width or 1
    place = lambda c: F.floor(F.col(c) / cell).cast("long")
    w = windows.where("end > start").select(
        *[F.col(c).alias(f"_w_{c}") for c in by], F.col("start").alias("_start"), F.col("end").alias("_end"),
        F.struct((F.col("end") - F.col("start")).alias("length"), "ordinal", "name").alias("_best"), (-F.floor(-F.col("start") / cell)).cast("long").alias("_low"), place("end").alias("_high"),
    )
    whole = w.where("_low < _high").select(*[f"_w_{c}" for c in by], "_best", F.explode(covering(F.col("_low"), F.col("_high"))).alias("_n"))
    whole = whole.groupBy(*[f"_w_{c}" for c in by], F.col("_n.level").alias("_level"), F.col("_n.number").alias("_number")).agg(F.min("_best").alias("_best"))
    levels = sorted(r["_level"] for r in whole.select("_level").distinct().collect())  # 64 at most
    p = points.select("ordinal", *by, F.col(at).alias("_at")).withColumn("_cell", place("_at"))
    same = lambda side: [side[c].eqNullSafe(F.col(f"_w_{c}")) for c in by]
    every = lambda conditions: reduce(lambda a, b: a & b, conditions)

    found = []
    if levels:
        asked = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.call_function("shiftright", F.col("_cell"), F.lit(k)).alias("number")) for k in levels)))
        q = p.withColumn("_q", asked)
        found.append(q.join(whole, every([*same(q), F.col("_q.level") == F.col("_level"), F.col("_q.number") == F.col("_number")])).select("ordinal", "_best"))
    if cell > 1 or not isinstance(windows.schema["start"].dataType, IntegralType):
        first, last = F.floor(F.col("_start") / cell).cast("long"), F.col("_high")
        ends = F.array_distinct(F.array(F.when(first < F.col("_low"), first), F.when((F.col("_end") > last * cell) & ((last >= F.col("_low")) | (last == first)), last)))
        part = w.select("*", F.explode(F.filter(ends, lambda c: c.isNotNull())).alias("_c"))
        found.append(p.join(part, every([*same(p), F.col("_cell") == F.col("_c"), F.col("_at") >= F.col("_start"), F.col("_at") < F.col("_end")])).select("ordinal", "_best"))
    if not found:
        return points.withColumn("region", F.lit(OUTSIDE))
    best = reduce(DataFrame.unionByName, found).groupBy(F.col("ordinal").alias("_o")).agg(F.min("_best").alias("_best"))
    met = points.join(best, points["ordinal"].eqNullSafe(F.col("_o")), "left")
    return met.select(*(points[c] for c in points.columns), F.coalesce("_best.name", F.lit(OUTSIDE)).alias("region"))


def samples_in_spans(samples: DataFrame, spans: DataFrame, by: list[str], at: str = "at", width: int | None = None) -> DataFrame:
    """Each sample once for every span [start, end) that is open when it is taken."""
    s = spans.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("name").alias("span"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    p = samples
    condition = (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end"))
    for c in by:
        condition = condition & (p[c] == F.col(f"_s_{c}"))
    if width:
        s = s.withColumn("_wb", _buckets(F.col("_start"), F.col("_end"), width))
        p = p.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
        condition = condition & (F.col("_bucket") == F.col("_wb"))
    return p.join(s, condition).select(*samples.columns, "span")


def _stacked(spans: DataFrame, by: list[str], width: int | None, with_path: bool) -> DataFrame:
    """_span (a row of spans), depth (1 for the outermost), parent (the ordinal of the span that holds it), path (null unless asked for).

    A slice of time works on a stack of open spans as a function does: it takes off what ends before its latest end, and puts on what it leaves
    open. Slices are folded to such functions side by side; one row for each open span goes on from slice to slice; and with what is open at its
    begin each slice is gone through once more. A span takes off those that end before it does.
    """
    sliced = spans.withColumn("_slice", F.floor(F.col("start") / width).cast("long") if width else F.lit(0).cast("long"))
    keys, carry = [*by, "_slice"], ["end", "name", "ordinal"]
    own = [*dict.fromkeys([*keys, "start", *carry])]
    typed = lambda names: sliced.select(*names).schema.simpleString()[len("struct<") : -1]
    in_order = ["start", F.col("end").desc(), "ordinal"]
    whole = lambda values: pa.array(values, pa.int64())

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups_of(batches, keys):
            ends = table.column("end").to_pylist()
            rows, latest, places = [], [], []
            for low, high in pairwise(bounds):
                stack: list[int] = []
                for i in range(low, high):
                    while stack and ends[stack[-1]] < ends[i]:
                        stack.pop()
                    stack.append(i)
                rows += stack
                latest += [max(range(low, high), key=ends.__getitem__)] * len(stack)
                places += range(len(stack))
            out = table.select([*keys, *carry]).take(whole(rows)).append_column("_latest", table.column("end").take(whole(latest)))
            yield from out.append_column("_pos", whole(places)).combine_chunks().to_batches()

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is open where a slice begins: the rows of the stack, with the slice that they are for."""
        track, held = None, None
        for table, bounds in groups_of(batches, keys):
            fresh = table.select([*by, *carry])
            before = held.num_rows if held is not None else 0
            pool = pa.concat_tables([held, fresh]) if before else fresh
            ends, latest, slices = pool.column("end").to_pylist(), table.column("_latest").to_pylist(), table.column("_slice").to_pylist()
            stack, rows, numbers, places = list(range(before)), [], [], []
            tracks = list(zip(*(table.column(c).take(whole(bounds[:-1])).to_pylist() for c in by), strict=True)) if by else [()] * (len(bounds) - 1)
            for (low, high), own in zip(pairwise(bounds), tracks, strict=True):
                if own != track:
                    track, stack = own, []
                rows += stack
                numbers += [slices[low]] * len(stack)
                places += range(len(stack))
                stack = [i for i in stack if ends[i] >= latest[low]] + list(range(before + low, before + high))
            held = pool.take(whole(stack))
            out = pool.take(whole(rows)).append_column("_slice", whole(numbers)).append_column("_pos", whole(places))
            yield from out.select([*keys, *carry, "_pos"]).combine_chunks().to_batches()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups_of(batches, keys):
            ends, names, known = (table.column(c).to_pylist() for c in ("end", "name", "_pos"))
            rows, depths, parents, paths = [], [], [], []
            for low, high in pairwise(bounds):
                stack: list[int] = []
                for i in range(low, high):
                    if known[i] is None:
                        while stack and ends[stack[-1]] < ends[i]:
                            stack.pop()
                        rows.append(i)
                        parents.append(stack[-1] if stack else None)
                        depths.append(len(stack) + 1)
                    stack.append(i)
                    if known[i] is None:
                        paths.append(".".join(names[k] for k in stack) if with_path else None)
            if rows:
                out = [table.column("_span").take(whole(rows)), whole(depths), table.column("ordinal").take(whole(parents)), pa.array(paths, pa.string())]
                yield from pa.table(out, names=["_span", "depth", "parent", "path"]).combine_chunks().to_batches()

    latest = typed(["end"]).replace("end", "_latest", 1)
    summed = sliced.select(*own).repartition(*keys).sortWithinPartitions(*keys, *in_order).mapInArrow(left_open, f"{typed([*keys, *carry])}, {latest}, _pos long")
    dealt = summed.repartition(*by) if by else summed.coalesce(1)
    held = dealt.sortWithinPartitions(*keys, "_pos").mapInArrow(carried, f"{typed([*keys, *carry])}, _pos long")
    held = held.withColumns({"start": F.lit(None).cast(spans.schema["start"].dataType), "_span": F.lit(None).cast(spans.schema)})
    every = sliced.select(*own, F.lit(None).cast("long").alias("_pos"), F.struct(*spans.columns).alias("_span")).unionByName(held)
    every = every.repartition(*keys).sortWithinPartitions(*keys, F.col("_pos").asc_nulls_last(), *in_order)
    parent = typed(["ordinal"]).replace("ordinal", "parent", 1)
    return every.mapInArrow(placed, f"_span {spans.schema.simpleString()}, depth long, {parent}, path string")


def span_parents(spans: DataFrame, by: list[str], width: int | None = None) -> DataFrame:
    """Each span with depth (1 for the outermost) and parent, the ordinal of the span that holds it (null for none); see span_paths()."""
    return _stacked(spans, by, width, False).select("_span.*", "depth", "parent")


def span_paths(spans: DataFrame, by: list[str], width: int | None = None) -> DataFrame:
    """Each span with `path`: the names of the spans that hold it, outermost first, and its own, joined by dots.

    Spans nest: of two of a track one holds the other, or they have no time in common; of equal spans the one with the smaller ordinal is
    outside. With a width, tracks are cut into slices of time (see _stacked()), so that no task sees a whole track. A span's end must not be before its start.
    """
    return _stacked(spans, by, width, True).select("_span.*", "path")


# Kernel statistics ---------------------------------------------------------------------------------------------


def hot_kernels(kernels: DataFrame, top: int | None = 10) -> DataFrame:
    """Per kernel name: calls, total_ns, mean_ns, share_pct of all kernel time; hottest first."""
    ns = F.col("end_ns") - F.col("start_ns")
    per = kernels.groupBy("name").agg(_long(F.count("*")).alias("calls"), _long(F.sum(ns)).alias("total_ns"), F.min("ordinal").alias("_first"))
    per = _with_share(per, "total_ns")
    per = per.withColumn("mean_ns", F.col("total_ns") / F.col("calls"))
    ranked = per.orderBy(F.col("total_ns").desc(), "_first")
    return (ranked.limit(top) if top else ranked).drop("_first")


def kernel_stats(kernels: DataFrame) -> DataFrame:
    """Per kernel name: calls, total_ns, mean_ns, share_pct, and the launch shape of its last call."""
    ns = F.col("end_ns") - F.col("start_ns")
    last = F.max_by(F.struct("grid", "block", "registers"), F.col("ordinal"))
    per = kernels.groupBy("name").agg(_long(F.count("*")).alias("calls"), _long(F.sum(ns)).alias("total_ns"), last.alias("_last"), F.min("ordinal").alias("_first"))
    per = _with_share(per, "total_ns")
    return per.orderBy(F.col("total_ns").desc(), "_first").select(
        "name", "calls", "total_ns", (F.col("total_ns") / F.col("calls")).alias("mean_ns"), "share_pct", F.col("_last.grid").alias("grid"), F.col("_last.block").alias("block"),
        F.col("_last.registers").alias("registers"), numeric.threads_per_block(F.col("_last.block")).alias("threads"), numeric.block_occupancy(F.col("_last.block")).alias("occupancy_pct"),
    )


def kernel_efficiency(kernels: DataFrame, multiprocessors: int, blocks_each: int = 1) -> DataFrame:
    """Per kernel name, calls without length left out: calls, total_ms, blocks (most), threads and registers (first call),
    waves, and tail_waste_pct: the share of the last, partly filled wave that is idle."""
    slots = max(multiprocessors * blocks_each, 1)
    ns = F.col("end_ns") - F.col("start_ns")
    first = F.min(F.struct("ordinal", "block", "registers"))
    shapes = kernels.where(ns > 0).groupBy("name", "grid").agg(F.count("*").alias("_n"), F.sum(ns).alias("_ns"), first.alias("_one"))  # a shape is read once
    per = shapes.groupBy("name").agg(
        _long(F.sum("_n")).alias("calls"), (F.sum("_ns") / 1e6).alias("total_ms"), _long(F.max(numeric.grid_blocks("grid"))).alias("blocks"), F.min("_one").alias("_one"),
    ).withColumn("_first", F.col("_one.ordinal"))
    waves = F.col("blocks") / slots
    whole = F.ceil(waves)
    waste = F.when(whole > 0, 100.0 * (whole - waves) / whole).otherwise(0.0)
    return per.orderBy(F.col("total_ms").desc(), "_first").select(
        "name", "calls", "total_ms", "blocks", numeric.threads_per_block(F.col("_one.block")).alias("threads"), F.col("_one.registers").alias("registers"), waves.alias("waves"), waste.alias("tail_waste_pct"),
    )


def efficiency_report(kernels: DataFrame, multiprocessors: int, peak_gbs: float = 0.0, bytes_moved: int = 0, blocks_each: int = 1, top: int = 12) -> DataFrame:
    """One row: kernels shown, their total_ms, and the bandwidth that their time gives the bytes moved."""
    shown = kernel_efficiency(kernels, multiprocessors, blocks_each).limit(top)
    out = shown.agg(_long(F.count("*")).alias("rows"), F.coalesce(F.sum("total_ms"), F.lit(0.0)).alias("total_ms"))
    out = out.withColumn("achieved_gbs", numeric.achieved_rate(F.col("total_ms") * 0 + F.lit(bytes_moved), "total_ms"))
    used = F.lit(0.0) if not peak_gbs else 100.0 * F.col("achieved_gbs") / peak_gbs
    return out.withColumns({"bandwidth_pct": used, "multiprocessors": F.lit(multiprocessors), "peak_gbs": F.lit(float(peak_gbs))})


def time_split(kernels: DataFrame, copies: DataFrame) -> DataFrame:
    """One row: kernel_ns, copy_ns, copy_bytes, compute_pct, copy_pct, copy_gbps and the bound that time alone gives."""
    ns = F.col("end_ns") - F.col("start_ns")
    zero = F.lit(0).cast("long")
    k = kernels.agg(_long(F.coalesce(F.sum(ns), zero)).alias("kernel_ns"))
    c = copies.agg(_long(F.coalesce(F.sum(ns), zero)).alias("copy_ns"), _long(F.coalesce(F.sum("bytes_moved"), zero)).alias("copy_bytes"))
    both = k.crossJoin(c)  # one row each
    whole = F.greatest(F.col("kernel_ns") + F.col("copy_ns"), F.lit(1).cast("long"))
    return both.withColumns({
        "compute_pct": 100.0 * F.col("kernel_ns") / whole, "copy_pct": 100.0 * F.col("copy_ns") / whole, "copy_gbps": numeric.bandwidth("copy_bytes", "copy_ns"),
        "bound": bound(F.col("kernel_ns"), F.col("copy_ns"), F.lit(0.0), F.lit(0.0)),
    })


def bound(kernel_ns: Column, copy_ns: Column, memory_util: Column, compute_util: Column) -> Column:
    """`memory` or `compute` by time where any was traced, else by utilization, else `unknown`."""
    by_time = F.when(copy_ns >= kernel_ns, "memory").otherwise("compute")
    by_use = F.when(memory_util >= compute_util, "memory").otherwise("compute")
    return F.when((kernel_ns > 0) | (copy_ns > 0), by_time).when((memory_util > 0) | (compute_util > 0), by_use).otherwise("unknown")


def hot_regions(kernels: DataFrame, windows: DataFrame, by: list[str], top: int | None = 10, start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Per region (innermost window): calls, total, share_pct, and wall of the last window of that name; hottest first."""
    placed = innermost(kernels, windows, by, start, width)
    per = placed.groupBy("region").agg(_long(F.count("*")).alias("calls"), _long(F.sum(F.col(end) - F.col(start))).alias("total"), F.min("ordinal").alias("_first"))
    per = _with_share(per, "total")
    walls = windows.groupBy(F.col("name").alias("region")).agg(F.max_by("wall", "ordinal").alias("wall"))
    out = per.join(walls, "region", "left").withColumn("wall", F.coalesce("wall", F.lit(0).cast("long"))).orderBy(F.col("total").desc(), "_first")
    return (out.limit(top) if top else out).drop("_first")


# Region statistics ---------------------------------------------------------------------------------------------


def region_summaries(readings: DataFrame, by: list[str]) -> DataFrame:
    """Per region: samples, peak and mean memory (whole bytes, rounded down), mean utilizations and power, highest temperature."""
    return readings.groupBy(*by).agg(
        _long(F.count("*")).alias("samples"), F.max("memory_used_bytes").alias("peak_memory_bytes"), _long(F.floor(F.sum("memory_used_bytes") / F.count("*"))).alias("avg_memory_bytes"),
        F.avg("gpu_util_pct").alias("avg_util_pct"), F.avg("memory_util_pct").alias("avg_memory_util_pct"), F.avg("power_w").alias("avg_power_w"), F.max("temperature_c").alias("max_temp_c"),
    )


def region_stats(summaries: DataFrame) -> DataFrame:
    """Per region name: calls, total_ms, mean_ms, peaks; longest first. Summaries have name, wall_ms, ordinal and the rest."""
    return (
        summaries.groupBy("name").agg(
            _long(F.count("*")).alias("calls"), F.sum("wall_ms").alias("total_ms"), F.avg("wall_ms").alias("mean_ms"), F.max("peak_memory_bytes").alias("peak_memory_bytes"),
            F.max("avg_util_pct").alias("peak_util_pct"), F.max("avg_power_w").alias("peak_power_w"), F.min("ordinal").alias("_first"),
        ).orderBy(F.col("total_ms").desc(), "_first").drop("_first")
    )


def bottlenecks(summaries: DataFrame, top: int = 10) -> DataFrame:
    return region_stats(summaries).limit(top)


def memory_use(summaries: DataFrame) -> DataFrame:
    """One row: the highest peak and the mean of means (rounded down) over regions; zeros without any."""
    zero = F.lit(0).cast("long")
    mean = F.floor(F.sum("avg_memory_bytes") / F.count("*"))
    return summaries.agg(F.coalesce(F.max("peak_memory_bytes"), zero).alias("peak_memory_bytes"), F.coalesce(_long(mean), zero).alias("avg_memory_bytes"))


def utilization(summaries: DataFrame) -> DataFrame:
    """One row: unweighted means of memory and compute utilization over regions; zeros without any."""
    return summaries.agg(F.coalesce(F.avg("avg_memory_util_pct"), F.lit(0.0)).alias("memory_util"), F.coalesce(F.avg("avg_util_pct"), F.lit(0.0)).alias("compute_util"))


def profile_report(kernels: DataFrame, copies: DataFrame, summaries: DataFrame, iterations: int, peak_gbps: float, supported: int | None = None, requested: int | None = None, device: str = "") -> DataFrame:
    """One row: the verdict on a profile, from its kernels, copies and region summaries."""
    top = hot_kernels(kernels, 1).select(F.col("name").alias("_name"), F.col("share_pct").alias("_share"))
    top = top.agg(F.coalesce(F.max("_name"), F.lit("")).alias("dominant_kernel"), F.coalesce(F.max("_share"), F.lit(0.0)).alias("dominant_share_pct"))
    rows = time_split(kernels, copies).drop("bound").crossJoin(utilization(summaries)).crossJoin(memory_use(summaries)).crossJoin(top)  # one row each
    kind = lambda v: F.lit(v).cast("int")
    return rows.withColumns({
        "bound": bound(F.col("kernel_ns"), F.col("copy_ns"), F.col("memory_util"), F.col("compute_util")), "iterations": F.lit(iterations), "device": F.lit(device),
        "peak_gbps": F.lit(float(peak_gbps)), "unavailable": numeric.missing_activities(kind(supported), kind(requested)),
    })


def report_text(report: DataFrame) -> DataFrame:
    """A profile report as lines of text."""
    head = F.format_string("%s-bound after %d iterations: compute %.1f%%, copies %.1f%%", "bound", "iterations", "compute_pct", "copy_pct")
    kernel = F.format_string("hottest kernel %s, %.1f%% of kernel time", "dominant_kernel", "dominant_share_pct")
    memory = F.when(F.col("peak_memory_bytes") > 0, F.format_string("peak memory %.3f GB", F.col("peak_memory_bytes") / 1e9))
    speed = F.when(F.col("peak_gbps") > 0, F.format_string("copy bandwidth %.1f of %.1f GB/s", "copy_gbps", "peak_gbps"))
    untraced = F.when(F.size("unavailable") > 0, F.concat(F.lit("not traced on this device: "), F.concat_ws(", ", "unavailable")))
    return report.select(F.concat_ws("\n", head, kernel, memory, speed, untraced).alias("value"))


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Regions of two profiles side by side: before_ms, after_ms, delta_ms, speedup; largest change first, then by name.

    A side without a region has 0; the speedup is 0 unless both sides have it and the second took time.
    """
    b = before.groupBy("name").agg(F.sum("wall_ms").alias("_before"))
    a = after.groupBy("name").agg(F.sum("wall_ms").alias("_after"))
    out = b.join(a, "name", "full").select(
        "name", F.coalesce("_before", F.lit(0.0)).alias("before_ms"), F.coalesce("_after", F.lit(0.0)).alias("after_ms"),
        F.when(F.col("_before").isNotNull() & (F.col("_after") > 0), F.col("_before") / F.col("_after")).otherwise(0.0).alias("speedup"),
    ).withColumn("delta_ms", F.col("after_ms") - F.col("before_ms"))
    return out.orderBy(F.abs("delta_ms").desc(), "name")


# Collection ----------------------------------------------------------------------------------------------------


def keep_last(records: DataFrame, by: list[str], most: int) -> DataFrame:
    """The last `most` records of each track, and `dropped`: how many came before them."""
    order = Window.partitionBy(*by).orderBy(F.col("ordinal").desc())
    ranked = records.withColumn("_back", F.row_number().over(order)).withColumn("dropped", F.greatest(F.count("*").over(Window.partitionBy(*by)) - most, F.lit(0).cast("long")))
    return ranked.where(F.col("_back") <= most).drop("_back")


def calls_by_name(records: DataFrame) -> DataFrame:
    return records.groupBy("name").agg(_long(F.count("*")).alias("calls"))


def copy_records(records: DataFrame) -> DataFrame:
    """Raw copy records with the kind's name and the bandwidth."""
    return records.withColumns({"kind": numeric.copy_kind("kind_code"), "gbps": numeric.bandwidth("bytes_moved", F.col("end_ns") - F.col("start_ns"))}).drop("kind_code")


def laid_out(summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Regions without traces, laid end to end in their order: ts_us and dur_us."""
    ahead = Window.partitionBy(*(by or [])).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.withColumns({"ts_us": F.coalesce(F.sum(F.col("wall_ms") * 1000).over(ahead), F.lit(0.0)), "dur_us": F.col("wall_ms") * 1000})


def benchmark_ranking(samples: DataFrame) -> DataFrame:
    """Per case: iterations, mean_us, min_us; fastest mean first."""
    per = samples.groupBy("label").agg(_long(F.count("*")).alias("iterations"), F.avg("us").alias("mean_us"), F.min("us").alias("min_us"), F.min("ordinal").alias("_first"))
    return per.orderBy("mean_us", "_first").drop("_first")


def meter(samples: DataFrame, by: list[str]) -> DataFrame:
    """host_delta_gb (last minus first sample) and peak_gpu_gb (the highest sum over devices); samples have ordinal, host_gb, gpu_gb (array)."""
    total = F.aggregate("gpu_gb", F.lit(0.0), lambda a, x: a + x)
    return samples.groupBy(*by).agg(
        (F.max_by("host_gb", "ordinal") - F.min_by("host_gb", "ordinal")).alias("host_delta_gb"), F.coalesce(F.max(total), F.lit(0.0)).alias("peak_gpu_gb"),
    )


#: The reasons of a diagnosis.
NEAR_OOM, THROTTLED, SHARED = "near OOM: %.1f/%.1f GB (%.0f%%)", "throttled: ", "host offload: %d processes share the GPU"
GROWN, UNDERUSED, HEALTHY = "host offload: host memory grew %.1f GB", "GPU underutilized: %d%% compute", "healthy"


def diagnosis(rows: DataFrame, headroom_pct: float = 5.0, util_floor: int = 25, host_growth_gb: float = 4.0) -> DataFrame:
    """Trials with four flags and the reason of the gravest. Rows have peak_gpu_gb, host_delta_gb, capacity_gb, gpu_pct, processes, throttles (array)."""
    used = F.when(F.col("capacity_gb") > 0, 100.0 * F.col("peak_gpu_gb") / F.col("capacity_gb")).otherwise(0.0)
    contended = F.col("processes") > 1
    flagged = rows.withColumns({
        "_used": used, "near_oom": used >= 100.0 - headroom_pct, "gpu_underutilized": F.col("gpu_pct") <= util_floor,
        "host_offload": (F.col("host_delta_gb") >= host_growth_gb) | contended, "throttled": F.size("throttles") > 0,
    })
    reason = (
        F.when(F.col("near_oom"), F.format_string(NEAR_OOM, "peak_gpu_gb", "capacity_gb", "_used"))
        .when(F.col("throttled"), F.concat(F.lit(THROTTLED), F.concat_ws(", ", "throttles")))
        .when(contended, F.format_string(SHARED, "processes"))
        .when(F.col("host_offload"), F.format_string(GROWN, "host_delta_gb"))
        .when(F.col("gpu_underutilized"), F.format_string(UNDERUSED, "gpu_pct"))
        .otherwise(HEALTHY)
    )
    return flagged.withColumn("reason", reason).drop("_used")


def stages_text(stages: DataFrame) -> DataFrame:
    """A timing table as lines of text, in the order of the stages."""
    return stages.orderBy("ordinal").select(F.format_string("%-24s %12.3f ms", "name", "mean_ms").alias("value"))
