"""Cost analytics: setup-time fits, billing, quotes, offer choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numeric
from quillon.session import scratch

#: Fits need as many positive setup times; jobs on providers without a fit are taken to need DEFAULT_SETUP seconds.
LEAST_SAMPLES, DEFAULT_SETUP = 3, 300.0


def with_times(observations: DataFrame) -> DataFrame:
    return observations.withColumns({"setup_s": numeric.setup_seconds("t_submit", "t_running"), "run_s": numeric.run_seconds("t_running", "t_ended")})


#: Different values of a key that one buffer may hold; the quantiles of larger keys are found in rounds. Bins of a round.
HELD, BINS = 100_000, 1024


def ranked(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """keys, rank, value: the rank-th smallest value (from 0) of each key, for ranks (keys, rank, low, high: the key's least and largest).
    Rows have a value and n, how many times it is there, and are read in every round.

    A round counts a key's values between two bounds in BINS bins, each with its least and largest value, and goes on in the bin that
    the rank is in, until one value is left there. Counts are combined before they are moved, so that no task holds the values of a key.
    """
    spark = rows.sparkSession
    folder, number = scratch(spark), 0
    state = ranks.select(*keys, "rank", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.lit(0).cast("long").alias("before"))
    while True:
        state.write.parquet(f"{folder}/{number}")
        state = spark.read.parquet(f"{folder}/{number}")
        todo = state.where("low < high")
        if todo.isEmpty():
            return state.select(*keys, "rank", F.col("low").alias("value"))
        named = todo.select(*[F.col(k).alias(f"_{k}") for k in keys], "rank", "low", "high", "before")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
        met = rows.join(named, same & F.col(value).between(F.col("low"), F.col("high")))
        share = (F.col(value) / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves cannot overflow
        place = [*keys, "rank", "before"]
        bins = met.groupBy(*place, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # BINS rows at most
        hit = bins.withColumn("upto", F.col("before") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = state.where("low = high").unionByName(hit.select(*keys, "rank", "low", "high", (F.col("upto") - F.col("n")).alias("before")))
        number += 1


def quantiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """keys, samples, mean, and q0, q1, ... : exact quantiles, interpolated between neighbours. Keys of few different values take one pass.

    Rows are worked out once: each value with how often it is there (n) is written, and all that follows reads that.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows.groupBy(*keys, value).agg(F.count("*").cast("long").alias("n")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    known = F.sum(F.when(F.col(value).isNotNull(), F.col("n")))
    samples, mean = F.sum("n").alias("samples"), (F.sum(F.col(value).cast("double") * F.col("n")) / known).alias("mean")
    stats = rows.groupBy(*keys).agg(samples, mean, F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("_different"))
    names = [f"q{i}" for i in range(len(at))]
    if stats.where(F.col("_different") > HELD).isEmpty():
        return rows.groupBy(*keys).agg(samples, mean, F.percentile(value, F.array(*map(F.lit, at)), F.col("n")).alias("_at")).select(
            *keys, "samples", "mean", *[F.col("_at")[i].alias(n) for i, n in enumerate(names)]
        )
    places = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("samples") - 1)).alias("place")) for i, q in enumerate(at)))
    wanted = stats.select(*keys, "samples", "mean", "low", "high", F.explode(places).alias("p")).select(*keys, "samples", "mean", "low", "high", "p.*")
    wanted = wanted.withColumn("below", F.floor("place").cast("long")).withColumn("part", F.col("place") - F.col("below"))
    ranks = wanted.select(*keys, "low", "high", F.explode(F.array_distinct(F.array("below", F.least(F.col("below") + 1, F.col("samples") - 1)))).alias("rank")).distinct()
    found = ranked(rows, keys, value, ranks)
    met = wanted.alias("w").join(found.alias("f"), reduce(lambda a, b: a & b, [F.col(f"w.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], F.col("f.rank").isin(F.col("w.below"), F.col("w.below") + 1)))
    weight = F.when(F.col("f.rank") == F.col("w.below"), 1 - F.col("w.part")).otherwise(F.col("w.part"))
    kept = [F.col(f"w.{k}").alias(k) for k in keys]
    return met.groupBy(*kept).agg(
        F.first("w.samples").alias("samples"), F.first("w.mean").alias("mean"), *[F.sum(F.when(F.col("w.i") == i, weight * F.col("f.value"))).alias(n) for i, n in enumerate(names)]
    )


def setup_fits(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per provider and hardware: samples, mean_s, p50_s, p90_s of positive setup times, exact and interpolated; three samples at least."""
    positive = with_times(observations).where(F.col("setup_s") > 0)
    keys = by if by is not None else ["provider", "gpu"]
    fits = quantiles(positive.select(*keys, "setup_s"), keys, "setup_s", (0.5, 0.9)).where(F.col("samples") >= LEAST_SAMPLES)
    return fits.select(*keys, "samples", F.col("mean").alias("mean_s"), F.col("q0").alias("p50_s"), F.col("q1").alias("p90_s"))


def offers_for(offers: DataFrame, gpu: str = "", provider: str = "") -> DataFrame:
    """Offers by hardware (whatever the case) and provider (exactly); empty means any."""
    out = offers.where(F.lower("gpu") == gpu.lower()) if gpu else offers
    return out.where(F.col("provider") == provider) if provider else out


def billed(rows: DataFrame) -> DataFrame:
    """Rows with setup_s, run_s and an offer's billing columns, with billed_s and cost_usd."""
    out = rows.withColumn("billed_s", numeric.billed_seconds("setup_s", "run_s", "granularity_s", "minimum_s"))
    return out.withColumn("cost_usd", numeric.cost("rate_usd_hr", "billed_s", "fees_usd"))


def quotes(offers: DataFrame, observations: DataFrame | None, run_s: float, gpu: str = "", default_setup_s: float = DEFAULT_SETUP) -> DataFrame:
    """Offers priced for a job of run_s seconds: expected_usd, p90_usd, setup_samples; cheapest first, then by ordinal.

    Fits match the exact hardware name of the offer. An offer that names no hardware, or no provider, takes the fit
    over all of them. Fits are an aggregate by provider and hardware, so the joined side stays small; the wider fits
    are only worked out where some offer leaves a name empty.
    """
    found = offers_for(offers, gpu)
    fit = F.lit(None).cast("struct<samples: long, p50_s: double, p90_s: double>").alias("_fit")
    if observations is None:
        out = found.withColumn("_fit", fit)
    else:
        out = found
        packed = F.struct("samples", "p50_s", "p90_s")
        open_names = not found.where((F.col("provider") == "") | (F.col("gpu") == "")).isEmpty()
        groups = [["provider", "gpu"], *([["provider"], ["gpu"], []] if open_names else [])]
        names = [f"_fit_{len(keys)}_{''.join(keys)}" for keys in groups]
        for keys in groups:
            fits = setup_fits(observations, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], packed.alias(f"_fit_{len(keys)}_{''.join(keys)}"))
            blank = [c for c in ("provider", "gpu") if c not in keys]
            condition = F.lit(True)
            for k in keys:
                condition = condition & (F.col(k) == F.col(f"_{k}")) & (F.col(k) != "")
            for c in blank:
                condition = condition & (F.col(c) == "")
            out = out.join(fits, condition, "left").drop(*[f"_{k}" for k in keys])
        out = out.withColumn("_fit", F.coalesce(*names)).drop(*names)
    price = lambda setup: numeric.cost("rate_usd_hr", numeric.billed_seconds(setup, F.lit(float(run_s)), "granularity_s", "minimum_s"), "fees_usd")
    out = out.withColumns({
        "expected_usd": price(F.coalesce("_fit.p50_s", F.lit(default_setup_s))), "p90_usd": price(F.coalesce("_fit.p90_s", F.lit(default_setup_s))),
        "setup_samples": F.coalesce("_fit.samples", F.lit(0).cast("long")),
    }).drop("_fit")
    return out.orderBy("expected_usd", "ordinal")


def pick(offers: DataFrame, most_usd_hr: float = 0.0) -> DataFrame:
    """The most reliable offer, the cheapest of equals, the first of those; an error without any."""
    found = offers.where(F.col("rate_usd_hr") <= most_usd_hr) if most_usd_hr else offers
    best = found.agg(F.max_by(F.struct(*found.columns), F.struct("reliability", -F.col("rate_usd_hr"), -F.col("ordinal"))).alias("_best"))
    return best.select(F.when(F.col("_best").isNull(), F.raise_error(F.lit("no offer")).cast(best.schema["_best"].dataType)).otherwise(F.col("_best")).alias("_best")).select("_best.*")


def search(offers: DataFrame, gpu: str = "", gpus: int = 0, most_usd_hr: float = 0.0, spot: bool = False, limit: int = 32) -> DataFrame:
    """Market search: the market returns its cheapest by on-demand rate, and what it returns is sorted by the effective rate."""
    out = offers.where(F.col("gpu") == gpu) if gpu else offers
    out = out.where(F.col("gpu_count") == gpus) if gpus else out
    out = out.where(F.col("total_usd_hr") <= most_usd_hr) if most_usd_hr else out
    rate = F.when(F.lit(spot), F.col("floor_usd_hr")).otherwise(F.col("total_usd_hr"))
    return out.orderBy("total_usd_hr", "ordinal").limit(limit).withColumn("rate_usd_hr", rate).orderBy("rate_usd_hr", "ordinal")


def standing(credits: DataFrame, metered: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row: declared credit less metered cost, or a note where either is unknown. Both tables have one number each row.

    samples are offers of a sample search; their least rate_usd_hr is the rate that the account can rent at, at the least.
    """
    c = credits.agg(F.sum("usd").alias("credit_usd"))
    m = metered.agg(F.sum("usd").alias("metered_usd"))
    left = F.col("credit_usd") - F.col("metered_usd")
    note = F.when(F.col("credit_usd").isNull(), "no declared credit").when(F.col("metered_usd").isNull(), "no metered cost")
    out = c.crossJoin(m).select("credit_usd", "metered_usd", left.alias("remaining_usd"), note.alias("note"))  # one row each
    return out if samples is None else out.crossJoin(samples.agg(F.min("rate_usd_hr").alias("cheapest_usd_hr")))  # one row each


def budgeted(environments: DataFrame) -> DataFrame:
    """The first environment that has a budget, the default one before the others: name, remaining_usd."""
    found = environments.where(F.col("budget_usd").isNotNull())
    best = found.agg(F.min_by(F.struct("name", (F.col("budget_usd") - F.col("usage_usd")).alias("remaining_usd")), F.struct(~F.col("is_default"), F.col("ordinal"))).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select("_b.*")
