"""The driver tables as the record kinds that the operators take.

Every adapter adds `ordinal`, a total order that stands for a list's positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals per track: track, name, start, end (microseconds), ordinal. An event lasts 200 s per unit of its value."""
    events = table(spark, sf_dir, "events")
    start = micros("ts")
    return events.select(
        F.col("user_id").alias("track"), F.col("event_type").alias("name"), start.alias("start"),
        (start + F.floor(F.col("value") * 200).cast("long") * 1_000_000).alias("end"), F.col("event_id").alias("ordinal"),
    )


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel records from line items: the part type is the name, the order is the device, the quantity the duration."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    start = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 1000
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("p_type").alias("name"), start.alias("start_ns"), (start + F.col("l_quantity").cast("long") * 1000).alias("end_ns"),
        F.concat_ws("x", "p_size", "l_linenumber", F.lit("1")).alias("grid"), F.concat_ws("x", "p_size", F.lit("1"), F.lit("1")).alias("block"),
        F.col("p_size").alias("registers"),
        # line items have no key: the whole row is the order
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("ordinal"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy records from line items: bytes are the price in cents, the discount's cents name the direction."""
    lines = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 1000
    return lines.select(
        F.pmod(F.round(F.col("l_discount") * 100).cast("int"), F.lit(11)).alias("kind_code"), start.alias("start_ns"),
        (start + F.round(F.col("l_tax") * 100).cast("long") * 100).alias("end_ns"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes_moved"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested windows per track: an hour and a day around every event, distinct."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), micros("ts").alias("us"))
    span = lambda name, width: events.select(
        "track", F.concat(F.lit(name + "-"), F.floor(F.col("us") / width).cast("string")).alias("name"),
        (F.floor(F.col("us") / width) * width).cast("long").alias("start"), ((F.floor(F.col("us") / width) + 1) * width).cast("long").alias("end"),
    )
    both = span("hour", 3_600_000_000).unionByName(span("day", 86_400_000_000)).distinct()
    return both.select("*", (F.col("end") - F.col("start")).alias("wall"), F.struct("start", "end", "name").alias("ordinal"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples: region is the user and the day."""
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("region"), F.col("user_id").alias("track"), micros("ts").alias("at"),
        F.col("event_id").alias("memory_used_bytes"), F.pmod(cents, F.lit(101)).cast("int").alias("gpu_util_pct"),
        F.pmod(cents, F.lit(97)).cast("int").alias("memory_util_pct"), F.pmod(cents, F.lit(301)).cast("int").alias("power_w"),
        F.pmod(cents, F.lit(90)).cast("int").alias("temperature_c"), F.col("event_id").alias("ordinal"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost observations: submitted on the order's day, running on the ship day, for as many hours as the quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    seconds = lambda c: (micros(c) / 1_000_000)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(7))).alias("provider"), F.concat(F.lit("g"), F.pmod("l_suppkey", F.lit(3))).alias("gpu"), F.lit("").alias("region"),
        seconds("o_orderdate").alias("t_submit"), seconds("l_shipdate").alias("t_running"),
        (seconds("l_shipdate") + F.col("l_quantity") * 3600).alias("t_ended"), F.lit(0.0).alias("billed_usd"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers from suppliers; odd ones bill by the minute with a minute at least."""
    rows = table(spark, sf_dir, "supplier")
    odd = F.pmod("s_suppkey", F.lit(2)) == 1
    return rows.select(
        F.concat(F.lit("p"), F.pmod("s_suppkey", F.lit(7))).alias("provider"), F.concat(F.lit("G"), F.pmod("s_suppkey", F.lit(3))).alias("gpu"), F.lit(1).alias("gpu_count"),
        (F.pmod("s_suppkey", F.lit(5)) == 0).alias("spot"), F.lit("").alias("region"), (F.round(F.abs("s_acctbal") * 100) / 100).alias("rate_usd_hr"),
        F.when(odd, 60).otherwise(1).alias("granularity_s"), F.when(odd, 60).otherwise(0).alias("minimum_s"), F.lit(0.0).alias("fees_usd"),
        F.when(F.pmod("s_suppkey", F.lit(4)) > 0, F.pmod("s_suppkey", F.lit(4)) == 1).alias("available"), F.lit("declared").alias("source"), F.col("s_suppkey").alias("ordinal"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records from orders: F is ok, P has failed, O has no verdict yet."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    verdict = F.when(status == "F", "ok").when(status == "P", "failed")
    return orders.select(
        F.col("o_custkey").cast("string").alias("handle"), F.concat(F.lit("host"), F.pmod("o_orderkey", F.lit(5))).alias("target"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("submitted_at"),
        F.concat(F.lit("study:s"), F.pmod("o_custkey", F.lit(4)), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("/t"), "o_orderkey")).otherwise("")).alias("name"),
        status.alias("state"), F.when(status == "P", F.pmod("o_orderkey", F.lit(150)).cast("int")).when(status == "F", 0).alias("exit_code"), verdict.alias("verdict"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, verdict).alias("reported"),
    )


def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study ledgers from events: views submit, purchases and errors are verdicts, sign-ups create."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(4))).alias("study_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        F.when(kind.isin("purchase", "error"), "verdict").when(kind == "signup", "created").when(kind == "click", "note").otherwise("submitted").alias("kind"),
        F.col("user_id").cast("string").alias("handle"), F.when(kind == "purchase", "ok").when((kind == "error") & (F.pmod("event_id", F.lit(3)) > 0), "failed").alias("state"),
        F.when(kind == "signup", F.concat(F.lit("name"), "event_id")).alias("name"), F.col("event_id").alias("ordinal"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of jobs from events, in order of arrival; a third of them arrive twice."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    once = events.select(
        F.col("user_id").cast("string").alias("job"),
        F.when(kind == "signup", "started").when(kind == "click", "ended").when(kind == "purchase", "sample").otherwise("line").alias("kind"),
        F.floor(F.col("event_id") / 2).cast("long").alias("offset"), F.col("ts").cast("timestamp").alias("at"),
        F.to_json(F.struct(F.pmod("event_id", F.lit(4)).cast("int").alias("exit_code"), F.round(F.col("value") * 100).cast("long").alias("rss"))).alias("payload"),
        F.col("event_id").alias("arrival"),
    )
    again = once.where(F.pmod("arrival", F.lit(3)) == 0).withColumn("payload", F.lit('{"exit_code":9,"rss":9}')).withColumn("arrival", F.col("arrival") + 1_000_000_000)
    return once.unionByName(again)
