"""Market feeds as offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text

#: Providers whose feed name differs from the name used here, and tags of where offers come from.
FEED_NAMES = {"vastai": "vast"}
PROBED, IMPORTED = "probed:vast", "imported:gpuhunt"
REGIONS = "array<struct<regionName: string, regionId: string, instanceTypeInfos: array<struct<gpuNum: int, instanceTypeId: string, stockStatus: string, price: array<struct<chargeMode: string, price: double>>>>>>"


def market_rate(spot: bool) -> Column:
    """The bid floor of interruptible offers, the on-demand total of others."""
    return F.col("min_bid" if spot else "dph_total").cast("double")


def from_market(rows: DataFrame, spot: bool = False) -> DataFrame:
    return rows.select(
        F.lit("vast").alias("provider"), F.col("gpu_name").alias("gpu"), F.col("num_gpus").cast("int").alias("gpu_count"), F.lit(spot).alias("spot"),
        F.coalesce("geolocation", F.lit("")).alias("region"), market_rate(spot).alias("rate_usd_hr"), F.lit(1).alias("granularity_s"), F.lit(0).alias("minimum_s"),
        F.lit(0.0).alias("fees_usd"), F.col("rentable").alias("available"), F.lit(PROBED).alias("source"),
    )


def from_feed(rows: DataFrame) -> DataFrame:
    """Offers of a price feed; rows without a price, or with a price of 0, are left out."""
    priced = rows.where(F.col("price").isNotNull() & (F.col("price") != 0))
    return priced.select(
        text.renamed("provider", FEED_NAMES).alias("provider"), F.col("gpu_name").alias("gpu"), F.col("gpu_count").cast("int").alias("gpu_count"), F.coalesce("spot", F.lit(False)).alias("spot"),
        F.coalesce("location", F.lit("")).alias("region"), F.col("price").cast("double").alias("rate_usd_hr"), F.lit(1).alias("granularity_s"), F.lit(0).alias("minimum_s"),
        F.lit(0.0).alias("fees_usd"), F.lit(None).cast("boolean").alias("available"), F.lit(IMPORTED).alias("source"),
    )


def hourly(prices: Column | str) -> Column:
    """The first hourly price of a list; 0 without any."""
    p = F.col(prices) if isinstance(prices, str) else prices
    return F.coalesce(F.get(F.filter(p, lambda x: x["chargeMode"] == "perHour"), F.lit(0))["price"], F.lit(0.0))


def console_catalog(families: DataFrame) -> DataFrame:
    """Rentable types, one row per family (gpuName, regionInfos), region and type; in stock first, then cheapest."""
    regions = families.select(F.coalesce("gpuName", F.lit("")).alias("gpu"), F.explode("regionInfos").alias("_r"))
    kinds = regions.select("gpu", "_r.regionName", "_r.regionId", F.explode("_r.instanceTypeInfos").alias("_k"))
    rows = kinds.select(
        "gpu", F.coalesce("_k.gpuNum", F.lit(0)).alias("gpus"), hourly("_k.price").alias("usd_hr"), F.coalesce("regionName", F.lit("")).alias("region"),
        F.coalesce("regionId", F.lit("")).alias("region_id"), F.coalesce("_k.instanceTypeId", F.lit("")).alias("instance_type_id"), F.coalesce(F.col("_k.stockStatus") == "InStock", F.lit(False)).alias("in_stock"),
    )
    return rows.orderBy(~F.col("in_stock"), "usd_hr")
