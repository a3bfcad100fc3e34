"""Country and local-time reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import fixed, text
from vidtrend.functions.scalars import in_zone, lookup
from vidtrend.operators.scale import value_profile


def with_country(df: DataFrame, address: str = "location_address",
                 fixes: Mapping[str, str | None] = fixed.COUNTRY_FIX) -> DataFrame:
    return df.withColumn("country", lookup(text.country_of(address), fixes))


def country_metrics(df: DataFrame, plays: str = "playCount", k: int = 10) -> DataFrame:
    """Posts, mean and median plays of the countries with most posts."""
    table = value_profile(df, plays, ["country"], [0.5], ["median_plays"], "posts", "mean_plays")
    return table.orderBy(F.desc("posts"), "country").limit(k)


def local_hours(df: DataFrame, ts: str = "createTimeISO", zones: Mapping[str, str] = fixed.TIME_ZONES) -> DataFrame:
    """Posts per country and local hour; countries without a known zone are left out."""
    placed = df.withColumn("_zone", lookup("country", zones, default=True)).filter(F.col("_zone").isNotNull())
    return placed.groupBy("country", F.hour(in_zone(ts, F.col("_zone"))).alias("hour")).agg(
        F.count("*").alias("posts"))
