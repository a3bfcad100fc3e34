"""Window operators over aggregated series (at most one row per key and calendar period)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.functions import fixed
from vidtrend.functions.scalars import safe_pct_change
from vidtrend.functions.text import bind
from vidtrend.operators.scale import scalar


def _ordered(by: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def daily_counts(df: DataFrame, key: str, day: str, post: str | None = None) -> DataFrame:
    """(key, day, n): distinct posts, or rows, per key and day."""
    base = df.na.drop(subset=[key, day])
    if post:
        base = base.select(key, day, post).distinct()
    return base.groupBy(key, day).agg(F.count("*").alias("n"))


def trailing_sum(df: DataFrame, by: Sequence[str], order: str, value: str, size: int,
                 name: str, calendar: bool = False) -> DataFrame:
    """Sum over the last ``size`` observed rows, or calendar days when ``calendar`` is set."""
    if calendar:
        w = Window.partitionBy(*by).orderBy(F.unix_date(F.col(order))).rangeBetween(-(size - 1), 0)
    else:
        w = _ordered(by, order).rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.sum(value).over(w))


def trailing_mean(df: DataFrame, by: Sequence[str], order: str, value: str, size: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_ordered(by, order).rowsBetween(-(size - 1), 0)))


def centred_mean(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, half: int = 1) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_ordered(by, order).rowsBetween(-half, half)))


def previous(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(_ordered(by, order)))


def pct_change(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, safe_pct_change(F.col(value), F.lag(value).over(_ordered(by, order))))


def difference(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(value) - F.lag(value).over(_ordered(by, order)), F.lit(0)))


def calendar_spine(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Every key on every day between the first and last day of the data, missing days zero.

    Each key builds its own day list, so nothing is cross-joined.
    """
    first, last = scalar(df, F.min(day)), scalar(df, F.max(day))
    keys = df.select(key).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    return keys.join(df.select(key, day, value), [key, day], "left").na.fill(0, [value])


def observed_spine(df: DataFrame, key: str, day: str, value: str, calendar: DataFrame | None = None) -> DataFrame:
    """Every key on every day that occurs anywhere in the data, or in ``calendar`` (a bounded list of days)."""
    days = (df if calendar is None else calendar).select(day).distinct().agg(F.array_sort(F.collect_list(day)).alias("d")).scalar()
    keys = df.select(key).distinct().withColumn(day, F.explode(days))
    return keys.join(df.select(key, day, value), [key, day], "left").na.fill(0, [value])


def shifted_baseline(df: DataFrame, by: Sequence[str], order: str, value: str, recent: int = 7,
                     history: int = 60) -> DataFrame:
    """Recent sum and mean of the ``history`` rows before it, null until the history is full."""
    w = _ordered(by, order)
    past = w.rowsBetween(-(recent + history - 1), -recent)
    return df.withColumns({
        "recent_sum": F.sum(value).over(w.rowsBetween(-(recent - 1), 0)),
        "hist_mean": F.when(F.count(value).over(past) == history, F.avg(value).over(past))})


def robust_z_last(df: DataFrame, by: Sequence[str], order: str, value: str, min_history: int = 2,
                  name: str = "z") -> DataFrame:
    """(last - median of history) / scaled MAD of history per key; a zero MAD reads as one.

    The series of one key has at most one row per calendar period.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    everything = Window.partitionBy(*by)
    marked = df.withColumn("_rn", F.row_number().over(w))
    hist = F.when(F.col("_rn") > 1, F.col(value))
    centred = marked.withColumn("_med", F.percentile(hist, F.lit(0.5)).over(everything))
    out = centred.groupBy(*by).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("last_value"),
        F.max("_med").alias("hist_median"),
        F.median(F.when(F.col("_rn") > 1, F.abs(F.col(value) - F.col("_med")))).alias("hist_mad"),
        F.count("*").alias("periods"))
    scale = F.col("hist_mad") * F.lit(fixed.MAD_SCALE)
    return out.filter(F.col("periods") >= min_history).withColumn(
        name, (F.col("last_value") - F.col("hist_median")) / F.when(scale == 0, F.lit(1.0)).otherwise(scale))


def classical_z_last(df: DataFrame, by: Sequence[str], order: str, value: str, last: Column) -> DataFrame:
    """z of the value on day ``last`` against mean and sample deviation of the key's series."""
    agg = df.groupBy(*by).agg(
        F.max(F.when(F.col(order) == last, F.col(value))).alias("last_value"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return agg.filter(F.col("last_value").isNotNull()).withColumn(
        "z", (F.col("last_value") - F.col("mean")) / F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def z_normalised(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c)
                              for c in cols]).alias("s")).scalar()
    return df.withColumn("_stats", stats).withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"_stats.{c}.m")) / (F.col(f"_stats.{c}.s") + F.lit(1e-8))
        for c in cols}).drop("_stats")


def min_max(df: DataFrame, col: str, name: str) -> DataFrame:
    lo, hi = scalar(df, F.min(col)), scalar(df, F.max(col))
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)))


def without_repeats(array: str | Column) -> Column:
    """Array with consecutive equal elements reduced to one."""
    return bind(array, lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def adjacent_pairs(array: str | Column) -> Column:
    """Array of (from_step, to_step) for neighbouring elements."""
    return bind(array, lambda a: F.when(F.size(a) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(a) - 2),
        lambda i: F.struct(F.get(a, i).alias("from_step"), F.get(a, i + 1).alias("to_step")))))
