"""Topic series: robust z, two-state bursts, share change and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.functions.scalars import week_start
from vidtrend.operators import windows
from vidtrend.operators.scale import calendar_broadcast, scalar


def topic_series(df: DataFrame, topic: str = "topic", ts: str = "createTimeISO") -> DataFrame:
    """(topic, day, frequency) per calendar day."""
    return df.filter(F.col(topic).isNotNull()).groupBy(topic, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("frequency"))


def robust_z(series: DataFrame, topic: str = "topic", z: float = 3.5, min_history: int = 4,
             with_noise: bool = True) -> DataFrame:
    """z of the last smoothed daily ratio per topic; noise (-1) only counts in the day totals."""
    base = series if with_noise else series.filter(F.col(topic) != -1)
    totals = calendar_broadcast(base.groupBy("day").agg(F.sum("frequency").alias("_t")))
    ratios = base.filter(F.col(topic) != -1).join(totals, "day").filter(F.col("_t") > 0).withColumn(
        "ratio", F.col("frequency") / F.col("_t"))
    smooth = windows.centred_mean(ratios, [topic], "day", "ratio", "smooth")
    return windows.robust_z_last(smooth, [topic], "day", "smooth", min_history).filter(F.col("z") > z)


def kleinberg(series: DataFrame, totals: DataFrame, topic: str = "topic", s: float = 2.0, gamma: float = 1.0,
              min_history: int = 4) -> DataFrame:
    """Burst state of the last day per topic (two states, binomial costs, no smoothing).

    A topic's days fold through the two-cost recurrence; there is at most one entry per day.
    ``totals`` is (day, d). ln C(d, r) is equal in both states and left out.
    """
    rows = (series.filter(F.col(topic) != -1).join(calendar_broadcast(totals), "day").filter(F.col("d") > 0)
            .groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("day", F.col("frequency").alias("r"), "d"))).alias("days"),
                                F.sum("frequency").alias("_r"), F.sum("d").alias("_d"), F.count("*").alias("n")))
    rows = rows.filter((F.col("n") >= min_history) & (F.col("_r") > 0))
    p0 = F.col("_r") / F.col("_d")
    p1 = F.least(p0 * F.lit(float(s)), F.lit(0.9999))
    rows = rows.withColumns({"_p0": F.least(p0, F.lit(0.9999)), "_p1": p1, "_up": F.lit(float(gamma)) * F.log("n")})
    cost = lambda x, p: -(x["r"] * F.log(p) + (x["d"] - x["r"]) * F.log(1 - p))
    walk = F.aggregate(
        "days", F.struct(F.lit(0.0).alias("c0"), F.lit(float("inf")).alias("c1")),
        lambda a, x: F.struct(
            (F.least(a["c0"], a["c1"]) + cost(x, F.col("_p0"))).alias("c0"),
            (F.least(a["c0"] + F.col("_up"), a["c1"]) + cost(x, F.col("_p1"))).alias("c1")))
    return rows.withColumn("_w", walk).select(
        topic, "n", F.when(F.col("_w.c1") < F.col("_w.c0"), 1).otherwise(0).alias("level"))


def share_change(df: DataFrame, topic: str = "topic", ts: str = "createTimeISO", mode: str = "relative") -> DataFrame:
    """Change of a topic's weekly share against its previous observed week, newest week only."""
    dated = df.filter(F.col(topic).isNotNull()).withColumn("week", week_start(ts))
    counts = dated.groupBy(topic, "week").agg(F.count("*").alias("n"))
    totals = calendar_broadcast(counts.groupBy("week").agg(F.sum("n").alias("_t")))
    shares = counts.join(totals, "week").withColumn("share", F.col("n") / F.col("_t"))
    shares = windows.previous(shares, [topic], "week", "share", "previous_share")
    gap = F.col("share") - F.col("previous_share")
    if mode == "relative":
        change = F.when(F.col("previous_share") > 0, gap / F.col("previous_share")).otherwise(0.0)
    else:
        change = F.coalesce(gap, F.lit(0.0))
    newest = scalar(dated, F.max("week"))
    return shares.filter(F.col("week") == newest).select(
        topic, "share", "previous_share", change.alias("share_change"))


def topic_trends(df: DataFrame, topic: str = "topic", ts: str = "createTimeISO", combine: str = "burst_first",
                 z: float = 2.5, min_history: int = 2, min_volume: int = 4, top: int = 10) -> DataFrame:
    """Top topics by burst level or z, with volume and weekly share change."""
    if combine == "max":
        df = df.filter(F.col(topic) != -1)
    series = topic_series(df, topic, ts)
    totals = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("d"))
    volume = series.groupBy(topic).agg(F.sum("frequency").alias("volume")).filter(F.col("volume") >= min_volume)
    zs = robust_z(series, topic, z, min_history, combine != "max").select(topic, "z")
    bursts = kleinberg(series, totals, topic, min_history=min_history).filter(F.col("level") > 0).select(topic, "level")
    both = zs.join(bursts, topic, "full_outer")
    if combine == "max":
        score = F.greatest(F.coalesce("z", F.lit(0.0)), F.coalesce(F.col("level").cast("double"), F.lit(0.0)))
    else:
        score = F.coalesce(F.col("level").cast("double"), F.col("z"))
    ranked = both.withColumn("score", score).join(volume, topic).orderBy(F.desc("score"), topic).limit(top)
    change = share_change(df, topic, ts, "relative" if combine != "max" else "absolute")
    return ranked.join(change.select(topic, "share_change"), topic, "left").na.fill(0.0, ["share_change"])
