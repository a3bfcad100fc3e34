"""Sound trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtrend.operators import aggregates, filters, windows
from vidtrend.operators.scale import average_rank_pct, scalar
from vidtrend.plans.hashtags import share_trends


def weekly_trends(df: DataFrame, top: int = 15, as_of=None) -> DataFrame:
    """Share change of sounds that are not original audio, with the newest metadata."""
    licensed = df.filter(~F.col("musicOriginal").eqNullSafe(True))
    return share_trends(
        licensed, "musicID", weeks=2, top=top, order=("createTimeISO", "post_id"), labels=False, as_of=as_of,
        examples={"musicName": "musicName", "musicAuthor": "musicAuthor", "playUrl": "playUrl"})


def surges(df: DataFrame, song: str = "musicName", ts: str = "createTimeISO", recent: int = 7, history: int = 60,
           pct: float = 0.99, top: int | None = 30, author: str | None = "musicAuthor") -> DataFrame:
    """Songs whose last days stand out against the mean of the days before them.

    Only the last ``recent + history`` observed days matter, so they are cut out first and each
    song becomes two conditional sums; no zero-filled table is built.
    """
    if author in df.columns:
        df = df.filter(F.col(author).isNotNull())  # rows without an author do not count
    base = df.select(song, F.to_date(ts).alias("day")).na.drop()
    days = base.select("day").distinct().orderBy(F.desc("day")).limit(recent + history)
    edges = days.agg(F.struct(
        F.get(F.sort_array(F.collect_list("day"), asc=False), F.lit(recent - 1)).alias("recent_from"),
        F.min("day").alias("history_from"), F.count("*").alias("n")).alias("e")).scalar()
    used = F.col("day") >= F.col("_e.history_from")
    new = F.col("day") >= F.col("_e.recent_from")
    # every song has a series, also one without plays in the window
    feats = base.withColumn("_e", edges).groupBy(song).agg(
        F.count_if(used & new).alias("recent_sum"), F.count_if(used & ~new).alias("_past"), F.max("_e.n").alias("_days"))
    feats = feats.filter(F.col("_days") == recent + history).select(
        song, "recent_sum", (F.col("_past") / F.lit(float(history))).alias("hist_mean"))
    feats = feats.withColumn("trend_ratio", F.col("recent_sum") / (F.col("hist_mean") + F.lit(1e-6)))
    ranked = average_rank_pct(feats, "trend_ratio").filter(F.col("percentile") >= pct)
    return ranked.orderBy(F.desc("trend_ratio"), song).limit(top) if top else ranked


def with_authors(songs: DataFrame, df: DataFrame, song: str = "musicName", author: str = "musicAuthor") -> DataFrame:
    """Attach every distinct author of a song (several authors give several rows)."""
    pairs = df.select(song, F.col(author).alias("music_author")).join(
        songs.select(song).distinct(), song, "left_semi").distinct()
    return songs.join(pairs, song, "left")


def rolling_baseline(daily: DataFrame, song: str, day: str, value: str, recent: int = 7, history: int = 60) -> DataFrame:
    """The same features for every day of every song, on a zero-filled series."""
    spine = windows.observed_spine(daily, song, day, value)
    return windows.shifted_baseline(spine, [song], day, value, recent, history)


def top_tracks(df: DataFrame, col: str = "musicName", days: int = 30, k: int = 10, as_of=None) -> DataFrame:
    """Most used values of a column in the last days, with their share of posts."""
    recent = filters.recent_days(df, days=days, as_of=as_of)
    total = scalar(recent.filter(F.col(col).isNotNull()), F.count("*"))
    return (aggregates.counts(recent, col).withColumn("share_pct", F.col("n") * 100.0 / total)
            .orderBy(F.desc("n"), col).limit(k))


def original_split(df: DataFrame) -> DataFrame:
    return aggregates.value_shares(df, "musicOriginal")
