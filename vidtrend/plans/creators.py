"""Videos, creators, engagement and comment reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.functions.scalars import LIKES_SHARES_COMMENTS, engagement, engagement_rate
from vidtrend.operators import dedupe, filters
from vidtrend.operators.scale import exact_quantiles, value_profile
from vidtrend.plans import keywords


def top_viral(df: DataFrame, as_of=None, days: int = 7, k: int = 5, url: str = "webVideoUrl",
              ts: str = "createTimeISO", plays: str = "playCount") -> DataFrame:
    """Most played videos of the last days, each URL once (its most played row)."""
    recent = filters.recent_days(df.na.drop(subset=[url, ts]), ts, days, as_of)
    return dedupe.keep_first(recent, [url], [F.desc(plays), F.col("post_id")]).orderBy(
        F.desc(plays), url).limit(k)


def influencers(df: DataFrame, start: str | None = None, end: str | None = None, min_posts: int = 1, k: int = 10,
                author: str = "author_nickName", post: str = "post_id", ts: str = "createTimeISO",
                metrics: Sequence[str] = LIKES_SHARES_COMMENTS) -> DataFrame:
    """Creators by engagement; comment-grain input is first reduced to one row per post."""
    base = filters.date_range(df, ts, start, end) if start and end else df
    per_post = base.na.drop(subset=[author]).withColumn("_e", engagement(metrics)).groupBy(author, post).agg(
        F.max("_e").alias("_e"), F.max("playCount").alias("_p"))
    table = per_post.groupBy(author).agg(
        F.sum("_e").alias("engagement"), F.sum("_p").alias("plays"), F.count("*").alias("posts"))
    table = table.withColumn("avg_engagement", F.col("engagement") / F.col("posts"))
    return table.filter(F.col("posts") >= min_posts).orderBy(F.desc("engagement"), author).limit(k)


def author_means(df: DataFrame, author: str = "author_nickName",
                 metrics: Sequence[str] = ("playCount", "diggCount", "shareCount", "commentCount"),
                 k: int = 20) -> DataFrame:
    table = df.na.drop(subset=[author]).groupBy(author).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return table.orderBy(F.desc(f"mean_{metrics[0]}"), author).limit(k)


def comment_phrases(df: DataFrame, col: str = "comment", tie: str = "comment_id", n: int = 2, k: int = 20,
                    stop: Sequence[str] = (), creator: str | None = None, start: str | None = None, end: str | None = None,
                    author: str = "author_nickName", ts: str = "createTimeISO") -> DataFrame:
    """Most frequent phrases of distinct, spam-free comments.

    With ``creator``, ``start`` or ``end`` (both included) only the comments on that creator's posts of those
    days; these bounds are plain comparisons, so they reach the scan of the posts.
    """
    if creator is not None:
        df = df.filter(F.col(author) == creator)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    rows = df.filter(F.col(col).isNotNull()).withColumn("_c", F.lower(F.trim(F.col(col))))
    rows = filters.drop_spam(dedupe.keep_first(rows, ["_c"], [tie]), "_c")
    return keywords.top_grams(rows, text.letter_tokens("_c", stop), n, k)


def ad_split(df: DataFrame, flag: str = "isAd") -> DataFrame:
    """Engagement rate by flag: posts, mean and quartiles."""
    rated = df.withColumn("rate", engagement_rate()).filter(F.col("rate").isNotNull() & F.col(flag).isNotNull())
    return value_profile(rated, "rate", [flag], [0.25, 0.5, 0.75], ["q25", "median", "q75"], "posts", "mean_rate")


def flag_mismatch(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("isAd") != F.col("isSponsored")).alias("mismatches"),
                  F.count("*").alias("row_count")).withColumn("share", F.col("mismatches") / F.col("row_count"))


def comment_lengths(df: DataFrame, col: str = "comment", ts: str = "createTimeISO") -> DataFrame:
    """Comments, mean and median length per day."""
    rows = df.filter(F.col(col).isNotNull()).select(F.to_date(ts).alias("date"), F.length(col).alias("length"))
    return value_profile(rows, "length", ["date"], [0.5], ["median_length"], "comments", "mean_length")


def lengths_by_label(df: DataFrame, col: str, label: str, prob: float = 0.95) -> DataFrame:
    """Mean text length per label after cutting the longest texts."""
    sized = df.filter(F.col(col).isNotNull()).withColumn("length", F.length(col))
    (cut,) = [exact_quantiles(sized, "length", [prob], names=["p"]).scalar()]
    return sized.filter(F.col("length") <= cut).na.drop(subset=[label]).groupBy(label).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length"))
