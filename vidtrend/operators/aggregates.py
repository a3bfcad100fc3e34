"""Group aggregates, shares, bins and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.operators.scale import exact_quantiles, non_null, scalar, with_quantiles


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return non_null(df, *keys).groupBy(*keys).agg(F.count("*").alias(name))


def distinct_counts(df: DataFrame, keys: Sequence[str], col: str, name: str,
                    approximate: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return non_null(df, *keys).groupBy(*keys).agg(agg.alias(name))


def describe_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"),
                 F.stddev_samp(m).alias(f"{m}_std")]
    return non_null(df, *keys).groupBy(*keys).agg(*aggs, F.count("*").alias("row_count"))


def medians(df: DataFrame, keys: Sequence[str], col: str, name: str = "median") -> DataFrame:
    return exact_quantiles(non_null(df, *keys) if keys else df, col, [0.5], keys, [name])


def value_shares(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """Value counts with the share of all counted rows."""
    base = df if keep_null else non_null(df, col)
    per_value = base.groupBy(col).agg(F.count("*").alias("n"))
    # the group counts add up to the rows, so the table behind them is read once
    return per_value.withColumn("share", F.col("n") / scalar(per_value, F.sum("n")))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return counts(df, col).orderBy(F.desc("n"), col).limit(k)


def crosstab(df: DataFrame, key: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Counts per key and known label, zero-filled, in one shuffle."""
    return non_null(df, key, label).groupBy(key).agg(
        *[F.count_if(F.col(label) == v).alias(v) for v in labels])


def row_shares(df: DataFrame, cols: Sequence[str], scale: float = 1.0, suffix: str = "_share",
               total: str | None = None) -> DataFrame:
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    out = df.withColumn(total, whole) if total else df
    return out.withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) * F.lit(float(scale)), whole) for c in cols})


def peak_normalised(df: DataFrame, by: Sequence[str], value: str, name: str,
                    scale: float = 1.0) -> DataFrame:
    """value / greatest value of its group x scale (the maxima are joined back)."""
    peaks = df.groupBy(*by).agg(F.max(value).alias("_peak"))
    return df.join(peaks, list(by)).withColumn(
        name, F.try_divide(F.col(value) * F.lit(float(scale)), F.col("_peak"))).drop("_peak")


def mention_shares(df: DataFrame, key: str, name: str = "share") -> DataFrame:
    per_key = counts(non_null(df, key), key)
    return per_key.withColumn(name, F.col("n") / scalar(per_key, F.sum("n")))


def post_shares(df: DataFrame, key: str, post: str, name: str = "share") -> DataFrame:
    """Distinct posts per key over all distinct posts (posts with a null key count below)."""
    per_key = df.select(key, post).na.drop().distinct().groupBy(key).agg(F.count("*").alias("n"))
    return per_key.withColumn(name, F.col("n") / scalar(df, F.count_distinct(post)))


def fair_shares(df: DataFrame, post: str, tag: str, metric: str) -> DataFrame:
    """Metric of a post divided by its number of tags; total and mean per tag."""
    per_post = df.filter(F.col(tag).isNotNull()).groupBy(post).agg(F.count("*").alias("_tags"))
    split = df.filter(F.col(tag).isNotNull()).join(per_post, post).withColumn(
        "_fair", F.col(metric) / F.col("_tags"))
    return split.groupBy(tag).agg(F.sum("_fair").alias("fair_total"), F.avg("_fair").alias("fair_mean"),
                                  F.count("*").alias("posts"))


def comment_rollup(comments: DataFrame, post: str = "post_id", time: str = "createTimeISO",
                   likes: str = "likes", user: str = "user", language: str = "language") -> DataFrame:
    """Per post: number of comments, first and last time, likes, distinct users and languages.

    The comment texts stay in the comment table; a post may have unboundedly many.
    """
    base = comments.groupBy(post).agg(
        F.count("*").alias("comments"), F.min(time).alias("first_comment"),
        F.max(time).alias("last_comment"), F.sum(likes).alias("likes_sum"),
        F.avg(likes).alias("likes_mean"), F.max(likes).alias("likes_max"),
        F.stddev_samp(likes).alias("likes_std"))
    pairs = lambda c, n: (comments.select(post, c).na.drop().distinct()
                          .groupBy(post).agg(F.count("*").alias(n)))
    return (base.join(pairs(user, "distinct_users"), post, "left")
            .join(pairs(language, "distinct_languages"), post, "left")
            .na.fill(0, ["distinct_users", "distinct_languages"]))


def tag_union(df: DataFrame, key: str, source: str, name: str = "sources") -> DataFrame:
    """Distinct source tags per key as one sorted text (few sources per key)."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ", ").alias(name))


def time_range_text(df: DataFrame, keys: Sequence[str], ts: str, name: str = "time_range") -> DataFrame:
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    return non_null(df, *keys).groupBy(*keys).agg(
        F.concat_ws(" - ", fmt(F.min(ts)), fmt(F.max(ts))).alias(name))


def histogram(df: DataFrame, col: str, bins: int, low: Column | None = None,
              high: Column | None = None) -> DataFrame:
    """Equal-width left-closed bins between the extremes; the maximum falls in the last bin."""
    base = df.filter(F.col(col).isNotNull())
    lo = scalar(base, F.min(col)) if low is None else low
    hi = scalar(base, F.max(col)) if high is None else high
    place = F.floor((F.col(col) - lo) / ((hi - lo) / F.lit(float(bins))))
    binned = base.filter(F.col(col).between(lo, hi)).select(
        F.when(hi == lo, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1))).cast("int").alias("bin"))
    out = binned.groupBy("bin").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / scalar(binned, F.count("*")))


def bin_means(df: DataFrame, x: str, y: str, bins: int = 19, low: float = 0.05,
              high: float = 0.95) -> DataFrame:
    """Right-closed equal-width bins of x between two quantiles; mean x and mean y per bin."""
    q_lo, q_hi = F.col("_q.p0"), F.col("_q.p1")
    inside = with_quantiles(df.select(x, y), df, x, [low, high]).filter(F.col(x).between(q_lo, q_hi))
    width = (q_hi - q_lo) / F.lit(float(bins))
    place = F.least(F.greatest(F.ceil(F.try_divide(F.col(x) - q_lo, width)), F.lit(1)), F.lit(bins))
    return (inside.withColumn("bin", F.coalesce(place, F.lit(1)).cast("int"))
            .withColumns({"bin_low": q_lo + (F.col("bin") - 1) * width, "bin_high": q_lo + F.col("bin") * width})
            .groupBy("bin").agg(F.min("bin_low").alias("bin_low"), F.max("bin_high").alias("bin_high"),
                                F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count("*").alias("n")))


def best_bin(df: DataFrame, x: str, y: str, bins: int = 100, low: float = 0.01,
             high: float = 0.99) -> DataFrame:
    """The bin with the greatest mean of y, as a printed range."""
    table = bin_means(df, x, y, bins, low, high)
    text = F.format_string("%.1f - %.1f", "bin_low", "bin_high")
    return table.agg(F.max_by(text, F.struct("mean_y", -F.col("bin"))).alias("best_range"),
                     F.max("mean_y").alias("best_mean"))


def mean_absolute(df: DataFrame, feature: str, value: str, n: int = 20) -> DataFrame:
    return (df.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs"))
            .orderBy(F.desc("mean_abs"), feature).limit(n))


def correlation_pairs(df: DataFrame, cols: Sequence[str], minimum: float = 0.7) -> DataFrame:
    """Column pairs (upper triangle) with an absolute Pearson correlation above ``minimum``.

    All correlations are ordinary aggregates of one pass over the table.
    """
    base = df.na.drop(subset=list(cols))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = base.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).filter(F.abs("corr") > minimum)


def retention(df: DataFrame, confidence: str, minimum: float) -> DataFrame:
    kept = F.count_if(F.col(confidence) >= minimum)
    return df.agg(F.count("*").alias("total"), kept.alias("kept"),
                  (F.count("*") - kept).alias("lost"), (kept * 100.0 / F.count("*")).alias("kept_pct"))


def pair_degrees(pairs: DataFrame, weight: str = "n", k: int = 20) -> DataFrame:
    """Summed weight of all pairs an item takes part in, top k."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("item"), F.col(weight).alias("_w"))
    return (ends.groupBy("item").agg(F.sum("_w").alias("degree"))
            .orderBy(F.desc("degree"), "item").limit(k))
