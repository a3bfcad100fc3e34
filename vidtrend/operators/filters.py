"""Row filters. Cutoffs come from a required ``as_of`` or from the data, never from the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import fixed, text
from vidtrend.operators.scale import exact_quantiles, scalar, with_quantiles


def since(df: DataFrame, col: str = "createTimeISO", start: str = "2025-02-17") -> DataFrame:
    """Rows from ``start`` on, with the calendar ``date`` added."""
    return df.filter(F.col(col) >= F.lit(start).cast("timestamp_ntz" if _is_ntz(df, col) else "timestamp")
                     ).withColumn("date", F.to_date(col))


def _is_ntz(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] == "timestamp_ntz"


def recent_days(df: DataFrame, col: str = "createTimeISO", days: int = 30, as_of=None) -> DataFrame:
    """The last ``days`` days up to ``as_of``, or up to the newest row when it is not given."""
    anchor = _anchor(df, col, as_of)
    return df.filter(F.col(col) >= anchor - F.expr(f"INTERVAL {int(days)} DAYS")).withColumn(
        "date", F.to_date(col))


def recent_months(df: DataFrame, col: str, months: int, as_of=None) -> DataFrame:
    anchor = _anchor(df, col, as_of)
    return df.filter(F.col(col) >= anchor - F.expr(f"INTERVAL {int(months)} MONTHS"))


def _anchor(df: DataFrame, col: str, as_of) -> Column:
    if as_of is None:
        return scalar(df, F.max(col))
    kind = dict(df.dtypes)[col]
    return F.lit(as_of).cast(kind)


def languages(df: DataFrame, col: str = "textLanguage", allowed: Sequence[str] = ("en", "de")) -> DataFrame:
    return df.filter(F.col(col).isin(list(allowed)))


def equals(df: DataFrame, **values) -> DataFrame:
    for col, value in values.items():
        df = df.filter(F.col(col) == value)
    return df


def played_text(df: DataFrame, col: str = "text", plays: str = "playCount", more_than: int = 0) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(plays) > more_than))


def complete(df: DataFrame, *cols: str) -> DataFrame:
    return df.na.drop(subset=list(cols))


def date_range(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    if start > end:
        raise ValueError("start date is after end date")
    low, high = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    return df.filter((F.col(col) >= low) & (F.col(col) < high))  # the raw column, so that the scan can prune


def group_size(df: DataFrame, keys: Sequence[str], minimum: int, strict: bool = False) -> DataFrame:
    """Keys with at least (or more than) ``minimum`` rows, with their row count ``n``."""
    counts = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > minimum if strict else F.col("n") >= minimum)


def trim_quantiles(df: DataFrame, cols: Sequence[str], low: float = 0.05, high: float = 0.95,
                   positive: bool = False) -> DataFrame:
    """Rows with every column inside its [low, high] quantile range; null rows are dropped.

    Bounds are those of the untrimmed table.
    """
    out = df
    for c in cols:
        out = with_quantiles(out, df, c, [low, high]).filter(F.col(c).between(F.col("_q.p0"), F.col("_q.p1"))).drop("_q")
        if positive:
            out = out.filter(F.col(c) > 0)
    return out


def below_quantile(df: DataFrame, col: str, prob: float = 0.99, positive: bool = False) -> DataFrame:
    keep = F.col(col) < exact_quantiles(df, col, [prob]).scalar()
    return df.filter(keep & (F.col(col) > 0) if positive else keep)


def iqr_fence(df: DataFrame, col: str, width: float = 1.5) -> DataFrame:
    q1, q3 = F.col("_q.p0"), F.col("_q.p1")
    fenced = with_quantiles(df, df, col, [0.25, 0.75])
    return fenced.filter(F.col(col).between(q1 - width * (q3 - q1), q3 + width * (q3 - q1))).drop("_q")


def columns_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def mask_low_volume(df: DataFrame, col: str, volume: str, minimum: int = 20) -> DataFrame:
    return df.withColumn(col, F.when(F.col(volume) >= minimum, F.col(col)))


def drop_spam(df: DataFrame, col: str = "comment", phrases: Sequence[str] = tuple(fixed.SPAM_PHRASES),
              word: str = fixed.SPAM_WORD, at_most: int = 1) -> DataFrame:
    lowered = F.lower(F.trim(F.col(col)))
    count = F.regexp_count(lowered, F.lit(rf"\b{word}\b"))
    return df.filter(~text.contains_any(lowered, phrases) & (count <= at_most))


def drop_repetitive(df: DataFrame, col: str, times: int = 5, max_words: int = 100) -> DataFrame:
    return df.filter((F.size(text.whitespace_tokens(col)) < max_words)
                     & ~text.has_repeated_word(col, times))


def token_count(df: DataFrame, col: str, low: int, high: int | None = None) -> DataFrame:
    n = F.size(text.whitespace_tokens(col))
    return df.filter(n >= low if high is None else n.between(low, high))


def drop_thrice_repeated(df: DataFrame, col: str) -> DataFrame:
    return df.filter(~text.thrice_repeated(col))


def drop_non_informative(df: DataFrame, col: str,
                         patterns: Sequence[str] = tuple(fixed.NON_INFORMATIVE)) -> DataFrame:
    return df.filter(~text.matches_any(col, patterns))


def drop_off_topic(df: DataFrame, col: str, terms: Sequence[str] = tuple(fixed.OFF_TOPIC)) -> DataFrame:
    return df.filter(~text.contains_any(col, terms))


def confident_topics(df: DataFrame, topic: str = "topic", probability: str = "probability",
                     minimum: float = 0.7) -> DataFrame:
    return df.filter((F.col(topic) != -1) & (F.col(probability) > minimum))


def exclude(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.filter(~F.lower(F.col(col)).isin([v.lower() for v in values]))


def varied_phrases(df: DataFrame, col: str, banned: Sequence[str] = ()) -> DataFrame:
    keep = text.distinct_words(col) > 1
    return df.filter(keep & ~text.contains_any(col, banned) if banned else keep)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.trim(F.col(col)) != "")


def zero_shares(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows with a zero per metric and their share."""
    long = df.select(*metrics).unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(
        F.count_if(F.col("value") == 0).alias("zero_rows"), F.count("*").alias("row_count")
    ).withColumn("zero_share", F.col("zero_rows") / F.col("row_count"))


def quantile_keys(df: DataFrame, key: str, prob: float) -> DataFrame:
    """Keys whose row count reaches the given quantile of all key counts."""
    counts = df.na.drop(subset=[key]).groupBy(key).agg(F.count("*").alias("n"))
    cut = exact_quantiles(counts, "n", [prob], names=["cut"]).scalar()
    return counts.filter(F.col("n") >= cut)
