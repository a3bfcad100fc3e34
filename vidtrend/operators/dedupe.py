"""Duplicate removal with an explicit survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.operators.scale import scalar, top_n


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order (the group is cut to one row before the shuffle)."""
    return top_n(df, keys, order, 1, "_rank").drop("_rank")


def distinct_pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).na.drop(subset=list(cols)).distinct()


def duplicate_rate(df: DataFrame, col: str) -> DataFrame:
    return df.agg((1 - F.count_distinct(col) / F.count(col)).alias("duplicate_rate"))


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows, the same for every partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


__all__ = ["keep_first", "distinct_pairs", "duplicate_rate", "sample_by_hash", "scalar"]
