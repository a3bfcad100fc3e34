"""Joins beyond a plain ``DataFrame.join``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.operators.scale import row_positions, scalar
from vidtrend.session import cut_lineage


def left_join_hot_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join that stays balanced when one key fills much of the right side.

    Spark can split a skewed right side of an inner join but not of a left outer join, so the
    matched rows come from an inner join and the unmatched left rows from an anti join against
    the distinct keys.
    """
    matched = left.join(right, key)
    bare = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def share_tables_outer(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of per-period share tables, missing shares read as zero."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full_outer")
    return out.na.fill(0.0)


def in_keys(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def side_by_side(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column],
                 n: int) -> DataFrame:
    """Two top-n tables next to each other, joined by rank (n rows each)."""
    from pyspark.sql import Window
    rank = lambda df, order: (
        df.orderBy(*order).limit(n).withColumn(
            "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))))
    return rank(a, order_a).join(rank(b, order_b), "rank", "full_outer")


def pairs_in_group(df: DataFrame, group: str, item: str, min_support: int = 1,
                   heavy: int = 1_000) -> DataFrame:
    """Counts of item pairs (a < b) that share at least ``min_support`` groups.

    Items in fewer than ``min_support`` groups cannot be in a result pair and go first. Groups of
    up to ``heavy`` items are joined with themselves. With H larger groups, a pair qualifies only
    * if its count n in the small groups has n + H >= min_support: such pairs are looked up in
      the large groups by two equi-joins (nothing is paired there), or
    * if both items are in at least ``min_support`` large groups: only those items are paired
      inside large groups, cut into hash slices so that slice pairs spread over tasks.
    """
    rows = df.select(group, item).na.drop().distinct()
    rows = _frequent(rows, item, min_support)
    sized = cut_lineage(rows.join(rows.groupBy(group).agg(F.count("*").alias("_size")), group))
    light = sized.filter(F.col("_size") <= heavy).drop("_size")
    big = sized.filter(F.col("_size") > heavy).drop("_size")
    if not big.limit(1).count():
        return _light_pairs(light, group, item).filter(F.col("n") >= min_support)
    groups = F.coalesce(scalar(big, F.count_distinct(group)), F.lit(0))
    near = _light_pairs(light, group, item).filter(F.col("n") + groups >= min_support)
    in_big = (near.join(big.select(F.col(item).alias("a"), group), "a")
              .join(big.select(F.col(item).alias("b"), group), ["b", group])
              .groupBy("a", "b").agg(F.count("*").alias("_more")))
    near = (near.join(in_big, ["a", "b"], "left")
            .select("a", "b", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")))

    slices = 16
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    cut = _frequent(big, item, min_support).withColumn("_s", F.pmod(F.xxhash64(item), F.lit(slices)).cast("int"))
    left = cut.withColumn("_t", every)
    right = cut.select(group, F.col(item).alias("_b"), F.col("_s").alias("_t"), every.alias("_s"))
    far = (left.join(right, [group, "_s", "_t"]).filter(F.col(item) < F.col("_b"))
           .groupBy(F.col(item).alias("a"), F.col("_b").alias("b")).agg(F.count("*").alias("n"))
           .join(near, ["a", "b"], "left_anti"))
    return near.unionByName(far).filter(F.col("n") >= min_support)


def _light_pairs(light: DataFrame, group: str, item: str) -> DataFrame:
    other = light.select(group, F.col(item).alias("_b"))
    return (light.join(other, group).filter(F.col(item) < F.col("_b"))
            .groupBy(F.col(item).alias("a"), F.col("_b").alias("b")).agg(F.count("*").alias("n")))


def _frequent(rows: DataFrame, item: str, min_support: int) -> DataFrame:
    items = rows.groupBy(item).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_support)
    return rows.join(items.select(item), item, "left_semi")


def align_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables matched by their position in an explicit order."""
    left = row_positions(a, order_a, order_a, name="position")
    right = row_positions(b, order_b, order_b, name="position")
    return left.join(right, "position")
