"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from vidtrend.session import ensure_checkpoint_dir

#: The characters between words: \x20 and \x09 to \x0D, as a regular expression class.
BREAKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back: later steps restart from that copy."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, keep: list[str], text: str, per_text, schema: str) -> DataFrame:
    """Columns ``keep`` and the tuple ``per_text(text or "")`` of each row, in Arrow batches.

    ``schema`` names the new columns as DDL. ``per_text`` may be a factory result with a state that
    is local to a task; it sees one whole text at a time.
    """
    kept = numbered(df, keep, text)
    at = len(keep)
    if text in keep and dict(df.dtypes)[text] == "string":  # a kept text goes to Python once
        kept, at = kept.drop("text"), keep.index(text)
    new = StructType.fromDDL(schema)
    names, kinds, width = [*keep, *new.names], [to_arrow_type(f.dataType) for f in new], len(keep)

    def work(batches):
        run = per_text()
        for batch in slices(batches):
            rows = [run(t or "") for t in batch.column(at).to_pylist()]
            values = list(zip(*rows)) if rows else [[] for _ in kinds]
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(list(v), type=kind) for v, kind in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(work, StructType([*[df.schema[c] for c in keep], *new.fields]))


def numbered(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """The kept columns and then the text, under names that cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))


def partition_sums(df: DataFrame, per_batch, size: int):
    """Sum of the vectors of length ``size`` that ``per_batch`` returns, first inside each task.

    Only the final vector, whose length does not depend on the data, comes to the driver.
    """
    def work(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    rows = df.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for row in rows:
        out[row["at"]] = row["value"]
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text (0 for null), inside the JVM."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BREAKS))).cast("bigint")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``component`` (smallest node id reachable) for every node of an edge.

    Alternating large-star and small-star steps: each step points nodes at the smallest neighbour,
    so the edge count never grows beyond the first one and long chains shrink by halves. Each round
    is written to the shared folder; the loop ends when a round changes nothing. Grouping combines
    map-side and the join is split by the skew rule, so a node with very many edges is no single task.
    """
    # edges are far fewer than texts, so an eighth of the shuffle partitions holds a round
    few = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    pairs = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(few), "edges")
    before = state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large.coalesce(few), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        pairs = stored(small.coalesce(few), "small")
        now = state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def ordered_prefix(df: DataFrame, by: list[str], order: list[str], weight: str, name: str,
                   total: str) -> DataFrame:
    """Sum of ``weight`` before each row of its group, and the group's total, exactly.

    The first order column is a long that is spread evenly (a hash or a slot number already cut to
    buckets): rows are summed per (group, bucket), buckets are summed over at most one row per
    bucket, and only the inside of a bucket is windowed. ``_bucket`` must be a column of ``df``.
    """
    sums = df.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_sum"))
    per = Window.partitionBy(*by)
    upto = per.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"),
                       F.sum("_sum").over(per).alias(total))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(sums, [*by, "_bucket"])
            .withColumn(name, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("_bucket", "_offset"))

