"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Each source gets a target of words by weight, capped at ``max_repeats`` times its size, the excess
being shared again by weight. A target is cut into slots of ``block_words`` words. The slots of all
sources lie side by side on one line, as long as their cumulative weights; van der Corput points
(numbers in bit-reversed order) are mapped onto that line, so any stretch of the schedule holds
every source near its weight. The slots of a source are ranked in schedule order, and rank r takes
block r of the source's stream: its documents in shuffled order, again from the start when all are
used, cut into blocks of equally many words. So each source contributes its target exactly, and no
document is taken more than ``max_repeats`` times.

Scale: one pass over the texts counts words; what is shuffled afterwards are ids and numbers.
Positions inside a source and ranks are two-level sums (``ordered_prefix``): a source with a third
of all rows is spread over hash buckets of about ``BUCKET_ROWS`` rows. Blocks and slots join on
(source, block), a key of bounded rows. The sources themselves, one row each, are numbered in one
window: a mixture lists its sources.

Defined results: a null text has no words, and a document without words is not taken; a null source
is a source of its own, listed last. Rows that repeat a doc_id are mixed row by row. Extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.llm.common import ordered_prefix, stored, word_count
from vidtrend.operators.scale import checked_broadcast

BUCKET_ROWS = 4096
SLOTS_PER_ROW = 4096


def targets(sized: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: number, size, target (double) and words to take (long)."""
    rows = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    rows = rows.withColumn("source_no", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1))
    cap = (F.col("source_size") * max_repeats).cast("double")
    # sources in the order in which they fill up: before a source all earlier ones are at their cap
    filling = Window.orderBy(cap / F.col("weight"), "source_no")
    before = F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before) / after
    rows = rows.withColumn("level", level).withColumn(
        "target", F.least(cap, F.col("weight") * F.max("level").over(every)))
    return rows.select("_source", "source_no", "source_size", "weight", "target",
                       F.floor(F.col("target") + 0.5).cast("bigint").alias("take"))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots ``slot, source_no, rank`` in schedule order; rank counts the slots of a source from 0."""
    slots = F.ceil(F.col("take") / block_words).cast("bigint")
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = sources.select("source_no", slots.alias("n")).filter("n > 0").withColumn(
        "start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (total - 1).bit_length())
    bucket_bits = max(0, (total // BUCKET_ROWS).bit_length())
    pieces = lines.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {SLOTS_PER_ROW}")))).repartition("source_no", "piece")
    places = pieces.select("source_no", F.explode(F.sequence(
        F.col("start") + F.col("piece") * SLOTS_PER_ROW,
        F.col("start") + F.least(F.col("n"), (F.col("piece") + 1) * SLOTS_PER_ROW) - 1)).alias("place"))
    # the van der Corput point of a number is its digits reversed; reversing is its own inverse
    digits = F.reverse(F.lpad(F.bin("place"), bits, "0"))
    slotted = places.select("source_no", F.conv(digits, 2, 10).cast("bigint").alias("slot"), F.lit(1).alias("one"))
    slotted = stored(slotted.withColumn("_bucket", F.shiftright("slot", max(0, bits - bucket_bits))), "slots")
    return ordered_prefix(slotted, ["source_no"], ["slot"], "one", "rank", "_n").select("slot", "source_no", "rank")


def streams(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Documents with the place of their first word in the shuffled stream of their source."""
    rows = sized.count()
    bucket_bits = max(0, (rows // BUCKET_ROWS).bit_length())
    mark = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    known = sized.join(checked_broadcast(sources), sized["_source"].eqNullSafe(sources["_source"])).select(
        "_id", sized["_source"], "_size", "source_no", "source_size", "target", "take", mark.alias("_mark"))
    known = known.withColumn("_bucket", F.shiftright(
        F.conv(F.substring("_mark", 1, 8), 16, 10).cast("bigint"), 32 - bucket_bits))
    return ordered_prefix(stored(known, "marked"), ["source_no"], ["_mark", "_id", "_size"], "_size", "start",
                          "_total").drop("_mark", "_total")


def blocks(placed: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents in equal blocks of their source's repeated stream."""
    epochs = placed.filter("_size > 0 AND start < take").withColumn("epoch", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr("(take - start - 1) div source_size"))))
    spans = epochs.withColumn("low", F.expr("start + epoch * source_size")).withColumn(
        "high", F.expr("least(low + _size, take)"))
    cut = spans.withColumn("block", F.explode(F.sequence(
        F.expr(f"low div {block_words}"), F.expr(f"(high - 1) div {block_words}"))))
    return cut.select("source_no", "block", "_id", "start", "epoch",
                      F.expr(f"greatest(low, block * {block_words}) - low").alias("from_word"),
                      F.expr(f"least(high, (block + 1) * {block_words}) - low").alias("to_word"))


def mix(docs: DataFrame, id_col: str, source_col: str, text: str | Column, weights: Sequence[int] = (1, 2, 3),
        max_repeats: int = 3, block_words: int = 1024, seed: str = "mix:") -> tuple[DataFrame, DataFrame]:
    """The mixture and the verdict on each document.

    The mixture has ``slot, source_no, rank, doc_id, from_word, to_word``: words ``from_word`` to
    ``to_word`` (exclusive) of a document, in the order of ``slot``. The verdict has ``doc_id, source,
    size, source_size, target, taken``, a row for each input row.
    """
    text = F.col(text) if isinstance(text, str) else text
    sized = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                               word_count(text).alias("_size")), "sized")
    sources = stored(targets(sized, weights, max_repeats), "sources")
    placed = stored(streams(sized, sources, seed), "placed")
    slots = schedule(sources, block_words)
    pieces = blocks(placed, block_words)
    mixture = stored(slots.join(pieces, (slots["source_no"] == pieces["source_no"]) & (slots["rank"] == pieces["block"]))
                     .select("slot", slots["source_no"], "rank", "_id", "start", "from_word", "to_word"), "mixture")
    taken = mixture.groupBy("source_no", "start").agg(F.sum(F.expr("to_word - from_word")).alias("taken"))
    full = placed.filter("_size > 0").join(taken, ["source_no", "start"], "left").unionByName(
        placed.filter("_size = 0").withColumn("taken", F.lit(0).cast("bigint")))
    verdict = full.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
                          "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return mixture.withColumnRenamed("_id", "doc_id").drop("start"), verdict


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0
             ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
s1 AS (SELECT *, CAST([1, 2, 3][CAST(no % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM s2),
p AS (SELECT d.doc_id, d.size, s.source_size, s.target, CAST(floor(s.target + 0.5) AS BIGINT) AS take,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (take // source_size) + greatest(0, least(start + size, take % source_size) - start) END AS BIGINT) AS taken
FROM p
"""
