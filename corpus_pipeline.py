"""A training corpus in five stages, each reading the Parquet that the stage before has written.

Toxic documents go; of each group of near-duplicates (five-word shingles, similarity 0.8) one document
stays; personal data is masked; the sources are mixed to their target weights; what is left becomes
token ids. Every stage but the last returns the columns of its input, which are at least ``doc_id``,
``text``, ``lang``, ``source`` and ``n_chars``.

Rows count, not ids: where a stage compares or counts rows, each has a number of its own, so rows that
share an id or have none are neither merged nor spared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtrend.llm import byte_bpe, personal_data, shingle_join, source_mix, toxicity
from vidtrend.llm.common import stored, table
from vidtrend.operators.scale import checked_broadcast

#: Not SQL: the stages hold fitted models and tokenizer merges.
ORACLE_SQL = None


#: An executor keeps its heap and its Python workers from stage to stage, so no stage may let them grow:
#: small Arrow batches, and few groups with lists at a time before an aggregate sorts.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
            "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8"}


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _settings(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def _numbered(docs: DataFrame) -> DataFrame:
    """A written copy of the table with a number for each row."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic; a null text is not toxic."""
    _settings(spark)
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "text", docs.columns, model, prefix="_pipeline_")
    return scored.filter("NOT _pipeline_toxic").select(*_columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows are compared by their texts alone: different texts under one id are different documents, and
    equal texts without id are copies. Of copies with one id the first read stays; documents with an
    id stay before those without. Documents without words stay.
    """
    _settings(spark)
    rows = _numbered(docs)
    groups = shingle_join.near_duplicates(rows, "_row", "text", width=5, similarity=(80, 100))
    members = stored(groups.select("_row", "component_id").join(rows.select("_row", "doc_id"), "_row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"), F.count("*").alias("_n"))
    others = members.join(first.filter("_n > 1"), "component_id").filter("_row <> _first._row").select("_row")
    return rows.join(checked_broadcast(stored(others, "others")), "_row", "left_anti").select(*_columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; null texts stay null."""
    _settings(spark)
    model = personal_data.fit(docs, "text")
    found = personal_data.annotate(docs, "text", model, name="_pipeline_pii")
    text = personal_data.masked(F.col("text"), F.col("_pipeline_pii"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies; documents that it does not take go.

    A document that the mix takes in part is taken whole, so that the one in which a source's target ends
    stays too; a source exceeds its words by less than that document.
    """
    _settings(spark)
    rows = _numbered(docs)
    verdict = source_mix.mix(rows, "_row", "source", "text")[1].filter("taken > 0")
    copies = verdict.select(F.col("doc_id").alias("_row"), F.expr("CAST((taken + size - 1) DIV size AS INT)").alias("_copies"))
    taken = rows.join(copies, "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*_columns(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to."""
    _settings(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = byte_bpe.read_ranks(lines)
    encoded = byte_bpe.encode(docs, "text", ["doc_id", "lang", "source"], ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, "ids", ranks))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
