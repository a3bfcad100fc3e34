"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vidtrend.llm import (byte_bpe, capture_index, compression_bands, license_scan, merkle_manifest, personal_data, quality_score, shingle_join,
                          source_mix, spelling_variants, toxicity, unigram_count, vector_top_k)
from vidtrend.llm.common import table
from vidtrend.llm.registry import query


@query("op1_compression_bands")
def op1(spark, folder):
    return compression_bands.compression_rules(table(spark, folder, "documents"), "text", ["doc_id"])


OP8_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_top_k", OP8_SQL)
def op8(spark, folder):
    return vector_top_k.top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def _ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return byte_bpe.read_ranks(lines)


@query("op9_byte_bpe")
def op9(spark, folder):
    ranks = _ranks()
    encoded = byte_bpe.encode(table(spark, folder, "documents"), "text", ["doc_id"], ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, "ids", ranks)).drop("ids")


@query("op10_unigram_counts")
def op10(spark, folder):
    pieces, unknown = unigram_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_count.token_counts(table(spark, folder, "documents"), "text", ["doc_id"], pieces, unknown)


@query("op3_source_mix", source_mix.SQL)
def op3(spark, folder):
    return source_mix.mix(table(spark, folder, "documents"), "doc_id", "source", "text")[1].drop("source")


@query("op4_warc_capture_index", capture_index.SQL)
def op4(spark, folder):
    captures, archives = capture_index.write_archives(table(spark, folder, "pages"), "page_id", "url", "html")
    shards, index = capture_index.build_index(captures)
    found = capture_index.lookup(captures.select("key", "page_id").distinct(), shards, index)
    return capture_index.read_records(found, archives)


@query("op2_fourier_quality")
def op2(spark, folder):
    return quality_score.quality(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text", "quality")


@query("op6_ordinal_toxicity")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train_model(docs, table(spark, folder, "labels"), "doc_id", "text", "toxic")
    return toxicity.score(docs, "text", ["doc_id"], model)


@query("op7_shingle_join", shingle_join.SQL)
def op7(spark, folder):
    return shingle_join.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")


@query("op5_weak_personal_data")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return personal_data.report(personal_data.annotate(docs, "text", personal_data.fit(docs, "text")), ["doc_id"])


@query("op11_merkle_manifest", merkle_manifest.SQL)
def op11(spark, folder):
    return merkle_manifest.tampered_report(table(spark, folder, "documents"))


@query("op13_license_scan", license_scan.SQL)
def op13(spark, folder):
    return license_scan.scan(table(spark, folder, "documents"), "text", ["doc_id"])


@query("op12_spelling_variants", spelling_variants.SQL)
def op12(spark, folder):
    return spelling_variants.variants(table(spark, folder, "documents"), "doc_id", "text")
