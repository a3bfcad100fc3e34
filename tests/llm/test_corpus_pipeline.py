"""The pipeline on a small table, stage by stage against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from llm_cases import ODD, prose, rows

import __spark_entry__
import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, _text string, size int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(1)
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, prose(i, 60)) for i in range(200)]
    toxic = [(1000 + i, prose(1000 + i, 30) + " scumbag vermin " + prose(2000 + i, 30) + " scumbag") for i in range(60)]
    copies = [(3000 + i, clean[i % 5][1] + (" tail" if i % 2 else "")) for i in range(30)]
    people = [(4000 + i, prose(4000 + i, 20) + f" me{i}@mail.org and 10.0.0.{i}") for i in range(20)]
    every = [*clean, *toxic, *copies, *people, *[(i and 9000 + i, t) for i, t in ODD]]
    data = [(*r[:3], draw.choice(["a", "b", "c", None]), *r[4:]) for r in rows(every)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != "byte_bpe":
            assert docs.columns == columns
    kept = {r.doc_id for r in seen["toxicity"]}
    assert not kept & set(range(1000, 1060)) and kept >= set(range(200)) | set(range(3000, 3030))
    one = {r.doc_id for r in seen["near_duplicates"]}
    assert not one & set(range(3000, 3030)) and one >= set(range(200)) | {9001, 9002, 9003, 9004, 9005, None}
    assert Counter(r.doc_id for r in seen["near_duplicates"])[9008] == 1
    masked = {r.doc_id: r for r in seen["personal_data"]}
    assert masked.keys() == one and masked[4007].text.endswith("[EMAIL] and [IP]")
    assert all(r.n_chars == len(r.text) for r in masked.values() if r.text is not None) and masked[0].text == prose(0, 60)
    copies = Counter(r.doc_id for r in seen["source_mix"])
    assert set(copies) <= one and max(copies.values()) <= 3
    for r, before in zip(sorted(seen["byte_bpe"], key=str), range(len(seen["byte_bpe"]))):
        assert r.n_tokens == len(r.ids) // 4
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in seen["source_mix"])
    assert texts == Counter((r.doc_id, r.decoded_sha256) for r in seen["byte_bpe"])


def test_run_equals_its_stages_and_empty_tables(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 100 and {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_own_ids_are_neither_lost_nor_spared(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    texts = [prose(i, 40) for i in range(6)]
    data = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (8, texts[4]), (None, texts[4]), (9, texts[5]), (9, texts[5])]
    data += [(None, None), (None, ""), (5, None)]
    docs = spark.createDataFrame(rows(data), DOCS)
    one = stages["near_duplicates"](spark, docs, folder)
    assert one.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in one.collect())
    assert kept == Counter({(7, texts[0]): 1, (7, texts[1]): 1, (None, texts[2]): 1, (None, texts[3]): 1, (8, texts[4]): 1, (9, texts[5]): 1,
                            (None, None): 1, (None, ""): 1, (5, None): 1})


def test_mix_takes_whole_rows_and_leaves_no_source_empty(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    data = [(None, " ".join(["w"] * 8), "en", "b", 0, "x", "y", 7)] * 10 + [(1, " ".join(["v"] * 400), "en", "a", 0, "x", "y", 7)]
    mixed = stages["source_mix"](spark, spark.createDataFrame(data, DOCS), folder).collect()
    # a: 160 of 400 words wanted, in its only document; b: 320 of 80 wanted, cut to 240
    assert Counter(r.source for r in mixed) == {"a": 1, "b": 30}


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "byte_bpe"]
