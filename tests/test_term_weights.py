"""TF-IDF by blocks against plain Python, and what it writes."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest

from vidtrend.operators import term_weights
from vidtrend.plans import keywords
from pyspark.sql import functions as F


def texts(count, seed, words=60, long=25):
    draw = random.Random(seed)
    return [" ".join(f"w{int(draw.paretovariate(0.7)) % words}" for _ in range(draw.randrange(long))) for _ in range(count)]


def by_hand(rows, low, high):
    """Weights of ``(by, doc, term)`` from rows ``by, doc, tokens``."""
    tf, docs = defaultdict(Counter), Counter()
    for by, doc, tokens in rows:
        if by is not None:
            docs[by] += 1
            for n in range(low, high + 1):
                tf[by, doc].update(" ".join(tokens[i:i + n]) for i in range(len(tokens or ()) - n + 1))
    df = Counter((by, t) for (by, _), counts in tf.items() for t in counts)
    out = {}
    for (by, doc), counts in tf.items():
        w = {t: c * (math.log((docs[by] + 1) / (df[by, t] + 1)) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(by, doc, t): x / norm for t, x in w.items()}
    return out


def table(spark):
    rows = [(i % 3 if i % 17 else None, None if i % 29 == 0 else i // 2 if i % 5 == 0 else i, t.split()) for i, t in enumerate(texts(160, 4))]
    rows += [(1, 900, None), (1, 901, []), (2, 902, ["a b", "c"]), (2, 903, ["a", "b c"]), (0, 904, ["x" * 50_000] * 3), (0, 905, ["ÿ", "ß", "ÿ"] * 2)]
    return rows, spark.createDataFrame(rows, "by int, doc int, ts array<string>").repartition(5)


@pytest.mark.parametrize("block,hashes", [(40, 30), (1 << 19, 1 << 20)])
def test_weights_match_brute_force(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(term_weights, "BLOCK_GRAMS", block)
    monkeypatch.setattr(term_weights, "RANGE_HASHES", hashes)
    rows, df = table(spark)
    for low, high in ((2, 3), (1, 2)):
        want = by_hand(rows, low, high)
        got = {(r.by, r.doc, r.term): r.weight for r in keywords.tfidf(df, "doc", F.col("ts"), low, high, ["by"]).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("spare", [1, 64])
def test_best_terms_are_proven(spark, monkeypatch, spare):
    monkeypatch.setattr(term_weights, "BLOCK_GRAMS", 200)
    monkeypatch.setattr(term_weights, "SPARE", spare)
    rows, df = table(spark)
    for by, top in ((["by"], 4), ([], 5), ([], 100_000)):
        totals = defaultdict(Counter)
        for (b, _, t), w in by_hand([(b if by else 0, d, t) for b, d, t in rows], 2, 3).items():
            totals[b][t] += w
        want = {(b, t): s for b, c in totals.items() for t, s in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]}
        got = {(r.by if by else 0, r.term): r.score for r in term_weights.best_terms(df, "doc", F.col("ts"), 2, 3, top, by).collect()}
        assert len(got) == len(want) and sorted(got.values()) == pytest.approx(sorted(want.values()))
        assert all(totals[b][t] == pytest.approx(s) for (b, t), s in got.items())


def test_no_texts(spark):
    df = spark.createDataFrame([], "by int, doc int, ts array<string>")
    assert term_weights.best_terms(df, "doc", F.col("ts"), 2, 3, 5).count() == 0 and keywords.tfidf(df, "doc", F.col("ts"), 1, 1).count() == 0


def held(spark):
    top = spark.sparkContext.getCheckpointDir()
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top.removeprefix("file:")) for f in names) if top else 0


def test_top_terms_do_not_write_a_row_per_occurrence(spark):
    rows = list(enumerate(texts(1_500, 9, 4_000, 200)))
    df, before = spark.createDataFrame(rows, "id int, t string"), held(spark)
    got = keywords.tfidf_top(df, "id", F.split("t", " "), max_features=None).collect()
    assert len(got) == 20 and held(spark) - before < 2 * sum(len(t) for _, t in rows)


def test_weekly_terms_do_not_write_a_row_per_occurrence(spark):
    rows = [(i, t.replace("w", "word"), i % 28) for i, t in enumerate(texts(1_500, 9, 4_000, 200))]
    df = spark.createDataFrame(rows, "post_id int, t string, day int").selectExpr("post_id", "t", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day) AS createTimeISO")
    before = held(spark)
    got = keywords.weekly_tfidf(df, col="t", max_features=None).collect()
    assert len({r.week for r in got}) == 4 and held(spark) - before < 2 * sum(len(t) for _, t, _ in rows)
