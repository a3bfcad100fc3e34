"""Similarity join and substring index against brute force, with hot positions, hot grams and odd rows."""

import math
import random

import pytest

from vidtrend.operators import similarity, substrings
from vidtrend.plans import entities, keywords, topics


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb)


def pairs_by_hand(rows, minimum):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        for j, w in good:
            if i < j and len(v) == len(w) and cosine(v, w) > minimum:
                out[i, j] = cosine(v, w)
    return out


def vectors(kind, seed=3, n=160, width=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if kind == "dense":
            v = [rng.gauss(0, 1) + (3 if rng.random() < 0.3 else 0) for _ in range(width)]
        else:  # a third of the rows hold position 0, the others few positions each
            v = [0.0] * width
            for at in rng.sample(range(1, width), 2):
                v[at] = rng.choice([1.0, 2.0, 5.0])
            v[0] = rng.choice([0.0, 0.0, 1.0])
        rows.append((i, v))
    odd = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), [1.0] * (width + 1), [2.0] * (width + 1)]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(None, [1.0] * width)]


@pytest.mark.parametrize("kind", ["dense", "sparse"])
@pytest.mark.parametrize("minimum", [0.9, 0.5, -0.2])
def test_cosine_pairs_equal_brute_force(spark, kind, minimum):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = similarity.cosine_pairs(df, "id", "v", minimum, block=16, hot=20).collect()
    want = pairs_by_hand(rows, minimum)
    assert len(got) == len(want)  # each pair once, although rows share several lists
    assert {(r.a, r.b): r.cosine for r in got} == pytest.approx(want)


def test_cosine_pairs_of_an_empty_table_and_of_text_ids(spark):
    assert similarity.cosine_pairs(spark.createDataFrame([], "id int, v array<double>"), "id", "v", 0.9).count() == 0
    df = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [2.0, 0.0], 2), ("a", [3.0, 0.0], 3)], "id string, v array<double>, u int")
    assert sorted(map(tuple, topics.similar_pairs(df, "id", "v").collect())) == [("a", "b", 1.0), ("a", "b", 1.0)]


def test_more_topics_than_one_array_would_hold(spark):
    n = 6000
    df = spark.range(n).selectExpr("id", "array(cos(id * 0.0005), sin(id * 0.0005)) AS v")
    got = topics.similar_pairs(df, "id", "v", math.cos(0.00125))
    assert got.count() == (n - 1) + (n - 2)  # the next two rows are near enough


TEXTS = [(1, "the cat sat"), (2, "concatenate"), (3, None), (4, ""), (5, "\U0001F600a cat\U0001F600"), (6, "the cat sat"), (7, "x" * 3000 + "cat")]
TERMS = ["cat", "the cat", "x", "\U0001F600", "\U0001F600a c", "sat ", "zebra", "", None, "cat", "xxxxxxxxcat"]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contained_terms_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(*r, "k") for r in TEXTS], "id int, t string, _extra string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = sorted((i, t) for i, s in TEXTS for t in set(TERMS) if s and t and t in s)
    got = substrings.contained_terms(df, "t", terms)
    assert got.columns == ["id", "t", "_extra", "term"]
    assert sorted((r.id, r.term) for r in got.collect()) == want
    assert substrings.contained_terms(df, "t", terms.limit(0)).collect() == []
    assert substrings.contained_terms(df.limit(0), "t", terms).collect() == []


def test_mentions_of_many_terms(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(2500)})
    assert len(terms) > 1000
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {t: n for t in terms if (n := sum(t in s for s in texts)) >= 3}
    assert {r.term: r.mentions for r in keywords.mentions(df, "t", table).collect()} == want
    few = terms[:900]
    assert {r.term: r.mentions for r in keywords.mentions(df, "t", table.filter(table.term.isin(few))).collect()} == {t: n for t, n in want.items() if t in set(few)}


@pytest.mark.parametrize("whole_word", [True, False])
def test_dictionary_longer_than_a_literal(spark, monkeypatch, whole_word):
    terms = {f"name{i}": [f"term{i}", f"two-part{i}"] for i in range(40)} | {"both": ["term7"], "signs": ["!!"]}
    texts = [(1, "x Term7 two-part9, term7 !!"), (2, "aterm7"), (3, None), (4, "term39 TERM3 it’s"), (5, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    rows = lambda: sorted((r.id, r.entity) for r in entities.matched(df, "t", terms, whole_word).collect())
    short = rows()
    monkeypatch.setattr(entities, "MAX_LITERAL_TERMS", 10)
    assert short and rows() == short


def test_coherence_has_no_limit_of_words(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "b"]), (3, ["c"]), (4, ["d", "c"])], "id int, tokens array<string>")
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "a"), (2, "zz")], "topic int, word string")
    got = {r.topic: r.coherence for r in topics.coherence(df, "id", "tokens", words).collect()}
    assert got == pytest.approx({0: 1.0, 1: math.log(4 / 2) / math.log(4), 2: -1.0})
