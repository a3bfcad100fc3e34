"""Plans and results of the operators that were rewritten for larger tables."""

import random

from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.plans import keywords


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def prose(n, seed=1, words=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "red", "fox", "ran", "home", "it’s", "x1", "a.b", "not", "!"]) for _ in range(rng.randint(0, words))) for _ in range(n)]


def test_rake_scores_a_text_in_its_row_and_shared_ids_together(spark):
    texts = prose(60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[7]), (3, texts[3]), (4, None), (None, texts[5]), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    marked = F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}_'\s]+", " | ")
    words = F.transform(text.whitespace_tokens(marked), lambda w: F.when(w.isin(["the", "not"]), "|").otherwise(w))
    runs = F.filter(F.transform(F.split(F.array_join(words, " "), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    show = lambda out: sorted((r.id, r["rank"], r.at, r.phrase, round(r.score, 6)) for r in out.collect())
    got = keywords.rake(df, "id", "t", ["the", "not"])
    assert got.columns == ["id", "at", "phrase", "score", "rank"]
    assert show(got) == show(keywords._rake_by_id(df, "id", runs, 3)) and len(show(got)) > 100
    alone = keywords.rake(df.filter("id > 4"), "id", "t", ["the", "not"])
    assert "Join" not in plan(alone) and "Aggregate" not in plan(alone)


def test_week_shares_shuffle_no_n_gram_with_its_week(spark):
    df = spark.createDataFrame([(i, t, f"2024-0{1 + i % 3}-01") for i, t in enumerate(prose(80))] + [(99, "red fox ran", None)], "id int, t string, d string")
    df = df.withColumn("ts", F.to_timestamp("d"))
    got = keywords.gram_week_shares(df, F.split("t", " "), "ts", "id", 2, 4)
    counted = got._jdf.queryExecution().analyzed().toString()
    rows = [(r.id, r.t.split(" "), r.d) for r in df.collect()]
    pairs = [(d, f"{a} {b}") for _, ws, d in rows for a, b in zip(ws, ws[1:])]
    total = {g: sum(p[1] == g for p in pairs) for _, g in pairs}
    top = sorted(total, key=lambda g: (-total[g], g))[:4]
    want = {(d, g): pairs.count((d, g)) for d in ("2024-01-01", "2024-02-01", "2024-03-01") for g in top}
    seen = {(r.week, r.gram): (r.n, r.posts) for r in got.collect()}
    weeks = {d: spark.sql(f"SELECT CAST(date_trunc('week', DATE'{d}') AS DATE) w").first().w for d in ("2024-01-01", "2024-02-01", "2024-03-01")}
    assert seen == {(weeks[d], g): (n, sum(r[2] == d for r in rows)) for (d, g), n in want.items() if n}
    assert "Aggregate [gram" in counted  # counted without weeks first


def test_letter_tokens_of_any_case(spark):
    samples = ["Über-Maß the CAT1cat", "ÄÖÜ äİx KELVINK sign", "", None, "a  b\tccc\U0001F600ddd"]
    df = spark.createDataFrame([(t,) for t in samples], "t string").select(
        text.letter_tokens("t").alias("got"), text.keep_tokens(F.split(F.trim(F.regexp_replace(F.lower("t"), "[^a-zA-Zäöüß]+", " ")), " "), (), 3).alias("want"))
    assert all(r.got == r.want for r in df.collect())
    assert "A-Z" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_terms_without_white_space_are_looked_up_in_runs(spark, monkeypatch):
    from vidtrend.operators import substrings
    monkeypatch.setattr(substrings, "REMEMBERED", 3)
    monkeypatch.setattr(substrings, "LONGEST", 8)
    texts = prose(50, 4) + ["x" * 500 + "fox", " fox red", "foxfox", None, "", "a fox\nran"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    terms = ["fox", "ox", "f", "red", "foxf", "it’s", "zebra", "xxfox", "e"]
    got = substrings.contained_terms(df, "t", spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted((r.id, r.term) for r in got.collect()) == sorted((i, t) for i, s in enumerate(texts) for t in terms if s and t in s)
    assert "Join" not in plan(got)


def test_a_scorer_gets_few_texts_at_a_time(spark):
    import pandas as pd

    from vidtrend.plans import sentiment
    limit = sentiment.SCORED_ROWS

    def load():
        def apply(texts):
            if len(texts) > limit:
                raise ValueError("too many")
            return pd.DataFrame({"sentiment": ["positive"] * len(texts), "confidence": [0.9] * len(texts)})
        return apply
    df = spark.range(3 * limit + 5).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, 'a') t", "timestamp_ntz'2024-01-01' AS at")
    rows = sentiment.score(df, "t", load).collect()
    assert [r.id for r in rows] == list(range(3 * limit + 5)) and {(r.raw_sentiment, r.confidence) for r in rows} == {("positive", 0.9)}
    assert {str(r["at"]) for r in rows} == {"2024-01-01 00:00:00"}


def vectors_of(spark, n=130):
    import numpy as np
    draw = np.random.default_rng(5)
    u = draw.normal(size=(n, 6)) + np.array([2.0, 0, 0, 0, 0, 0]) * (np.arange(n) % 2)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u, spark.createDataFrame([(i, v.tolist(), float(0.3 + 0.01 * (i % 9))) for i, v in enumerate(u)], "p bigint, u array<double>, core double")


def test_block_pairs_keep_the_nearest_and_a_spanning_forest(spark, monkeypatch):
    import numpy as np

    from vidtrend.operators import similarity
    from vidtrend.plans import density
    monkeypatch.setattr(similarity, "TILE", (7, 11))
    monkeypatch.setattr(similarity, "GATHERED", 20)
    u, df = vectors_of(spark)
    d = np.sqrt(np.maximum(2 - 2 * (u @ u.T), 0))
    linked = [(i, j) for i in range(len(u)) for j in range(len(u)) if i != j and u[i] @ u[j] > 0.4]
    got = similarity.nearest(df, "p", "u", 0.4, 3, block=40, hot=20).collect()
    want = {i: sorted((round(d[i, j], 9), j) for p, j in linked if p == i)[:3] for i in range(len(u))}
    first = {i: sorted((round(r.d, 9), r.q) for r in got if r.p == i)[:3] for i in range(len(u))}
    assert first == want and len(got) < len(linked)
    core = [0.3 + 0.01 * (i % 9) for i in range(len(u))]
    edges = [(i, j, max(float(d[i, j]), core[i], core[j])) for i, j in linked if i < j]
    some = similarity.forest_edges(df, "p", "u", "core", 0.4, block=40, hot=20)
    assert some.count() < len(edges)
    trees = [density.spanning_forest(e).collect() for e in (some, spark.createDataFrame(edges, "a bigint, b bigint, w double"))]
    assert {(r.a, r.b) for r in trees[0]} == {(r.a, r.b) for r in trees[1]}


def test_blocks_are_as_large_as_a_task_may_hold(spark):
    from vidtrend.operators import similarity
    n = 30_000
    df = spark.range(n).selectExpr("id", "array(cos(id * 0.0002), sin(id * 0.0002)) AS v")
    met = similarity._met(df, "id", "v", 0.9, None, 2048)
    assert met.filter("key = -1").count() == 16 * 17 // 2  # of 512 rows each, there were 1,770 pairs


def test_word_vectors_train_in_more_than_one_task(spark):
    from vidtrend.plans import topics
    df = spark.createDataFrame([(t.split(" "),) for t in prose(30)], "tokens array<string>")
    model = topics.word_vectors(df, "tokens", size=4, iterations=1)
    assert model.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert model.transform(df).count() == 30


def test_trigrams_are_counted_as_the_hasher_does_and_without_strings(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF, NGram
    from pyspark.sql import functions as F

    from vidtrend.plans import language
    for name, value in {"CHARS": 90, "TEXTS": 3, "REMEMBERED": 50, "TABLE": 9000}.items():
        monkeypatch.setattr(language, name, value)
    texts = [*prose(20, 5), "Hello, World!! été 12 ça", "", "a", "ab", "漢字かな交じり文 𝒳𝒴𝒵 ÅÄÖ", "  ", "the the " * 50, "Ünïcödé" + "x" * 300, "İstanbul"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(2)
    chars = df.withColumn("c", F.split(F.concat(F.lit("_"), F.regexp_replace(F.lower("t"), r"[^\p{L}]+", "_"), F.lit("_")), ""))
    grams = NGram(n=3, inputCol="c", outputCol="g").transform(chars)
    want = {r.id: r.f for r in HashingTF(inputCol="g", outputCol="f", numFeatures=4096).transform(grams).collect()}
    assert {r.id: r.features for r in language._trigrams(df, "t", 4096).collect()} == want
    known = df.unionByName(spark.createDataFrame([(99, None)], "id int, t string")).withColumn("l", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    model = language.train(known, "t", "l")
    assert not any(isinstance(s, (HashingTF, NGram)) for s in model.stages)
    silent = {i for i, t in enumerate(texts) if not any(c.isalpha() for c in t)}
    assert {r.id for r in language.detect(model, known, "t").collect() if r.detected_language is None} == silent | {99}


def test_match_rows_makes_only_runs_that_start_like_a_term(spark, monkeypatch):
    from vidtrend.plans import entities
    texts = [*prose(60, 6), "the red", "THE  red-fox ran", "", None, "fox", "red the red fox", "it’s it’s"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dictionary = spark.createDataFrame([("red fox", "rf"), ("Fox", "f"), ("the red fox ran", "long"), ("the red", "tr"), ("it’s", "its"), ("!", "none")],
                                       "term string, canonical string")
    got = entities.match_rows(df, "id", "t", dictionary)
    seen = sorted(map(tuple, got.collect()))
    assert seen and "slice" in plan(got) and "regexp_extract_all" not in plan(got)
    monkeypatch.setattr(entities, "MAX_LITERAL_TERMS", 2)
    every = entities.match_rows(df, "id", "t", dictionary)
    assert sorted(map(tuple, every.collect())) == seen
    assert " IN (" in plan(got) and " IN (" not in plan(every)


def counted_tokens(spark, col="t"):
    """A token column whose evaluations are counted."""
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def tokens(value):
        seen.add(1)
        return (value or "").split()
    return F.udf(tokens, "array<string>")(F.col(col)).alias("tokens"), seen


def test_a_classifier_cleans_each_text_once(spark):
    from vidtrend.plans import sentiment
    tokens, seen = counted_tokens(spark)
    df = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(prose(40, 3))], "id int, t string, label double").select("id", "label", tokens)
    model = sentiment.train_classifier(df, "tokens", "label", 64)
    assert seen.value == 40
    assert model.transform(df).filter("prediction IN (0, 1)").count() == 40 and len(model.stages) == 3


def test_a_vocabulary_is_counted_by_a_grouping(spark):
    from pyspark.ml.feature import CountVectorizer

    from vidtrend.plans import virality
    df = spark.createDataFrame([(t.split(),) for t in prose(50, 8)] + [(["all"],), ([],)], "g array<string>")
    for low, high in ((1.0, 2.0 ** 63), (3.0, 0.5), (0.1, 0.9)):
        want = CountVectorizer(inputCol="g", outputCol="v", minDF=low, maxDF=high).fit(df)
        got = virality.Vocabulary("g", "v", None, low, high).fit(df)
        assert set(got.vocabulary) == set(want.vocabulary)
        total = {w: sum(t.split().count(w) for t in [*prose(50, 8), "all"]) for w in got.vocabulary}
        assert got.vocabulary == sorted(total, key=lambda w: (-total[w], w))
        assert virality.Vocabulary("g", "v", 2, low, high).fit(df).vocabulary == got.vocabulary[:2]
        assert [r.v.numNonzeros() for r in got.transform(df).collect()] == [r.v.numNonzeros() for r in want.transform(df).collect()]
    assert not any(isinstance(s, CountVectorizer) for s in virality.assembler(with_tags=True).getStages())


def test_topics_clean_each_text_once(spark):
    from vidtrend.plans import topics
    tokens, seen = counted_tokens(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose(40, 3))], "id int, t string").select("id", tokens)
    fitted = topics.fit(topics.embed(df, "tokens", size=16), k=2, min_size=1)
    assert fitted.count() == 40 and seen.value == 40


def test_topics_by_sentiment_clean_each_text_once(spark):
    from vidtrend.plans import topics
    tokens, seen = counted_tokens(spark)
    kinds = ["positive", "negative", "neutral"]
    df = spark.createDataFrame([(i, t, kinds[i % 3]) for i, t in enumerate(prose(60, 3))], "id int, t string, sentiment string")
    fitted = topics.by_sentiment(df.select("id", "sentiment", tokens), "tokens", k=2, min_size=1)
    long = sum(len(t.split()) > 3 for i, t in enumerate(prose(60, 3)) if i % 3 < 2)
    assert fitted.count() == long and seen.value <= 60


def test_word_vectors_query_cleans_each_text_once(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from pyspark.sql import functions as F

    from vidtrend.functions import text
    seen = spark.sparkContext.accumulator(0)

    def tokens(value):
        seen.add(1)
        return (value or "").split()
    monkeypatch.setattr(text, "clean_tokens", lambda col, *_: F.udf(tokens, "array<string>")(F.col(col)))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(prose(30))], "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["t34_word_vectors"](spark, str(tmp_path)).collect()
    assert {r.dimensions for r in got} == {100} and len(got) == 30 and seen.value == 30


def test_byte_bpe_remembers_few_words_and_forgetting_changes_nothing(monkeypatch):
    import public_tokenizers

    from vidtrend.llm import byte_bpe
    assert byte_bpe.REMEMBERED <= 100_000
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = byte_bpe.read_ranks(lines)
    texts = prose(30, 9)
    whole = byte_bpe.encoder(ranks, public_tokenizers.PATTERN)()(texts)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    run = byte_bpe.encoder(ranks, public_tokenizers.PATTERN)()
    assert [run([t])[0] for t in texts] == whole
