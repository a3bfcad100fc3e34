"""Text functions and dictionary matches on edge cases."""

import pytest
from pyspark.sql import functions as F

from vidtrend.functions import fixed, text
from vidtrend.operators import filters, windows
from vidtrend.plans import entities, keywords, sentiment


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_clean_drops_links_mentions_emoji_runs_and_short_words(spark):
    got = one(spark, "Sooooo GOOD 😀😀 http://x.y/z @me schööön ab the 123!!", text.clean("t", ["the"]))
    assert got == "good schön 123"


def test_clean_keeps_marks_and_two_characters_of_a_run(spark):
    assert one(spark, "waaaay #tag??? no", text.clean("t", keep="#?!", max_run=2)) == "waay #tag??"


def test_hashtags_unicode_and_null(spark):
    assert one(spark, "#Über_1 x #b", text.hashtags("t")) == ["über_1", "b"]
    assert one(spark, None, text.hashtags("t")) is None


def test_ngrams_shorter_than_n_give_nothing(spark):
    assert one(spark, "a b", text.ngrams(F.split("t", " "), 3)) == []
    assert one(spark, "a b c", text.ngram_range(F.split("t", " "), 2, 3)) == ["a b", "b c", "a b c"]


def test_caption_tokens(spark):
    assert one(spark, "Very very nice #tag @you www.x.de co-op2 x", text.caption_tokens("t")) == ["very", "nice", "coop"]


def test_slang(spark):
    assert one(spark, "@bob no cap #Fun yeahhhhhh fr!", text.normalise_slang("t")) == "USER_MENTION no lie hashtag_fun yeahhh for real!"


def test_repeats(spark):
    assert one(spark, "so so so good", text.thrice_repeated("t")) is True
    assert one(spark, "so so good so", text.thrice_repeated("t")) is False
    assert one(spark, "a b a c a d a e A", text.has_repeated_word("t")) is True
    assert one(spark, None, text.thrice_repeated("t")) is False


def test_time_of_day_is_whole_word_and_policy_decides(spark):
    assert one(spark, "night cream", text.time_of_day("t")) == "night"
    assert one(spark, "cream only", text.time_of_day("t")) is None
    assert one(spark, "morning and night", text.time_of_day("t", "first")) == "morning"
    assert one(spark, "morning and night", text.time_of_day("t", "last")) == "night"


def test_emoji_single_and_runs(spark):
    assert one(spark, "a😂😂b✨", text.emojis("t")) == ["😂", "😂", "✨"]
    assert one(spark, "a😂😂b✨", text.emojis("t", runs=True)) == ["😂😂", "✨"]


@pytest.mark.parametrize("value, want", [
    ("my alpha routine", []), ("PHA toner", ["pha"]), ("alpha-arbutin!", ["alpha arbutin"]), ("alpha arbutin", ["alpha arbutin"]),
    ("aloe-vera", []), ("aloe vera, retinol", ["aloe vera", "retinol"]), ("alpha - arbutin", []), (None, [])])
def test_whole_word_ingredients(spark, value, want):
    assert one(spark, value, entities.match("t", fixed.INGREDIENTS)) == want


def test_brand_with_curly_apostrophe_and_substring_mode(spark):
    assert one(spark, "L’Oreal and doves", entities.match("t", fixed.BRANDS)) == ["l'oreal"]
    assert one(spark, "L’Oreal and doves", entities.match("t", fixed.BRANDS, whole_word=False)) == ["dove", "l'oreal"]


def test_sequence_keeps_order_and_long_terms(spark):
    got = one(spark, "first cleanser then eye cream, cleanser", entities.sequence("t", fixed.PRODUCTS))
    assert got == ["cleanser", "eye cream", "cleanser"]
    pairs = one(spark, "mask mask serum toner", windows.adjacent_pairs(windows.without_repeats(entities.sequence("t", fixed.PRODUCTS))))
    assert [tuple(p) for p in pairs] == [("mask", "serum"), ("serum", "toner")]


def test_match_rows_equals_literal_match(spark):
    rows = [(1, "aloe vera and retinol"), (2, "nothing"), (3, "green tea green tea")]
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = [(n, x) for n, xs in fixed.INGREDIENTS.items() for x in xs]
    got = {tuple(r) for r in entities.match_rows(df, "id", "t", spark.createDataFrame(pairs, "canonical string, term string")).collect()}
    assert got == {(1, "aloe vera"), (1, "retinol"), (3, "green tea")}


def test_lexicon_sentiment_with_negation(spark):
    df = spark.createDataFrame([(1, "good good"), (2, "not good"), (3, "table")], "id int, t string")
    lex = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    out = {r.id: r for r in sentiment.lexicon(df, "id", "t", lex).collect()}
    assert out[1].sentiment == "positive" and out[1].compound == pytest.approx(4 / (16 + 15) ** 0.5)
    assert out[2].sentiment == "negative" and out[3].sentiment == "neutral"


def test_scorer_failure_on_one_text_is_contained(spark):
    import pandas as pd

    def load():
        def apply(texts):
            if (texts == "boom").any():
                raise ValueError("bad text")
            return pd.DataFrame({"sentiment": ["positive"] * len(texts), "confidence": [0.65] * len(texts)})
        return apply
    df = spark.createDataFrame([("a",), ("boom",), ("b",)], "t string").coalesce(1)
    got = {r.t: (r.raw_sentiment, r.sentiment) for r in sentiment.score(df, "t", load).collect()}
    assert got == {"a": ("positive", "positive"), "b": ("positive", "positive"), "boom": ("error", None)}
    assert sentiment.score(df, "t", load, drop_errors=True).count() == 2


def test_rake_scores(spark):
    df = spark.createDataFrame([(1, "deep clean serum and the deep mask. serum")], "id int, t string")
    rows = keywords.rake(df, "id", "t", ["and", "the"], 10).collect()
    assert rows[0].phrase == "deep clean serum" and rows[0].score == pytest.approx(2.5 + 3 + 2)


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b x y")], "id int, t string")
    w = keywords.tfidf(df, "id", F.split("t", " "), 1, 2)
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert [r.s for r in norms] == pytest.approx([1.0, 1.0])
    assert keywords.tfidf(df, "id", F.split("t", " "), 1, 1, max_features=2).select("term").distinct().count() == 2


def test_spam_and_date_range(spark):
    df = spark.createDataFrame([("speed made you famous",), ("nice",)], "comment string")
    assert [r.comment for r in filters.drop_spam(df).collect()] == ["nice"]
    with pytest.raises(ValueError):
        filters.date_range(df, "comment", "2024-02-01", "2024-01-01")


def test_too_many_terms_is_an_error(spark):
    terms = spark.range(20).select(F.col("id").cast("string").alias("term"))
    with pytest.raises(Exception, match="more than 5 terms"):
        spark.range(1).withColumn("x", keywords.term_array(terms, "term", 5)).collect()


def test_sequence_uses_up_the_words_of_a_term(spark):
    steps = {"oil": ["double cleanse"], "wash": ["cleanse"], "serum": ["serum"]}
    assert one(spark, "Double cleanse then serum, cleanse", entities.sequence("t", steps)) == ["oil", "serum", "wash"]
    assert one(spark, None, entities.sequence("t", steps)) == [] and one(spark, "", entities.sequence("t", steps)) == []


def test_rows_match_terms_of_any_length(spark):
    words = [f"w{i}" for i in range(9)]
    dictionary = spark.createDataFrame([(" ".join(words[:7]), "long"), ("w8", "short"), ("", "none")], "term string, canonical string")
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "w8 w8"), (3, None), (4, " ".join(words[:6]))], "id int, t string")
    assert sorted(map(tuple, entities.match_rows(texts, "id", "t", dictionary).collect())) == [(1, "long"), (1, "short"), (2, "short")]


def test_match_with_a_large_dictionary(spark):
    terms = {f"name{i}": [f"term{i}", f"two words{i}"] for i in range(2400)}
    assert one(spark, "x term7 two words9, term7", entities.match("t", terms)) == ["name7", "name9"]


def test_tfidf_matrix_keeps_terms_after_the_500_most_frequent(spark, tmp_path):
    import __spark_entry__
    words = [f"q{a}{b}{c}x" for a in "bdfgk" for b in "aeiou" for c in "bcdfghjklmnprstvwz"][:400]
    words += [w + "y" for w in words]
    # every word stands in two texts, every pair of words in one, so it is no term of the vocabulary
    texts = [" ".join(words[i::20]) for i in range(20)] + [" ".join(reversed(words[i:i + 40])) for i in range(0, 800, 40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.post_id: r.terms for r in __spark_entry__.queries()["t35_tfidf_matrix"](spark, str(tmp_path)).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}
