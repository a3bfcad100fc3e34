"""N-gram, TF-IDF, phrase and emoji statistics over tokenised texts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.functions.scalars import week_start
from vidtrend.operators import aggregates, filters, windows
from vidtrend.operators.scale import calendar_broadcast, row_positions, scalar, top_n
from vidtrend.operators.substrings import contained_terms
from vidtrend.operators.term_weights import best_terms, term_weights
from vidtrend.session import cut_lineage, written


def grams(df: DataFrame, tokens: Column, n: int, keys: Sequence[str | Column] = (),
          distinct_words: int = 1) -> DataFrame:
    """One row per n-gram occurrence; n-grams never cross texts."""
    out = df.select(*keys, F.explode(text.ngrams(tokens, n)).alias("gram"))
    return out.filter(text.distinct_words("gram") >= distinct_words) if distinct_words > 1 else out


def gram_counts(df: DataFrame, tokens: Column, n: int, distinct_words: int = 1) -> DataFrame:
    return grams(df, tokens, n, distinct_words=distinct_words).groupBy("gram").agg(F.count("*").alias("n"))


def top_grams(df: DataFrame, tokens: Column, n: int, k: int = 10, denominator: str | None = None,
              distinct_words: int = 1, min_count: int = 1) -> DataFrame:
    """Most frequent n-grams; percentages of the whole corpus or of the top k."""
    counts = gram_counts(df, tokens, n, distinct_words).filter(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "gram").limit(k)
    if denominator is None:
        return top
    whole = counts if denominator == "corpus" else top
    return top.withColumn("pct", F.col("n") * 100.0 / scalar(whole, F.sum("n")))


def weekly_top_grams(df: DataFrame, tokens: Column, ts: str, n: int = 1, k: int = 5,
                     per: str | None = None) -> DataFrame:
    """Top n-grams per week with rank; ``per`` adds the share of the week's distinct posts."""
    counts = grams(df, tokens, n, [week_start(ts).alias("week")]).groupBy("week", "gram").agg(
        F.count("*").alias("n"))
    top = top_n(counts, ["week"], [F.desc("n"), F.col("gram")], k)
    if per:
        posts = df.select(week_start(ts).alias("week"), per).distinct().groupBy("week").agg(
            F.count("*").alias("posts"))
        top = top.join(calendar_broadcast(posts), "week").withColumn("share", F.col("n") / F.col("posts"))
    return top


def gram_week_shares(df: DataFrame, tokens: Column, ts: str, post: str, n: int = 1, k: int = 5) -> DataFrame:
    """Weekly share of posts for the k n-grams that are most frequent over all weeks.

    The n-grams are counted without weeks; only the k chosen ones are counted per week, in a second pass.
    """
    top = top_grams(df, tokens, n, k).select("gram")
    rows = grams(df, tokens, n, [week_start(ts).alias("week")]).join(F.broadcast(top), "gram")
    weekly = rows.groupBy("week", "gram").agg(F.count("*").alias("n"))
    posts = df.select(week_start(ts).alias("week"), post).distinct().groupBy("week").agg(
        F.count("*").alias("posts"))
    return weekly.join(calendar_broadcast(posts), "week").withColumn("share", F.col("n") / F.col("posts"))


def growth(df: DataFrame, tokens: Column, ts: str, n: int = 1, weeks: int = 4, min_now: int = 50,
           min_then: int = 25, k: int = 10) -> DataFrame:
    """n-grams growing between the newest week and the week ``weeks`` weeks earlier."""
    newest = scalar(df, F.max(week_start(ts)))
    then = F.date_sub(newest, 7 * weeks)
    two_weeks = df.filter((week_start(ts) == newest) | (week_start(ts) == then))
    rows = grams(two_weeks, tokens, n, [(week_start(ts) == newest).alias("is_now")])
    table = rows.groupBy("gram").agg(F.count_if("is_now").alias("now"), F.count_if(~F.col("is_now")).alias("then"))
    table = table.filter((F.col("now") >= min_now) & (F.col("then") >= min_then))
    return table.withColumn("growth", (F.col("now") - F.col("then")) / F.col("then")).orderBy(
        F.desc("growth"), "gram").limit(k)


def tfidf(df: DataFrame, doc: str, tokens: Column, low: int = 2, high: int = 3, by: Sequence[str] = (),
          max_features: int | None = None) -> DataFrame:
    """(by, doc, term, weight): smooth idf, each document scaled to unit length.

    ``by`` columns (a period) make independent corpora in the same job. A vocabulary limited to ``max_features`` needs
    the place of every term, so there counts, document frequencies and norms are aggregates keyed by term or document.
    """
    by = list(by)
    if not max_features:
        return term_weights(df, doc, tokens, low, high, by)
    # written once: vocabulary and weights both read it
    tf = cut_lineage(df.select(*by, doc, F.explode(text.ngram_range(tokens, low, high)).alias("term"))
                     .groupBy(*by, doc, "term").agg(F.count("*").alias("tf")))
    vocabulary = tf.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    placed = row_positions(vocabulary.withColumn("_neg", -F.col("cf")), "_neg", "term", by, "_at")
    vocabulary = placed.filter(F.col("_at") < max_features).drop("_at", "_neg")
    if by:
        docs = calendar_broadcast(df.groupBy(*by).agg(F.count("*").alias("docs")))
        vocabulary = vocabulary.join(docs, by)
    else:
        vocabulary = vocabulary.withColumn("docs", scalar(df, F.count("*")))
    idf = vocabulary.select(*by, "term", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = tf.join(idf, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    # a window holds the terms of one document
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, doc)))
    return raw.select(*by, doc, "term", (F.col("w") / norm).alias("weight"))


def tfidf_top(df: DataFrame, doc: str, tokens: Column, low: int = 2, high: int = 3, top: int = 20,
              max_features: int | None = 100_000) -> DataFrame:
    """Terms with the greatest summed weight."""
    if max_features:
        scores = tfidf(df, doc, tokens, low, high, (), max_features).groupBy("term").agg(F.sum("weight").alias("score"))
    else:
        scores = best_terms(df, doc, tokens, low, high, top).drop("rank")
    return scores.orderBy(F.desc("score"), "term").limit(top)


def mentions(df: DataFrame, col: str, terms: DataFrame, term: str = "term", minimum: int = 3,
             literal_terms: int = 1_000) -> DataFrame:
    """Texts that contain each (distinct, non-empty) term as a substring, for any number of terms.

    Up to ``literal_terms`` are tested one after another in the row, more are met by a gram index.
    """
    known = cut_lineage(terms.select(term).filter(F.length(term) > 0).distinct())
    if known.limit(literal_terms + 1).count() <= literal_terms:
        found = df.withColumn("_terms", term_array(known, term, literal_terms)).select(
            F.explode(F.filter("_terms", lambda t: F.contains(F.col(col), t))).alias(term))
    else:
        found = contained_terms(df.select(col), col, known, term)
    return found.groupBy(term).agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= minimum)


def term_array(terms: DataFrame, term: str = "term", max_terms: int = 1_000) -> Column:
    """A short term table as one array value; more than ``max_terms`` rows is an error."""
    few = terms.select(term).limit(max_terms + 1).agg(F.collect_list(term).alias("t"))
    return few.select(F.when(F.size("t") <= max_terms, F.array_sort("t")).otherwise(
        F.raise_error(F.lit(f"more than {max_terms} terms")).cast("array<string>"))).scalar()


def weekly_tfidf(df: DataFrame, doc: str = "post_id", col: str = "transcribed_text", ts: str = "createTimeISO",
                 days: int = 28, n: tuple[int, int] = (2, 3), top: int = 50, min_df: int = 5,
                 max_features: int | None = 100_000, stop: Sequence[str] = ()) -> DataFrame:
    """Trending n-grams of each recent week with summed TF-IDF and the texts that mention them."""
    recent = filters.recent_days(df.filter(F.col(col).isNotNull()), ts, days)
    # cleaned once; the weights and the mention counts both read it
    texts = written(recent.select(doc, week_start(ts).alias("week"), text.clean(col, stop).alias("clean")))
    tokens = text.whitespace_tokens("clean")
    if max_features:
        scores = tfidf(texts, doc, tokens, n[0], n[1], ["week"], max_features).groupBy("week", "term").agg(F.sum("weight").alias("score"))
        best = top_n(scores, ["week"], [F.desc("score"), F.col("term")], top)
    else:
        best = best_terms(texts, doc, tokens, n[0], n[1], top, ["week"])
    lists = calendar_broadcast(best.groupBy("week").agg(F.collect_list("term").alias("_terms")))
    hits = (texts.join(lists, "week").select(
        "week", F.explode(F.filter("_terms", lambda t: F.contains(F.col("clean"), t))).alias("term"))
        .groupBy("week", "term").agg(F.count("*").alias("mentions")))
    return best.join(hits.filter(F.col("mentions") >= min_df), ["week", "term"]).select(
        "week", F.col("term").alias("keyword"), F.col("score").alias("tfidf_score"), "mentions")


# --- tracked phrases ------------------------------------------------------------------------

def phrase_hits(df: DataFrame, phrases: Sequence[str], *cols: str) -> DataFrame:
    """One row per (row, phrase) where any of the text columns contains the phrase."""
    words = F.array(*[F.lit(p.lower()) for p in phrases])
    lowered = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in cols])
    hits = text.bind(lowered, lambda texts: F.filter(
        words, lambda p: F.exists(texts, lambda x: F.contains(x, p))))
    return df.withColumn("phrase", F.explode(hits))


def phrase_shares(df: DataFrame, phrases: Sequence[str], cols: Sequence[str], ts: str, unit: str = "day",
                  min_posts: int = 0) -> DataFrame:
    """Share of rows per period that mention each phrase, zeros included, thin periods null."""
    period = F.to_date(F.date_trunc(unit, ts))
    dated = df.filter(F.col(ts).isNotNull()).withColumn("period", period)
    totals = dated.groupBy("period").agg(F.count("*").alias("posts"))
    grid = totals.withColumn("phrase", F.explode(F.array(*[F.lit(p.lower()) for p in phrases])))
    hits = phrase_hits(dated, phrases, *cols).groupBy("period", "phrase").agg(F.count("*").alias("mentions"))
    table = grid.join(hits, ["period", "phrase"], "left").na.fill(0, ["mentions"])
    table = table.withColumn("share_pct", F.col("mentions") * 100.0 / F.col("posts"))
    return filters.mask_low_volume(table, "share_pct", "posts", min_posts) if min_posts else table


def phrase_sentiment(df: DataFrame, phrases: Sequence[str], cols: Sequence[str], ts: str,
                     sentiment: str = "sentiment", confidence: str = "confidence", minimum: float = 0.65,
                     labels: Sequence[str] = ("negative", "neutral", "positive")) -> DataFrame:
    """Per phrase and week: all mentions, and sentiment shares of the confident ones."""
    hits = phrase_hits(df, phrases, *cols).withColumn("week", week_start(ts))
    sure = F.col(confidence) >= minimum
    table = hits.groupBy("phrase", "week").agg(
        F.count("*").alias("volume"),
        *[F.count_if(sure & (F.col(sentiment) == lab)).alias(lab) for lab in labels])
    return aggregates.row_shares(table, list(labels))


def phrase_reach(df: DataFrame, phrases: Sequence[str], cols: Sequence[str], ts: str | None = None,
                 views: str = "playCount") -> DataFrame:
    """Views, posts and mean views of the posts that mention each phrase, in all or per week."""
    hits = phrase_hits(df, phrases, *cols)
    keys = ["phrase"]
    if ts:
        hits, keys = hits.withColumn("week", week_start(ts)), ["phrase", "week"]
    return hits.groupBy(*keys).agg(
        F.sum(views).alias("total_views"), F.count("*").alias("post_count"),
        (F.sum(views) / F.count("*")).alias("avg_views_per_post"))


def keyword_zscores(series: DataFrame, term: str, day: str, value: str, z: float = 3.5,
                    min_days: int = 5) -> DataFrame:
    """Robust z of the last day on a zero-filled, smoothed series of days seen in the data."""
    # terms seen on too few days go before every term gets a row for every day
    active = series.filter(F.col(value) != 0).groupBy(term).agg(F.count("*").alias("active_days")).filter(F.col("active_days") >= min_days)
    spine = windows.observed_spine(series.join(active.select(term), term, "left_semi"), term, day, value, series)
    smooth = windows.centred_mean(spine, [term], day, value, "_smooth")
    scores = windows.robust_z_last(smooth, [term], day, "_smooth")
    return scores.join(active, term).filter(F.col("z") > z)


# --- RAKE -----------------------------------------------------------------------------------

def _phrase_scores() -> Column:
    """Arrow function: the scores of a text's phrases; a word counts its phrases' lengths per occurrence."""
    def of(phrases: list[str]) -> list[float]:
        split, lengths, seen = [p.split(" ") for p in phrases], {}, {}
        for words in split:
            for w in words:
                lengths[w] = lengths.get(w, 0) + len(words)
                seen[w] = seen.get(w, 0) + 1
        return [sum(lengths[w] / seen[w] for w in words) for words in split]

    @F.arrow_udf("array<double>")
    def scores(runs: pa.Array) -> pa.Array:
        return pa.array([of(r.values.to_pylist()) if r.is_valid else None for r in runs], pa.list_(pa.float64()))

    return scores


def rake(df: DataFrame, doc: str, col: str, stop: Sequence[str], per_doc: int = 3) -> DataFrame:
    """(doc, at, phrase, score, rank): the best candidate phrases of each text by degree / frequency.

    A text whose id no other row has is scored in its row, so words and phrases are not shuffled; texts
    that share an id count as one, and their words meet by id.
    """
    marked = F.regexp_replace(F.lower(F.col(col)), r"[^\p{L}\p{N}_'\s]+", " | ")
    words = F.transform(text.whitespace_tokens(marked), lambda t: F.when(t.isin(list(stop)), "|").otherwise(t))
    runs = F.filter(F.transform(F.split(F.array_join(words, " "), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    shared = cut_lineage(df.filter(F.col(doc).isNotNull()).groupBy(doc).agg(F.count("*").alias("_n")).filter("_n > 1").select(doc))
    if shared.isEmpty():
        return _rake_in_row(df.filter(F.col(doc).isNotNull()), doc, runs, per_doc)
    alone = df.filter(F.col(doc).isNotNull()).join(shared, doc, "left_anti")
    return _rake_in_row(alone, doc, runs, per_doc).unionByName(_rake_by_id(df.join(shared, doc, "left_semi"), doc, runs, per_doc))


def _rake_in_row(df: DataFrame, doc: str, runs: Column, per_doc: int) -> DataFrame:
    scored = df.select(doc, runs.alias("phrases")).withColumn("scores", _phrase_scores()("phrases"))
    each = F.transform(F.arrays_zip("phrases", "scores"), lambda p, i: F.struct(
        F.round(p["scores"], 6).alias("r"), p["phrases"].alias("phrase"), (-i).alias("back"), p["scores"].alias("score")))
    best = F.slice(F.reverse(F.array_sort(each)), 1, per_doc)
    return scored.select(doc, F.posexplode(best).alias("place", "b")).select(
        doc, (-F.col("b.back")).alias("at"), "b.phrase", "b.score", (F.col("place") + 1).alias("rank"))


def _rake_by_id(df: DataFrame, doc: str, runs: Column, per_doc: int) -> DataFrame:
    phrases = df.select(doc, F.posexplode(runs).alias("at", "phrase")).withColumn("words", F.split("phrase", " "))
    each = phrases.select(doc, "at", "phrase", F.size("words").alias("len"), F.explode("words").alias("word"))
    # one row per (text, word) with the list length summed: degree counts the word's phrases' lengths
    stats = each.groupBy(doc, "word").agg((F.sum("len") / F.count("*")).alias("word_score"))
    scored = each.join(stats, [doc, "word"]).groupBy(doc, "at", "phrase").agg(F.sum("word_score").alias("score"))
    return top_n(scored, [doc], [F.desc(F.round("score", 6)), F.desc("phrase"), F.col("at")], per_doc)


def rake_trends(df: DataFrame, doc: str, col: str, stop: Sequence[str], per_doc: int = 3, min_words: int = 2,
                max_words: int = 5, minimum: int = 3, top: int = 20, banned: Sequence[str] = ()) -> DataFrame:
    """Phrases that are among the best of several texts."""
    best = rake(df, doc, col, stop, per_doc)
    length = F.size(F.split("phrase", " "))
    counts = best.filter(length.between(min_words, max_words)).groupBy("phrase").agg(F.count("*").alias("n"))
    if banned:
        counts = counts.filter(~text.contains_any("phrase", banned))
    return counts.filter(F.col("n") >= minimum).orderBy(F.desc("n"), "phrase").limit(top)


# --- emoji ----------------------------------------------------------------------------------

def emoji_weeks(df: DataFrame, col: str, ts: str, k: int = 5, runs: bool = True) -> DataFrame:
    """Weekly share of each emoji among the week's emoji, k best per week."""
    rows = df.select(week_start(ts).alias("week"), F.explode(text.emojis(col, runs)).alias("emoji"))
    counts = rows.groupBy("week", "emoji").agg(F.count("*").alias("n"))
    totals = calendar_broadcast(counts.groupBy("week").agg(F.sum("n").alias("_all")))
    top = top_n(counts, ["week"], [F.desc("n"), F.col("emoji")], k)
    return top.join(totals, "week").withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def top_emoji(df: DataFrame, col: str, k: int = 10, runs: bool = False) -> DataFrame:
    return (df.select(F.explode(text.emojis(col, runs)).alias("emoji")).groupBy("emoji")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "emoji").limit(k))
