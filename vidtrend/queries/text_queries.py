"""Text cleaning, n-grams, TF-IDF, phrases, emoji and language queries."""

from pyspark.sql import functions as F

from vidtrend.functions import fixed, text
from vidtrend.functions.text import stopwords
from vidtrend.operators import aggregates
from vidtrend.plans import keywords, language, ml, topics, virality
from vidtrend.queries import adapters as t
from vidtrend.queries import sqltext as q
from vidtrend.queries.registry import query
from vidtrend.session import written

STOP = stopwords()
CAPTION_STOP = stopwords(extra=fixed.CAPTION_STOP_WORDS)
PHRASES = ["of the", "de la", "rewh", "thanedble", "anea eriner"]
SPARKLED = "replace(replace(text, '%%%', '✨'), '&&&', '🔥🔥')"


def sparkled(df, col="text"):
    """The given texts with two of their junk marks read as emoji."""
    return df.withColumn(col, F.replace(F.replace(F.col(col), F.lit("%%%"), F.lit("✨")), F.lit("&&&"), F.lit("🔥🔥")))


# --- scalar text functions ------------------------------------------------------------------

@query("x1_clean_text", f"SELECT post_id, {q.clean('text', STOP)} AS clean FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", text.clean("text", STOP).alias("clean"))


@query("x2_clean_keep_symbols", f"SELECT post_id, {q.clean('text', STOP, symbols='#?!', max_run=2)} AS clean FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", text.clean("text", STOP, keep="#?!", max_run=2).alias("clean"))


@query("x3_letter_tokens", f"SELECT post_id, array_to_string({q.letter_tokens('text', CAPTION_STOP)}, ' ') AS words FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.array_join(text.letter_tokens("text", CAPTION_STOP), " ").alias("words"))


@query("x3_strip_digits_symbols", r"SELECT post_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\s]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", text.strip_digits_symbols("text").alias("plain"))


@query("x3_collapse_repeated_words")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.size(text.caption_tokens("text", STOP)).alias("tokens"),
                                    F.length(text.collapse_repeated_words(F.lower("text"))).alias("chars"))


def _slang_sql():
    s = rf"regexp_replace(lower(text), '@{q.WORD}+', '[USER_MENTION]', 'g')"
    s = rf"regexp_replace({s}, '#({q.WORD}+)', 'hashtag_\1', 'g')"
    s = rf"regexp_replace({s}, 'http\S+|www\S+', '[URL]', 'g')"
    return s


@query("x4_slang_tokens", rf"""SELECT post_id, contains({_slang_sql()}, '[USER_MENTION]') AS has_mention, len(regexp_extract_all({_slang_sql()}, 'hashtag_')) AS tags FROM posts""")
def _(spark, d):
    norm = text.normalise_slang("text")
    return t.posts(spark, d).select("post_id", F.contains(norm, F.lit("USER_MENTION")).alias("has_mention"),
                                    F.regexp_count(norm, F.lit("hashtag_")).alias("tags"))


@query("x5_hashtags", rf"SELECT post_id, array_to_string(regexp_extract_all(lower(text), '#({q.WORD}+)', 1), ', ') AS tags FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", text.hashtags("text").alias("tags"))


@query("x6_strip_hashtags", rf"SELECT post_id, length(regexp_replace(text, '#{q.WORD}+', '', 'g')) AS chars FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.length(text.strip_hashtags("text")).alias("chars"))


@query("x7_combine_text", """SELECT p.post_id, replace(lower(coalesce("textLanguage", '') || ' ' || coalesce("bucketUrl", '')), '’', '''') AS combined FROM posts p LEFT JOIN transcripts s ON p.post_id = s.post_id""")
def _(spark, d):
    both = t.posts(spark, d).join(t.transcripts(spark, d), "post_id", "left")
    return both.select("post_id", text.combine("textLanguage", "bucketUrl").alias("combined"))


@query("x8_text_statistics", rf"""WITH w AS (SELECT post_id, text, {q.whitespace_tokens('text')} AS ws FROM posts)
SELECT post_id, len(ws) AS word_count, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS sentence_count,
 R6(coalesce(list_sum(list_transform(ws, lambda x: length(x))) / len(ws), 0)) AS avg_word_length, length(text) - length(replace(text, '!', '')) AS exclamation_count,
 length(text) - length(replace(text, '?', '')) AS question_count FROM w""")
def _(spark, d):
    return t.posts(spark, d).select("post_id", *[c.alias(n) for n, c in text.statistics("text").items()])


@query("x9_emoji", rf"WITH s AS (SELECT post_id, {SPARKLED} AS text FROM posts) SELECT post_id, len(regexp_extract_all(text, '[{fixed.EMOJI_RANGES}]')) AS singles, len(regexp_extract_all(text, '[{fixed.EMOJI_RANGES}]+')) AS runs FROM s")
def _(spark, d):
    return sparkled(t.posts(spark, d)).select("post_id", F.size(text.emojis("text")).alias("singles"), F.size(text.emojis("text", runs=True)).alias("runs"))


@query("x10_basic_text", """SELECT post_id, length(text) AS chars, substr(lower(trim(text)), 1, 10) AS head, contains(lower(text), 'the') AS has_the FROM posts""")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.length("text").alias("chars"), F.substring(F.lower(F.trim("text")), 1, 10).alias("head"), F.ilike("text", F.lit("%the%")).alias("has_the"))


@query("x11_split_and_explode", "SELECT p_partkey, unnest(string_split(coalesce(p_name, ''), ' ')) AS word FROM part")
def _(spark, d):
    return t.table(spark, d, "part").select("p_partkey", F.explode(F.split(F.coalesce("p_name", F.lit("")), " ")).alias("word"))


@query("x25_time_of_day", "WITH l AS (SELECT post_id, lower(text) AS s FROM posts) SELECT post_id, coalesce(CASE "
       + " ".join(f"WHEN {q.word_hit('s', w)} THEN '{v}'" for w, v in fixed.TIME_WORDS) + " END, 'none') AS first_wins, coalesce(CASE "
       + " ".join(f"WHEN {q.word_hit('s', w)} THEN '{v}'" for w, v in fixed.TIME_WORDS[::-1]) + " END, 'none') AS last_wins FROM l")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.coalesce(text.time_of_day("text", "first"), F.lit("none")).alias("first_wins"),
                                    F.coalesce(text.time_of_day("text", "last"), F.lit("none")).alias("last_wins"))


@query("x26_sentences", r"""WITH s AS (SELECT post_id, regexp_replace(text, '([.!?])\s+', '\1␞', 'g') AS x FROM posts)
SELECT post_id, len(list_filter(string_split(x, '␞'), lambda y: trim(y) <> '')) AS sentences FROM s""")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.size(text.sentences("text")).alias("sentences"))


@query("x28_stop_word_filter", rf"SELECT post_id, len({q.keep(q.whitespace_tokens('lower(text)'), STOP)}) AS kept FROM posts")
def _(spark, d):
    return t.posts(spark, d).select("post_id", F.size(text.keep_tokens(text.whitespace_tokens(F.lower("text")), STOP)).alias("kept"))


# --- n-grams --------------------------------------------------------------------------------

_TOK = f"WITH tok AS (SELECT post_id, CAST(date_trunc('week', \"createTimeISO\") AS DATE) AS w, {q.letter_tokens('text', STOP)} AS ws FROM posts)"


def _tokens():
    return text.letter_tokens("text", STOP)


for _n, _name in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams")):
    @query(f"t1_top_{_name}", _TOK + f", g AS (SELECT unnest({q.ngrams('ws', _n)}) AS gram FROM tok) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    def _(spark, d, n=_n):
        return keywords.top_grams(t.posts(spark, d), _tokens(), n)


@query("t1_all_bigram_counts", _TOK + f", g AS (SELECT unnest({q.ngrams('ws', 2)}) AS gram FROM tok) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def _(spark, d):
    return keywords.gram_counts(t.posts(spark, d), _tokens(), 2)


@query("t2_relative_corpus", _TOK + f", g AS (SELECT unnest({q.ngrams('ws', 2)}) AS gram FROM tok) SELECT gram, count(*) AS n, R6(count(*) * 100.0 / (SELECT count(*) FROM g)) AS pct FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return keywords.top_grams(t.posts(spark, d), _tokens(), 2, denominator="corpus")


@query("t2_relative_topk", _TOK + f""", g AS (SELECT unnest({q.ngrams('ws', 3)}) AS gram FROM tok), c AS (SELECT gram, count(*) AS n FROM g
 WHERE len(list_distinct(string_split(gram, ' '))) >= 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT gram, n, R6(n * 100.0 / (SELECT sum(n) FROM c)) AS pct FROM c""")
def _(spark, d):
    return keywords.top_grams(t.posts(spark, d), _tokens(), 3, denominator="topk", distinct_words=2)


@query("t3_week_shares", _TOK + f""", g AS (SELECT w, unnest({q.ngrams('ws', 2)}) AS gram FROM tok), c AS (SELECT w, gram, count(*) AS n FROM g GROUP BY 1, 2),
 top AS (SELECT gram FROM c GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 5), p AS (SELECT w, count(DISTINCT post_id) AS posts FROM tok GROUP BY 1)
SELECT CAST(w AS VARCHAR) AS week, gram, n, posts, R6(n / posts) AS share FROM c JOIN top USING (gram) JOIN p USING (w)""")
def _(spark, d):
    return keywords.gram_week_shares(t.posts(spark, d), _tokens(), "createTimeISO", "post_id", 2)


@query("t4_top_words_per_week", _TOK + """, c AS (SELECT w, gram, count(*) AS n FROM (SELECT w, unnest(ws) AS gram FROM tok) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, gram) AS rank FROM c) SELECT CAST(w AS VARCHAR) AS week, gram, n, rank FROM r WHERE rank <= 5""")
def _(spark, d):
    return keywords.weekly_top_grams(t.posts(spark, d), _tokens(), "createTimeISO")


@query("t5_four_week_growth", _TOK + """, mx AS (SELECT max(w) AS m FROM tok), g AS (SELECT w, unnest(ws) AS gram FROM tok),
 c AS (SELECT gram, count(*) FILTER (w = m) AS now, count(*) FILTER (w = m - 28) AS "then" FROM g, mx GROUP BY 1)
SELECT gram, now, "then", R6((now - "then") / "then") AS growth FROM c WHERE now >= 10 AND "then" >= 5 ORDER BY (now - "then") / "then" DESC, gram LIMIT 10""")
def _(spark, d):
    return keywords.growth(t.posts(spark, d), _tokens(), "createTimeISO", min_now=10, min_then=5)


@query("t36_bigrams_min_count", _TOK + f", g AS (SELECT unnest({q.ngrams('ws', 2)}) AS gram FROM tok) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 30")
def _(spark, d):
    return keywords.top_grams(t.posts(spark, d), _tokens(), 2, 30, min_count=20)


# --- TF-IDF ---------------------------------------------------------------------------------

_TF = """tf AS (SELECT {k}post_id, term, count(*) AS tf FROM grams GROUP BY ALL),
 dfs AS (SELECT {k}term, count(*) AS df FROM tf GROUP BY ALL),
 wt AS (SELECT tf.*, tf * (ln((1 + {n}) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING ({k}term){j}),
 nrm AS (SELECT {k}post_id, sqrt(sum(x * x)) AS nn FROM wt GROUP BY ALL)"""


@query("t13_tfidf_top", f"WITH tok AS (SELECT post_id, {q.clean_tokens('text', STOP)} AS ws FROM posts), grams AS (SELECT post_id, unnest(list_concat({q.ngrams('ws', 2)}, {q.ngrams('ws', 3)})) AS term FROM tok), "
       + _TF.format(k="", n="(SELECT count(*) FROM posts)", j="") + " SELECT term, R6(sum(x / nn)) AS score FROM wt JOIN nrm USING (post_id) GROUP BY 1 ORDER BY sum(x / nn) DESC, 1 LIMIT 20")
def _(spark, d):
    return keywords.tfidf_top(t.posts(spark, d), "post_id", text.clean_tokens("text", STOP), max_features=None)


@query("t14_substring_mentions", _TOK + f""", g AS (SELECT unnest({q.ngrams('ws', 2)}) AS gram FROM tok), top AS (SELECT gram FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)
SELECT gram AS term, count(*) AS mentions FROM top, posts WHERE contains(lower(text), gram) GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, d):
    p = t.posts(spark, d).withColumn("lowered", F.lower("text"))
    top = keywords.top_grams(p, _tokens(), 2, 50).select(F.col("gram").alias("term"))
    return keywords.mentions(p, "lowered", top)


@query("t14_mentions_of_2000_words", _TOK + """, g AS (SELECT unnest(ws) AS term FROM tok), top AS (SELECT term FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2000)
SELECT term, count(*) AS mentions FROM top, posts WHERE contains(lower(text), term) GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, d):
    p = t.posts(spark, d).withColumn("lowered", F.lower("text"))
    top = keywords.top_grams(p, _tokens(), 1, 2000).select(F.col("gram").alias("term"))
    return keywords.mentions(p, "lowered", top)


@query("t15_weekly_tfidf", f"""WITH recent AS (SELECT * FROM posts WHERE "createTimeISO" >= (SELECT max("createTimeISO") FROM posts) - INTERVAL 28 DAY AND text IS NOT NULL),
 cl AS (SELECT post_id, CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, {q.clean('text')} AS c FROM recent),
 tok AS (SELECT post_id, w, {q.whitespace_tokens('c')} AS ws FROM cl), grams AS (SELECT w, post_id, unnest(list_concat({q.ngrams('ws', 2)}, {q.ngrams('ws', 3)})) AS term FROM tok),
 nd AS (SELECT w, count(*) AS n FROM cl GROUP BY 1), """ + _TF.format(k="w, ", n="n", j=" JOIN nd USING (w)") + """,
 sc AS (SELECT w, term, sum(x / nn) AS score FROM wt JOIN nrm USING (w, post_id) GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, term) AS rn FROM sc) WHERE rn <= 50),
 m AS (SELECT top.w, term, count(*) AS mentions FROM top JOIN cl ON top.w = cl.w AND contains(c, term) GROUP BY 1, 2)
SELECT CAST(w AS VARCHAR) AS week, term AS keyword, R6(score) AS tfidf_score, mentions FROM top JOIN m USING (w, term) WHERE mentions >= 5""")
def _(spark, d):
    return keywords.weekly_tfidf(t.posts(spark, d), col="text", max_features=None)


# --- tracked phrases ------------------------------------------------------------------------

_PV = ", ".join(f"('{p}')" for p in PHRASES)
_HITS = f"WITH ph(phrase) AS (VALUES {_PV}), p AS (SELECT *, CAST(\"createTimeISO\" AS DATE) AS dd, CAST(date_trunc('week', \"createTimeISO\") AS DATE) AS w FROM {{t}}), h AS (SELECT p.*, phrase FROM p JOIN ph ON contains(lower(text), phrase))"


@query("t16_phrase_shares", _HITS.format(t="posts") + """, d AS (SELECT w, count(*) AS posts FROM p GROUP BY 1), m AS (SELECT w, phrase, count(*) AS mentions FROM h GROUP BY 1, 2)
SELECT CAST(d.w AS VARCHAR) AS period, ph.phrase, posts, coalesce(mentions, 0) AS mentions, CASE WHEN posts >= 20 THEN R6(coalesce(mentions, 0) * 100.0 / posts) END AS share_pct
FROM d CROSS JOIN ph LEFT JOIN m ON m.w = d.w AND m.phrase = ph.phrase""")
def _(spark, d):
    return keywords.phrase_shares(t.posts(spark, d), PHRASES, ["text", "author_nickName"], "createTimeISO", "week", 20)


@query("t17_phrase_sentiment", _HITS.format(t="scored_posts") + """, c AS (SELECT phrase, w, count(*) AS volume, """ + ", ".join(
    f"count(*) FILTER (confidence >= 0.65 AND sentiment = '{s}') AS {s}" for s in ("negative", "neutral", "positive")) + """ FROM h GROUP BY 1, 2)
SELECT phrase, CAST(w AS VARCHAR) AS week, volume, negative, neutral, positive, """ + ", ".join(
    f"R6({s} / nullif(negative + neutral + positive, 0)) AS {s}_share" for s in ("negative", "neutral", "positive")) + " FROM c")
def _(spark, d):
    return keywords.phrase_sentiment(t.scored_posts(spark, d), PHRASES, ["text"], "createTimeISO")


@query("q26_phrase_reach", _HITS.format(t="posts") + """ SELECT phrase, CAST(w AS VARCHAR) AS week, CAST(sum("playCount") AS BIGINT) AS total_views, count(*) AS post_count, R6(avg("playCount")) AS avg_views_per_post FROM h GROUP BY 1, 2""")
def _(spark, d):
    return keywords.phrase_reach(t.posts(spark, d), PHRASES, ["text"], "createTimeISO")


@query("q26_phrase_reach_overall", _HITS.format(t="posts") + """ SELECT phrase, CAST(sum("playCount") AS BIGINT) AS total_views, count(*) AS post_count, R6(avg("playCount")) AS avg_views_per_post FROM h GROUP BY 1""")
def _(spark, d):
    return keywords.phrase_reach(t.posts(spark, d), PHRASES, ["text"])


@query("q25_keyword_zscores", """WITH c AS (SELECT hashtag_name, CAST("createTimeISO" AS DATE) AS dd, count(*) AS n FROM tag_posts GROUP BY 1, 2),
 sp AS (SELECT k.hashtag_name, d.dd, coalesce(n, 0) AS n FROM (SELECT DISTINCT hashtag_name FROM c) k CROSS JOIN (SELECT DISTINCT dd FROM c) d LEFT JOIN c ON c.hashtag_name = k.hashtag_name AND c.dd = d.dd),
 sm AS (SELECT *, avg(n) OVER (PARTITION BY hashtag_name ORDER BY dd ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, row_number() OVER (PARTITION BY hashtag_name ORDER BY dd DESC) AS rn FROM sp),
 z AS (SELECT hashtag_name, max(s) FILTER (rn = 1) AS last_value, median(s) FILTER (rn > 1) AS med, mad(s) FILTER (rn > 1) AS md, count(*) FILTER (n <> 0) AS active_days FROM sm GROUP BY 1),
 r AS (SELECT *, (last_value - med) / CASE WHEN md = 0 THEN 1 ELSE md * 1.482602218505602 END AS zz FROM z)
SELECT hashtag_name, R6(last_value) AS last_value, R6(med) AS hist_median, R6(md) AS hist_mad, R6(zz) AS z, active_days FROM r WHERE active_days >= 5 AND zz > 1.0""")
def _(spark, d):
    series = t.tag_posts(spark, d).groupBy("hashtag_name", F.to_date("createTimeISO").alias("day")).agg(F.count("*").alias("n"))
    return keywords.keyword_zscores(series, "hashtag_name", "day", "n", z=1.0).drop("periods")


# --- RAKE and emoji -------------------------------------------------------------------------

_RAKE = rf"""WITH m AS (SELECT post_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_''\s]+', ' | ', 'g') AS x FROM posts),
 r AS (SELECT post_id, list_filter(list_transform(string_split(array_to_string(list_transform({q.whitespace_tokens('x')}, lambda x: CASE WHEN x IN ({q.quoted(STOP)}) THEN '|' ELSE x END), ' '), '|'), lambda y: trim(y)), lambda y: y <> '') AS ph FROM m),
 p AS (SELECT post_id, unnest(ph) AS phrase, generate_subscripts(ph, 1) AS pos FROM r),
 e AS (SELECT post_id, pos, phrase, len(string_split(phrase, ' ')) AS ln, unnest(string_split(phrase, ' ')) AS word FROM p),
 st AS (SELECT post_id, word, sum(ln) / count(*) AS ws FROM e GROUP BY 1, 2),
 sc AS (SELECT post_id, pos, phrase, sum(ws) AS score FROM e JOIN st USING (post_id, word) GROUP BY 1, 2, 3),
 top AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY round(score, 6) DESC, phrase DESC, pos) AS rank FROM sc)"""


@query("t22_rake_trends", _RAKE + """ SELECT phrase, count(*) AS n FROM top WHERE rank <= 3 AND len(string_split(phrase, ' ')) BETWEEN 2 AND 5 GROUP BY 1 HAVING count(*) >= 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return keywords.rake_trends(t.posts(spark, d), "post_id", "text", STOP, minimum=1)


@query("t23_emoji_weeks", rf"""WITH e AS (SELECT CAST(date_trunc('week', "createTimeISO") AS DATE) AS w, unnest(regexp_extract_all({SPARKLED}, '[{fixed.EMOJI_RANGES}]+')) AS emoji FROM posts),
 c AS (SELECT w, emoji, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, emoji) AS rank, sum(n) OVER (PARTITION BY w) AS a FROM c)
SELECT CAST(w AS VARCHAR) AS week, emoji, n, rank, R6(n / a) AS share FROM r WHERE rank <= 5""")
def _(spark, d):
    return keywords.emoji_weeks(sparkled(t.posts(spark, d)), "text", "createTimeISO")


@query("t23_top_emoji", rf"""SELECT emoji, count(*) AS n FROM (SELECT unnest(regexp_extract_all({SPARKLED}, '[{fixed.EMOJI_RANGES}]')) AS emoji FROM posts) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    return keywords.top_emoji(sparkled(t.posts(spark, d)), "text")


# --- languages, vectors ---------------------------------------------------------------------

@query("t20_language_detection")
def _(spark, d):
    p = t.posts(spark, d)
    model = language.train(p, "text", "textLanguage")
    return aggregates.counts(language.detect(model, p, "text"), "textLanguage", "detected_language")


@query("t21_language_distributions", """WITH s AS (SELECT "textLanguage" AS a, CASE WHEN post_id % 3 = 0 THEN 'en' ELSE "textLanguage" END AS b FROM posts)
SELECT a.a AS language, R6(ts) AS text_share, R6(ss) AS spoken_share FROM (SELECT a, count(*) / (SELECT count(*) FROM s) AS ts FROM s GROUP BY 1) a JOIN (SELECT b, count(*) / (SELECT count(*) FROM s) AS ss FROM s GROUP BY 1) b ON a.a = b.b""")
def _(spark, d):
    p = t.posts(spark, d).withColumn("spoken", F.when(F.col("post_id") % 3 == 0, "en").otherwise(F.col("textLanguage")))
    return language.compare_distributions(p, "textLanguage", "spoken")


@query("t34_word_vectors")
def _(spark, d):
    # cleaned once for the words, the training and the mean vectors
    p = written(t.posts(spark, d).select("post_id", text.clean_tokens("text", STOP).alias("tokens")))
    from pyspark.ml.functions import vector_to_array
    model = topics.word_vectors(p, "tokens")
    return model.transform(p).select("post_id", F.size(vector_to_array("vector")).alias("dimensions"))


@query("t35_tfidf_matrix")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    # the features and the tokens are written once; the fit and the matrix read them
    p = written(virality.features(t.posts(spark, d), stop=STOP).select("post_id", "tokens", *virality.NUMERIC))
    data = virality.with_grams(p)
    model = virality.assembler().fit(data)
    return model.transform(data).select("post_id", F.size(F.filter(vector_to_array("_text"), lambda x: x != 0)).alias("terms"))


@query("t37_keyword_rule_classifier")
def _(spark, d):
    from vidtrend.plans import sentiment
    # cleaned once for the fit and for the report
    p = written(t.posts(spark, d).select("post_id", text.clean_tokens("text", STOP).alias("tokens"),
                                         ml.keyword_label("text", ["rewh", "orre", "thanedble"]).alias("label")))
    model = sentiment.train_classifier(p, "tokens", "label", 1 << 12)
    return ml.classification_report(model.transform(p)).select("class", "support")
