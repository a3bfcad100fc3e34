"""Dictionary matches, sentiment and routines."""

from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.functions.scalars import SOCIAL, engagement_rate
from vidtrend.operators import filters
from vidtrend.plans import entities, sentiment
from vidtrend.queries import adapters as t
from vidtrend.queries import sqltext as q
from vidtrend.queries.registry import query

# frequent words of the given texts stand in for ingredients, brands and routine steps
TERMS = {"article": ["the", "der", "la", "le"], "linking": ["and", "und", "et"], "pair": ["of the", "de la"],
         "rare": ["rewh", "thanedble", "orre"], "phrase": ["attion to", "anea eriner"]}
LEXICON = {"thanedble": 1.9, "eriner": 1.2, "rewh": -2.1, "orre": -1.3, "attion": 0.8, "ha": 1.0, "ing": -0.4, "von": -0.6, "les": 0.3}
NEGATE = ("the", "que")
_PAIRS = [(term, name) for name, terms in TERMS.items() for term in terms]
_VALUES = ", ".join(f"('{term}', '{name}')" for term, name in _PAIRS)
_DICT = f"dict(term, entity) AS (VALUES {_VALUES})"
_PART = f"WITH {_DICT}, m AS (SELECT DISTINCT p.*, entity FROM {{t}} p JOIN dict ON contains(lower(text), term))"


def _whole(table, col="text"):
    """m: one row per (row of the table, matched entity), with constant patterns only."""
    low = f"replace(lower({col}), '’', '''')"
    parts = [f"SELECT p.*, '{name}' AS entity FROM {table} p WHERE " + " OR ".join(q.word_hit(low, term) for term in terms)
             for name, terms in TERMS.items()]
    return "WITH m AS (" + " UNION ALL ".join(parts) + ")"


def scored(spark, d):
    return t.scored_posts(spark, d)


@query("t6_whole_word_match", _whole("posts") + " SELECT post_id, string_agg(entity, ', ' ORDER BY entity) AS entities FROM m GROUP BY 1")
def _(spark, d):
    return t.posts(spark, d).select("post_id", entities.match("text", TERMS).alias("entities")).filter(F.size("entities") > 0)


@query("j13_dictionary_join", _whole("posts") + " SELECT post_id, entity AS canonical FROM m")
def _(spark, d):
    dictionary = spark.createDataFrame(_PAIRS, "term string, canonical string")
    # a gram join cannot see punctuation between two words, so multi-word hits are confirmed
    hits = entities.match_rows(t.posts(spark, d), "post_id", "text", dictionary)
    confirmed = entities.matched(t.posts(spark, d), "text", TERMS, True, "canonical").select("post_id", "canonical")
    return hits.join(confirmed, ["post_id", "canonical"], "left_semi")


# license lines of the given texts: terms longer than any other here
LONG_TERMS = [("licensed under the apache license version 2", "apache"), ("gnu general public license version 3", "gnu"),
              ("all rights reserved", "reserved"), ("the", "article")]


@query("j13_long_terms", """WITH w AS (SELECT post_id, ' ' || array_to_string(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1), ' ') || ' ' AS w FROM posts),
 dict(term, canonical) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in LONG_TERMS) + """)
SELECT post_id, canonical FROM w JOIN dict ON contains(w, ' ' || term || ' ')""")
def _(spark, d):
    dictionary = spark.createDataFrame(LONG_TERMS, "term string, canonical string")
    return entities.match_rows(t.posts(spark, d), "post_id", "text", dictionary)


@query("t7_substring_match", _PART.format(t="posts") + " SELECT post_id, string_agg(entity, ', ' ORDER BY entity) AS entities FROM m GROUP BY 1")
def _(spark, d):
    return t.posts(spark, d).select("post_id", entities.match("text", TERMS, False).alias("entities")).filter(F.size("entities") > 0)


@query("t8_brand_mentions", _whole("posts") + " SELECT entity AS brand, count(*) AS mentions FROM m GROUP BY 1")
def _(spark, d):
    return entities.mention_counts(t.posts(spark, d), "text", TERMS, True, "brand")


@query("t10_mention_counts", _PART.format(t="posts") + " SELECT entity, count(*) AS mentions FROM m GROUP BY 1")
def _(spark, d):
    return entities.mention_counts(t.posts(spark, d), "text", TERMS)


# words are joined by two blanks, so neighbouring terms do not share one; longer terms come first and use up their words
_BY_LENGTH = sorted(_PAIRS, key=lambda p: -len(p[0].split()))
_ANY = " (" + "|".join(term.replace(" ", "  ") for term, _ in _BY_LENGTH) + ") "
_NAME = "CASE " + " ".join(f"WHEN x = '{term.replace(' ', '  ')}' THEN '{name}'" for term, name in _PAIRS) + " END"
_SEQ = rf"""WITH k AS (SELECT conv_id * 100 + turn AS id, conv_id, ' ' || array_to_string(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1), '  ') || ' ' AS w FROM conversations),
 s AS (SELECT id, conv_id, list_transform(regexp_extract_all(w, '{_ANY}', 1), lambda x: {_NAME}) AS seq FROM k),
 el AS (SELECT id, unnest(seq) AS e, generate_subscripts(seq, 1) AS pos FROM s),
 nr AS (SELECT * FROM (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY pos) AS p FROM el) WHERE p IS NULL OR p <> e)"""


def _comments(spark, d):
    return t.comments(spark, d).withColumn("id", F.col("comment_id"))


@query("t9_term_sequence", _SEQ + " SELECT id, array_to_string(seq, ', ') AS sequence FROM s WHERE len(seq) > 0")
def _(spark, d):
    return _comments(spark, d).select("id", entities.sequence("comment", TERMS).alias("sequence")).filter(F.size("sequence") > 0)


@query("t12_step_transitions", _SEQ + """, tr AS (SELECT lag(e) OVER (PARTITION BY id ORDER BY pos) AS from_step, e AS to_step FROM nr)
SELECT from_step, to_step, count(*) AS n FROM tr WHERE from_step IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return entities.transitions(_comments(spark, d), "comment", TERMS)


@query("t12_routines", _SEQ + """, r AS (SELECT id, string_agg(e, ' > ' ORDER BY pos) AS routine, count(*) AS k FROM nr GROUP BY 1)
SELECT routine, count(*) AS n, min(id) AS example_id FROM r WHERE k >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, d):
    return entities.routines(_comments(spark, d), "id", "comment", TERMS, minimum=2)


# frequent words stand in for the time-of-day words; the last listed hit wins
TIMES = (("the", "morning"), ("der", "night"), ("la", "night"), ("of the", "morning"))
_TIME = "CASE " + " ".join(f"WHEN {q.word_hit('lower(text)', w)} THEN '{v}'" for w, v in TIMES[::-1]) + " END"


@query("t11_steps_by_time", _PART.format(t="posts") + f", c AS (SELECT {_TIME} AS time_of_day, entity AS step, count(*) AS n FROM m GROUP BY 1, 2) SELECT time_of_day, step, n, R6(n * 100.0 / sum(n) OVER (PARTITION BY time_of_day)) AS pct FROM c WHERE time_of_day IS NOT NULL")
def _(spark, d):
    return entities.steps_by_time(t.posts(spark, d), "text", TERMS, text.time_of_day("text", words=TIMES))


@query("t11_step_sentences", f"""WITH {_DICT}, s AS (SELECT post_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1␞', 'g'), '␞'), lambda y: trim(y) <> '') AS ss FROM posts),
 e AS (SELECT post_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_no FROM s)
SELECT DISTINCT post_id, sentence_no, entity AS step FROM e JOIN dict ON contains(lower(sentence), term)""")
def _(spark, d):
    return entities.step_sentences(t.posts(spark, d), "post_id", "text", TERMS).select("post_id", "sentence_no", "step")


_LEX = "lex(token, v) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items()) + ")"


@query("t18_lexicon_sentiment", rf"""WITH {_LEX}, w AS (SELECT post_id, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1) AS ws FROM posts),
 e AS (SELECT post_id, unnest(ws) AS token, unnest(list_transform(range(0, len(ws)), lambda i: CASE WHEN i >= 1 AND ws[i] IN ({q.quoted(NEGATE)}) THEN -1.0 ELSE 1.0 END)) AS sign FROM w),
 s AS (SELECT post_id, sum(sign * v) AS sc FROM e JOIN lex USING (token) GROUP BY 1), c AS (SELECT p.post_id, round(coalesce(sc, 0) / sqrt(coalesce(sc, 0) * coalesce(sc, 0) + 15), 9) AS c FROM posts p LEFT JOIN s USING (post_id))
SELECT post_id, R6(c) AS compound, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment, R6(abs(c)) AS confidence FROM c""")
def _(spark, d):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    return sentiment.lexicon(t.posts(spark, d), "post_id", "text", lexicon, NEGATE).select("post_id", "compound", "sentiment", "confidence")


@query("t19_batch_scorer", rf"""WITH {_LEX}, e AS (SELECT post_id, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1)) AS token FROM posts),
 s AS (SELECT post_id, sum(v) AS sc FROM e JOIN lex USING (token) GROUP BY 1), c AS (SELECT p.post_id, coalesce(sc, 0) / sqrt(coalesce(sc, 0) * coalesce(sc, 0) + 15) AS c FROM posts p LEFT JOIN s USING (post_id))
SELECT post_id, CASE WHEN round(abs(c), 9) >= 0.65 THEN CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END END AS sentiment, R6(abs(c)) AS confidence FROM c""")
def _(spark, d):
    return sentiment.score(t.posts(spark, d).select("post_id", "text"), "text", sentiment.lexicon_scorer(LEXICON)).select("post_id", "sentiment", "confidence")


@query("t19_trained_scorer")
def _(spark, d):
    p = scored(spark, d).select("post_id", text.clean_tokens("text").alias("tokens"), "sentiment")
    p = p.withColumn("label", F.array_position(F.array(*[F.lit(x) for x in entities.LABELS]), F.col("sentiment")).cast("double") - 1).drop("sentiment")
    model = sentiment.train_classifier(p, "tokens", "label", 1 << 12)
    return sentiment.classify(model, p, entities.LABELS, 0.65).groupBy("sentiment").agg(F.count("*").alias("n"))


_MIX = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in entities.LABELS)


@query("q19_entity_sentiment", _whole("scored_posts") + f", c AS (SELECT entity, {_MIX} FROM m GROUP BY 1) SELECT *, negative + neutral + positive AS total_mentions, "
       + ", ".join(f"R6({s} * 100.0 / (negative + neutral + positive)) AS {s}_pct" for s in entities.LABELS) + " FROM c")
def _(spark, d):
    return entities.sentiment_summary(entities.matched(filters.played_text(scored(spark, d)), "text", TERMS))


@query("q19_entity_examples", _whole("scored_posts") + """, c AS (SELECT entity, sentiment, max(confidence) AS confidence, arg_max(post_id, row(confidence, post_id)) AS example_id FROM m GROUP BY 1, 2)
SELECT entity, sentiment, R6(confidence) AS confidence, example_id FROM c WHERE entity IN (SELECT entity FROM m GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    m = entities.matched(scored(spark, d), "text", TERMS).withColumn("example_id", F.col("post_id"))
    return entities.examples(m, fields=["example_id"], tie="post_id", more_than=1)


@query("q20_daily_entity_mentions", _PART.format(t="posts") + """, pd AS (SELECT CAST("createTimeISO" AS DATE) AS dd, count(DISTINCT post_id) AS posts FROM posts GROUP BY 1),
 top AS (SELECT entity FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), c AS (SELECT CAST("createTimeISO" AS DATE) AS dd, entity, count(*) AS mentions FROM m JOIN top USING (entity) GROUP BY 1, 2)
SELECT CAST(dd AS VARCHAR) AS date, entity, mentions, posts, R6(mentions / posts) AS relative FROM c JOIN pd USING (dd)""")
def _(spark, d):
    return entities.daily_mentions(t.posts(spark, d), "text", TERMS, "createTimeISO", "post_id", 3)


@query("q20_entity_engagement", _PART.format(t="posts") + """ SELECT entity, R6(avg(("diggCount" + "commentCount" + "shareCount" + "collectCount") / nullif("playCount", 0))) AS engagement_rate, count(*) AS mentions FROM m GROUP BY 1 HAVING count(*) >= 20""")
def _(spark, d):
    return entities.engagement_by_entity(t.posts(spark, d), "text", TERMS, engagement_rate(SOCIAL))


@query("q21_brand_sentiment", _whole("scored_posts") + f", c AS (SELECT entity AS brand, {_MIX} FROM m GROUP BY 1) SELECT *, negative + neutral + positive AS total, "
       + ", ".join(f"R6(REVEN({s} / (negative + neutral + positive))) AS pct_{s}" for s in entities.LABELS) + " FROM c")
def _(spark, d):
    return entities.brand_summary(entities.matched(scored(spark, d), "text", TERMS, True, "brand"))


@query("q21_brand_examples", _whole("scored_posts") + """ SELECT entity AS brand, sentiment, R6(max(confidence)) AS confidence, arg_max("textLanguage", row(confidence, post_id)) AS "textLanguage", arg_max(post_id, row(confidence, post_id)) AS example_id FROM m GROUP BY 1, 2""")
def _(spark, d):
    m = entities.matched(scored(spark, d), "text", TERMS, True, "brand").withColumn("example_id", F.col("post_id"))
    return entities.examples(m, "brand", fields=["textLanguage", "example_id"], tie="post_id")
