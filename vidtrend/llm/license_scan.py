"""License scan by diagonal voting, with DataFrame functions only.

1. Grams. A text's words (A-Z lower-cased) give one rolling hash per position and gram length: all
   grams of ``LONG`` words for notices and of two words for phrases and short forms.
2. Join. The exploded hashes are joined to the template positions that hold the same gram. Templates
   are a bounded parameter, so that side is broadcast; the words themselves are compared too. A first
   element that always joins carries the row's word count, so texts are read once.
3. Votes. A hit at word ``p`` of the text and position ``t`` of a template votes for the diagonal
   ``p - t``, where the template would start. Votes are added up per (row, template, diagonal).
4. Merging. Diagonals at most ``slack`` words from the one before are the same place with words put in or
   left out. Phrases (complete by definition) are not merged.
5. Verification. A place counts if the template grams found there, each once, cover at least ``share``
   of the template and are not spread over more than twice the template's length.

The score is the best cover of a row, 1 where a phrase stands. Defined results: a null or empty text has
no words, no labels (empty text) and score 0. Every row is scanned on its own, so repeated rows and ids
and null ids do not meet; texts are read whole; ties do not arise, since labels are sorted and places
counted. Other columns are handed through or ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtrend.llm.common import stored
from vidtrend.llm.license_texts import NOTICES, PHRASES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between the same words before A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LONG, SHORT = 4, 2
SLACK = 3
SHARE = 0.6
#: Words of all templates together: the size of the broadcast side.
MOST_WORDS = 200_000


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> list[tuple]:
    """``(number, label, is phrase, gram length, words)`` of every template."""
    out = []
    for phrase, texts in ((True, phrases), (False, notices)):
        for label, text in texts:
            words = words_of(text)
            if len(words) < 2:
                raise ValueError(f"a template needs two words: {text!r}")
            # a short form is all in its few words, so it is matched by pairs
            out.append((len(out), label, phrase, SHORT if phrase or len(words) < 4 * LONG else LONG, words))
    if sum(len(t[4]) for t in out) > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} words")
    return out


def _with_grams(rows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Adds rolling hashes ``h<k>`` of the array ``words``: every word is hashed once, longer grams combine two shorter ones.

    Words are folded by ``lower``, which also joins words that A-Z alone would keep apart; the words
    themselves are compared after the join. Each length is a projection of its own, so none is computed twice.
    """
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    needed, known = list(lengths), {1}
    for k in needed:  # the list grows by the parts of its members
        first = 1 << (k - 1).bit_length() - 1
        needed += [part for part in (first, k - first) if part > 1 and part not in needed]
    for k in sorted(set(needed) - known):
        first, count = 1 << (k - 1).bit_length() - 1, F.greatest(F.size("words") - (k - 1), F.lit(0))
        rows = rows.withColumn(f"h{k}", F.zip_with(F.slice(f"h{first}", 1, count), F.slice(f"h{k - first}", first + 1, count), lambda x, y: F.xxhash64(x, y)))
    return rows


def _positions(spark, known: list[tuple], lengths: Sequence[int]) -> DataFrame:
    """One row per template position; the row of template -1 meets the first element of every text."""
    parts = []
    for k in lengths:
        own = [(n, words) for n, _, _, length, words in known if length == k]
        table = spark.createDataFrame(own, "template int, words array<string>")
        table = _with_grams(table, [k]).select("template", "words", F.posexplode(f"h{k}").alias("at", "hash"))
        parts.append(table.select("template", F.lit(k).alias("k"), "at", F.array_join(F.slice("words", F.col("at") + 1, k), " ").alias("gram"), "hash"))
    start = spark.createDataFrame([(-1, 0, 0, "")], "template int, k int, at int, gram string")
    return reduce(DataFrame.unionByName, parts, start.withColumn("hash", F.xxhash64(F.lit(0))))


def hits(docs: DataFrame, text: str, keep: Sequence[str], known: list[tuple]) -> DataFrame:
    """Written table of a row number, the kept columns, ``n_words`` and one (template, at, place) per hit.

    Every row has a first entry of template -1, also without hits.
    """
    ids = [f"k{i}" for i in range(len(keep))]
    # split is linear in the text; regexp_extract_all copies the text for every match
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), BREAKS), "")
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, ids)], words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", *ids, "words", F.size("words").alias("n"))
    lengths = sorted({k for _, _, _, k, _ in known})
    # one explode: the first element, then all grams of each length after another
    every = F.concat(F.array(F.xxhash64(F.lit(0))), *[F.col(f"h{k}") for k in lengths])
    each = _with_grams(rows, lengths).select("row", *ids, "words", "n", F.posexplode(every).alias("pos", "hash"))
    met = each.join(F.broadcast(_positions(docs.sparkSession, known, lengths)), "hash")
    start, starts = F.lit(1), {0: F.lit(0)}
    for k in lengths:
        starts[k] = start
        start = start + F.greatest(F.col("n") - (k - 1), F.lit(0))
    first = reduce(lambda low, k: F.when(F.col("k") == k, starts[k]).otherwise(low), lengths, starts[0])
    met = met.withColumn("place", F.col("pos") - first)
    same = F.translate(F.array_join(F.slice("words", F.col("place") + 1, F.col("k")), " "), ascii_uppercase, ascii_lowercase) == F.col("gram")
    inside = (F.col("place") >= 0) & (F.col("place") + F.col("k") <= F.col("n"))
    met = met.filter(F.when(F.col("k") == 0, F.col("pos") == 0).when(inside, same).otherwise(False))
    return stored(met.select("row", *ids, F.col("n").cast("bigint").alias("n_words"), "template", "at", "place"), "hits")


def places(met: DataFrame, known: list[tuple], slack: int = SLACK) -> DataFrame:
    """``row, template, start, covered, spread``: merged diagonals with the template grams found there.

    ``covered`` counts distinct positions of the template, ``spread`` the words from first to last hit.
    """
    votes = met.filter("template >= 0").select("row", "template", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))
    lines = votes.groupBy("row", "template", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    phrase = F.col("template").isin([n for n, _, is_phrase, _, _ in known if is_phrase])
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    lines = lines.withColumn("_new", F.when(gap.isNotNull() & (gap <= F.when(phrase, 0).otherwise(slack)), 0).otherwise(1))
    lines = lines.withColumn("island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy("row", "template", "island").agg(
        F.min("low").alias("start"), (F.max("high") - F.min("low")).alias("spread"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
    return merged.drop("island")


def scan(docs: DataFrame, text: str, keep: Sequence[str], known: list[tuple] | None = None, slack: int = SLACK,
         share: float = SHARE) -> DataFrame:
    """Kept columns, ``n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    known = known or templates()
    met = hits(docs, text, keep, known)
    shape = docs.sparkSession.createDataFrame(
        [(n, label, phrase, len(words) - k + 1, len(words)) for n, label, phrase, k, words in known],
        "template int, label string, phrase boolean, grams int, words int")
    found = places(met, known, slack).join(F.broadcast(shape), "template")
    cover = F.col("covered") / F.col("grams")
    whole = F.col("phrase") & (cover == 1)
    verified = whole | (~F.col("phrase") & (cover >= share) & (F.col("spread") <= 2 * F.col("words")))
    labels = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    verdict = found.groupBy("row").agg(
        F.sum(whole.cast("bigint")).alias("n_base"), F.min(F.when(whole, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("bigint").alias("last_word"), labels(whole).alias("base_labels"),
        labels(verified).alias("labels"), F.max(F.when(whole | ~F.col("phrase"), cover)).alias("score"))
    rows = met.filter("template = -1").select("row", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words")
    zero = {"n_base": F.lit(0).cast("bigint"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(verdict, "row", "left").drop("row")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words", *[
        F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c)
        for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def oracle(known: list[tuple] | None = None, slack: int = SLACK, share: float = SHARE) -> str:
    """The same verdicts in SQL, over ``documents``."""
    rows = ", ".join(f"({n}, '{label}', {phrase}, {k}, {words!r})" for n, label, phrase, k, words in known or templates())
    return rf"""
WITH tpl(n, label, phrase, k, w) AS (VALUES {rows}),
pos AS (SELECT n, k, t - 1 AS tpos, array_to_string(w[t : t + k - 1], ' ') AS gram FROM tpl, range(1, 400) r(t) WHERE t + k - 1 <= len(w)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT row, k, unnest(range(len(w) - k + 1)) AS place, unnest([array_to_string(w[i + 1 : i + k], ' ') FOR i IN range(len(w) - k + 1)]) AS gram
      FROM d, (SELECT DISTINCT k FROM tpl) WHERE len(w) >= k),
v AS (SELECT DISTINCT row, n, tpos, place, place - tpos AS diagonal FROM g JOIN pos USING (k, gram)),
l AS (SELECT row, n, diagonal, min(place) AS low, max(place) AS high FROM v GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER p <= CASE WHEN phrase THEN 0 ELSE {slack} END THEN 0 ELSE 1 END AS fresh
      FROM l JOIN tpl USING (n) WINDOW p AS (PARTITION BY row, n ORDER BY diagonal)),
i AS (SELECT row, n, diagonal, sum(fresh) OVER (PARTITION BY row, n ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT row, n, island, min(place) AS start, max(place) - min(place) AS spread, count(DISTINCT tpos) AS covered FROM v JOIN i USING (row, n, diagonal) GROUP BY ALL),
f AS (SELECT row, label, phrase, start, covered / (len(w) - k + 1) AS cover, phrase AND covered = len(w) - k + 1 AS whole, spread <= 2 * len(w) AS dense
      FROM c JOIN tpl USING (n)),
r AS (SELECT row, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR (NOT phrase AND cover >= {share} AND dense)) AS labels,
             max(cover) FILTER (whole OR NOT phrase) AS score FROM f GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN r USING (row)
"""


SQL = oracle()
