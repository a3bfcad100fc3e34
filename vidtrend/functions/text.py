"""Text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.find_spark_home import _find_spark_home
from pyspark.sql import Column
from pyspark.sql import functions as F

from vidtrend.functions import fixed

WORD = r"[\p{L}\p{N}_]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: str | Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also when ``use`` reads it in a lambda.

    An expression that occurs inside a lambda is otherwise recomputed for every element.
    """
    return F.get(F.transform(F.array(_c(value)), use), F.lit(0))


@lru_cache
def _language_stop_words(language: str) -> tuple[str, ...]:
    """The list Spark ships for StopWordsRemover, read from its jar (needs no session)."""
    jar = glob.glob(os.path.join(_find_spark_home(), "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as archive:
        raw = archive.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt")
    return tuple(w.strip().lower() for w in raw.decode("utf-8").splitlines() if w.strip())


def stopwords(languages: Sequence[str] = ("english", "german"),
              extra: Iterable[str] = fixed.FILLER_WORDS) -> list[str]:
    words = {w for lang in languages for w in _language_stop_words(lang)}
    return sorted(words | set(extra))


def clean(col: str | Column, stop: Sequence[str] = (), keep: str = "", max_run: int = 1,
          min_len: int = 3) -> Column:
    """Lower-case, drop URLs, mentions and symbols, shorten character runs, drop short/stop words."""
    return F.array_join(clean_tokens(col, stop, keep, max_run, min_len), " ")


def clean_tokens(col: str | Column, stop: Sequence[str] = (), keep: str = "", max_run: int = 1,
                 min_len: int = 3) -> Column:
    text = F.regexp_replace(F.lower(_c(col)), fixed.URL_OR_MENTION, " ")
    text = F.regexp_replace(text, f"[{fixed.EMOTICONS}]", " $0 ")
    text = F.regexp_replace(text, rf"[^{fixed.LETTERS}0-9\s{keep}{fixed.EMOTICONS}]+", " ")
    text = F.regexp_replace(text, r"(\S)\1{2,}", "$1" * max_run)
    return keep_tokens(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), stop, min_len)


def keep_tokens(tokens: Column, stop: Sequence[str] = (), min_len: int = 1) -> Column:
    stop = list(stop)
    if stop:
        return F.filter(tokens, lambda t: (F.length(t) >= min_len) & ~t.isin(stop))
    return F.filter(tokens, lambda t: F.length(t) >= min_len)


def letter_tokens(col: str | Column, stop: Sequence[str] = (), min_len: int = 3) -> Column:
    """Words made of letters only (everything else separates), without stop words.

    The text is in lower case, so the class needs no A-Z; with both ranges the pattern is many times slower.
    """
    text = F.regexp_replace(F.lower(_c(col)), "[^a-zäöüß]+", " ")
    return keep_tokens(F.split(F.trim(text), " "), stop, min_len)


def whitespace_tokens(col: str | Column) -> Column:
    return F.filter(F.split(_c(col), r"\s+"), lambda t: t != "")


def caption_tokens(col: str | Column, stop: Sequence[str] = (), min_len: int = 2) -> Column:
    """Whitespace tokens without tags, mentions and links, reduced to letters."""
    raw = F.filter(whitespace_tokens(collapse_repeated_words(F.lower(_c(col)))), lambda t: ~(
        t.startswith("#") | t.startswith("@") | t.contains("http") | t.contains("www.")))
    return keep_tokens(
        F.transform(raw, lambda t: F.regexp_replace(t, f"[^{fixed.LETTERS}]", "")), stop, min_len)


def word_tokens(col: str | Column, min_len: int = 2) -> Column:
    """Runs of word characters (letters, digits, underscore) of at least ``min_len``."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(f"({WORD}{{{min_len},}})"), 1)


def collapse_repeated_words(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), r"(?U)\b(\w+)( \1\b)+", "$1")


def strip_digits_symbols(col: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\s]", ""), r"\s+", " "))


def ngrams(tokens: str | Column, n: int) -> Column:
    return ngram_range(tokens, n, n)


def ngram_range(tokens: str | Column, low: int, high: int) -> Column:
    if low == high == 1:
        return _c(tokens)
    return bind(tokens, lambda ts: F.concat(*[_runs(ts, n) for n in range(low, high + 1)]))


def _runs(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                    lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def hashtags(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(f"#({WORD}+)"), 1)


def strip_hashtags(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), f"#{WORD}+", "")


def combine(*cols: str | Column, skip_null: bool = False) -> Column:
    """Join text columns with a blank, lower-cased, with straight apostrophes."""
    parts = [_c(c) if skip_null else F.coalesce(_c(c), F.lit("")) for c in cols]
    return F.replace(F.lower(F.concat_ws(" ", *parts)), F.lit("’"), F.lit("'"))


def normalise_slang(col: str | Column, slang: Mapping[str, str] = fixed.SLANG,
                    keep_emphasis: bool = True) -> Column:
    """Mentions, tags and links become tokens, long runs become three, slang is spelled out."""
    text = F.regexp_replace(F.lower(_c(col)), f"@{WORD}+", "[USER_MENTION]")
    text = F.regexp_replace(text, f"#({WORD}+)", "hashtag_$1")
    text = F.regexp_replace(text, r"http\S+|www\S+", "[URL]")
    text = F.regexp_replace(text, r"(.)\1{3,}", "$1$1$1")
    for word, plain in slang.items():
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", plain)
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s!?.']" if keep_emphasis else r"[^\p{L}\p{N}_\s']", " ")
    return F.array_join(keep_tokens(F.split(F.trim(text), r"\s+"), (), 2), " ")


def statistics(col: str | Column) -> dict[str, Column]:
    """Word, sentence, exclamation and question counts and mean word length of the raw text."""
    words = whitespace_tokens(col)
    sentences = F.filter(F.split(_c(col), r"[.!?]+"), lambda s: F.trim(s) != "")
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return {
        "word_count": F.size(words),
        "sentence_count": F.size(sentences),
        "avg_word_length": F.coalesce(F.try_divide(total.cast("double"), F.size(words)), F.lit(0.0)),
        "exclamation_count": F.length(_c(col)) - F.length(F.replace(_c(col), F.lit("!"), F.lit(""))),
        "question_count": F.length(_c(col)) - F.length(F.replace(_c(col), F.lit("?"), F.lit(""))),
    }


def emojis(col: str | Column, runs: bool = False) -> Column:
    """Emoji of the text, one by one or as unbroken runs."""
    return F.regexp_extract_all(_c(col), F.lit(f"([{fixed.EMOJI_RANGES}]{'+' if runs else ''})"), 1)


def sentences(col: str | Column) -> Column:
    return F.filter(F.split(_c(col), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def has_repeated_word(col: str | Column, times: int = 5) -> Column:
    """True when one whitespace token occurs ``times`` or more; linear after one array sort."""
    ordered = F.array_sort(whitespace_tokens(F.lower(_c(col))))
    step = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")),
        lambda a, t: F.struct(
            t.alias("w"),
            F.when(a["w"] == t, a["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.greatest(a["m"], F.when(a["w"] == t, a["n"] + 1).otherwise(F.lit(1))).alias("m")))
    return step["m"] >= times


def thrice_repeated(col: str | Column) -> Column:
    return F.coalesce(F.lower(_c(col)).rlike(r"(?U)\b(\w+)(\s+\1){2,}\b"), F.lit(False))


def matches_any(col: str | Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(_c(col).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def contains_any(col: str | Column, terms: Sequence[str]) -> Column:
    hit = bind(F.lower(_c(col)), lambda text: F.exists(
        F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)))
    return F.coalesce(hit, F.lit(False))


def time_of_day(col: str | Column, policy: str = "last",
                words: Sequence[tuple[str, str]] = tuple(fixed.TIME_WORDS)) -> Column:
    """Morning or night by whole-word key phrases; the first or the last listed phrase wins."""
    words = words if policy == "first" else words[::-1]
    text = F.lower(_c(col))
    out = None
    for word, label in words:
        hit = text.rlike(rf"(?U)(?<!\w){word}(?!\w)")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def country_of(address: str | Column) -> Column:
    found = F.trim(F.substring_index(_c(address), ",", -1))
    return F.when(found == "", F.lit(None)).otherwise(found)


def distinct_words(phrase: str | Column) -> Column:
    return F.size(F.array_distinct(F.split(_c(phrase), " ")))
