"""Dictionary matches (ingredients, brands, products, routine steps) and their sentiment."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.operators import aggregates, windows
from vidtrend.operators.scale import best, calendar_broadcast, checked_broadcast
from vidtrend.operators.substrings import contained_terms
from vidtrend.session import cut_lineage

MAX_LITERAL_TERMS = 5_000
LABELS = ("negative", "neutral", "positive")


def term_pairs(dictionary: Mapping[str, Sequence[str]] | Sequence[str]) -> list[tuple[str, str]]:
    """(term, canonical) pairs of a dictionary or of a plain list, lower-cased and distinct."""
    if not isinstance(dictionary, Mapping):
        dictionary = {t: [t] for t in dictionary}
    return sorted({(t.strip().lower(), name) for name, terms in dictionary.items() for t in terms})


def as_terms(dictionary: Mapping[str, Sequence[str]] | Sequence[str]) -> list[tuple[str, str]]:
    """The pairs of a dictionary that is short enough for an expression."""
    pairs = term_pairs(dictionary)
    if len(pairs) > MAX_LITERAL_TERMS:
        raise ValueError("dictionary too long for a literal; use matched or match_rows")
    return pairs


def _words(col: Column) -> Column:
    return F.array_remove(F.split(col, r"[^\p{L}\p{N}_]+"), "")


def _key(term: str) -> str:
    return " ".join(re.findall(r"\w+", term))


def _value(col: str | Column) -> Column:
    value = F.coalesce(F.lower(F.col(col) if isinstance(col, str) else col), F.lit(""))
    return F.replace(value, F.lit("’"), F.lit("'"))


def _canonicals(pairs: Sequence[tuple[str, str]], terms: Column) -> Column:
    groups: dict[str, list[str]] = {}
    for term, name in pairs:
        groups.setdefault(term, []).append(name)
    table = F.create_map(*[x for t, names in groups.items()
                           for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: table[t])))


def match(col: str | Column, dictionary: Mapping[str, Sequence[str]] | Sequence[str],
          whole_word: bool = True) -> Column:
    """Array of the canonical names whose terms occur in the text, each once; no shuffle.

    Whole-word matching looks the text's 1..k-word runs up in a hash of the terms, so its cost
    grows with the text, not with text x dictionary. Terms with blanks, hyphens or apostrophes
    are confirmed against the text itself.
    """
    pairs = as_terms(dictionary)
    value = _value(col)
    terms = sorted({t for t, _ in pairs})
    find = _find_words if whole_word else _find_substrings
    return F.array_sort(_canonicals(pairs, text.bind(value, lambda v: find(v, terms))))


def _find_substrings(value: Column, terms: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(value, t))


def _find_words(value: Column, terms: Sequence[str]) -> Column:
    longest = max(len(_key(t).split()) for t in terms)
    plain = [t for t in terms if re.fullmatch(r"\w+", t)]
    phrased = [t for t in terms if t not in set(plain)]
    by_key: dict[str, list[str]] = {}
    for t in phrased:
        by_key.setdefault(_key(t), []).append(t)
    quoted = lambda t: F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))

    def from_runs(seen: Column) -> Column:
        # ``isin`` with literals is one hash set for the whole query, not one per row
        parts = [F.filter(seen, lambda g: g.isin(plain))] if plain else []
        if phrased:
            table = F.create_map(*[x for k, ts in by_key.items()
                                   for x in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])
            keys = F.filter(seen, lambda g: g.isin(list(by_key)))
            candidates = F.flatten(F.transform(F.array_distinct(keys), lambda k: table[k]))
            parts.append(F.filter(candidates, lambda t: F.regexp_like(value, quoted(t))))
        return F.array_distinct(F.concat(*parts))

    return text.bind(text.ngram_range(_words(value), 1, longest), from_runs)


def match_rows(df: DataFrame, id_col: str, col: str, dictionary: DataFrame) -> DataFrame:
    """(id, canonical) for a dictionary table (canonical, term) of any size, by an equi-join.

    Word runs of each text that may be terms are joined to the terms. Up to ``MAX_LITERAL_TERMS`` terms, those
    are the runs that start with the first word of a term of their length; beyond that, all runs as long as a term.
    The dictionary is broadcast only when its row count allows it, otherwise frequent words are split by the skew rule.
    """
    words = dictionary.select(_words(F.lower("term")).alias("_w"), "canonical").filter(F.size("_w") > 0)
    lengths = sorted(r[0] for r in words.select(F.size("_w")).distinct().collect())  # term lengths, a few numbers
    heads = words.select(F.size("_w").alias("n"), F.col("_w")[0].alias("w")).distinct().limit(MAX_LITERAL_TERMS + 1).collect()
    terms = checked_broadcast(words.select(F.array_join("_w", " ").alias("_gram"), "canonical"))
    if len(heads) <= MAX_LITERAL_TERMS:
        def some(ws: Column, n: int) -> Column:
            first = sorted(r.w for r in heads if r.n == n)
            if n == 1:
                return F.filter(ws, lambda w: w.isin(first))
            runs = F.transform(ws, lambda w, i: F.when(w.isin(first) & (i + n <= F.size(ws)), F.array_join(F.slice(ws, i + 1, n), " ")))
            return F.array_compact(runs)
    else:
        some = text.ngrams
    empty = F.array().cast("array<string>")
    grams = text.bind(_words(F.lower(F.col(col))), lambda ws: F.array_distinct(F.concat(empty, *[some(ws, n) for n in lengths])))
    runs = df.select(id_col, F.explode(grams).alias("_gram"))
    return runs.join(terms, "_gram").select(id_col, "canonical").distinct()


def matched(df: DataFrame, col: str | Column, dictionary, whole_word: bool = True, name: str = "entity") -> DataFrame:
    """One row per (row, canonical name); a dictionary too long for an expression is met by a gram index."""
    pairs = term_pairs(dictionary)
    if len(pairs) <= MAX_LITERAL_TERMS:
        return df.withColumn(name, F.explode(match(col, dictionary, whole_word)))
    if whole_word:  # a term without words is no whole word
        pairs = [(term, canonical) for term, canonical in pairs if _key(term)]
    table = df.sparkSession.createDataFrame(pairs, "_term string, _name string")
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    met = contained_terms(rows.select("_row", _value(col).alias("_value")), "_value", table.withColumnRenamed("_term", "term"), "term", whole_word)
    names = met.join(table, F.col("term") == F.col("_term")).select("_row", F.col("_name").alias(name)).distinct()
    return rows.join(names, "_row").drop("_row")


def mention_counts(df: DataFrame, col: str, dictionary, whole_word: bool = False, name: str = "entity") -> DataFrame:
    return matched(df, col, dictionary, whole_word, name).groupBy(name).agg(F.count("*").alias("mentions"))


def sequence(col: str, dictionary) -> Column:
    """Canonical names in the order their terms appear.

    The longest term that starts at a word wins, and the words it covers start no other term.
    """
    keyed: dict[str, str] = {}
    for term, name in as_terms(dictionary):
        keyed.setdefault(_key(term), name)
    by_length: dict[int, dict[str, list[str]]] = {}
    for key, name in keyed.items():
        by_length.setdefault(len(key.split()), {}).setdefault(name, []).append(key)

    def walk(words: Column) -> Column:
        def named(i, n):
            run = F.array_join(F.slice(words, i, n), " ")
            return text.bind(run, lambda r: F.coalesce(*[F.when(r.isin(keys), F.struct(F.lit(name).alias("name"), F.lit(n).alias("n")))
                                                         for name, keys in by_length[n].items()]))

        def step(acc, i):
            hit = F.coalesce(*[F.when(i + n - 1 <= F.size(words), named(i, n)) for n in sorted(by_length, reverse=True)])
            return F.when(i < acc["free"], acc).otherwise(text.bind(hit, lambda h: F.when(h.isNull(), acc).otherwise(F.struct(
                (i + h["n"]).alias("free"), F.concat(acc["found"], F.array(h["name"])).alias("found")))))

        start = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("found"))
        return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step)["found"]).otherwise(
            F.array().cast("array<string>"))

    return text.bind(_words(F.coalesce(F.lower(F.col(col)), F.lit(""))), walk)


def sentiment_summary(df: DataFrame, key: str = "entity", sentiment: str = "sentiment", order: bool = True) -> DataFrame:
    """Percent of each sentiment per entity and its total, most mentioned first."""
    table = aggregates.crosstab(df, key, sentiment, LABELS)
    table = aggregates.row_shares(table, list(LABELS), 100.0, "_pct", "total_mentions")
    return table.orderBy(F.desc("total_mentions"), key) if order else table


def brand_summary(df: DataFrame, key: str = "brand", sentiment: str = "sentiment") -> DataFrame:
    table = aggregates.crosstab(df, key, sentiment, LABELS)
    table = aggregates.row_shares(table, list(LABELS), 1.0, "_share", "total")
    return table.withColumns({f"pct_{x}": F.rint(F.col(f"{x}_share") * 100) / 100 for x in LABELS}).drop(
        *[f"{x}_share" for x in LABELS])


def examples(df: DataFrame, key: str = "entity", sentiment: str = "sentiment", confidence: str = "confidence",
             fields: Sequence[str] = ("comment",), tie: str = "comment_id", more_than: int = 0) -> DataFrame:
    """The most confident row per (entity, sentiment), for entities with enough mentions."""
    base = df.na.drop(subset=[key, sentiment])
    table = base.groupBy(key, sentiment).agg(
        F.count("*").alias("_n"), F.max(confidence).alias(confidence),
        *[best(f, confidence, tie).alias(f) for f in fields])
    if more_than:
        enough = table.groupBy(key).agg(F.sum("_n").alias("_t")).filter(F.col("_t") > more_than)
        table = table.join(enough.select(key), key, "left_semi")
    return table.drop("_n")


def daily_mentions(df: DataFrame, col: str, dictionary, ts: str, post: str, top: int = 5,
                   whole_word: bool = False) -> DataFrame:
    """Mentions per day over the day's distinct posts, for the most mentioned names."""
    dated = df.withColumn("date", F.to_date(ts))
    hits = matched(dated, col, dictionary, whole_word)
    leaders = aggregates.counts(hits, "entity").orderBy(F.desc("n"), "entity").limit(top)
    posts = dated.select("date", post).distinct().groupBy("date").agg(F.count("*").alias("posts"))
    counts = hits.join(F.broadcast(leaders.select("entity")), "entity").groupBy("date", "entity").agg(
        F.count("*").alias("mentions"))
    return counts.join(calendar_broadcast(posts), "date").withColumn("relative", F.col("mentions") / F.col("posts"))


def engagement_by_entity(df: DataFrame, col: str, dictionary, rate: Column, minimum: int = 20) -> DataFrame:
    return matched(df.withColumn("_rate", rate), col, dictionary, False).groupBy("entity").agg(
        F.avg("_rate").alias("engagement_rate"), F.count("*").alias("mentions")
    ).filter(F.col("mentions") >= minimum)


# --- routines -------------------------------------------------------------------------------

def step_sentences(df: DataFrame, id_col: str, col: str, steps, policy: str = "first") -> DataFrame:
    """(id, sentence number, sentence, time of day, step) for every step named in a sentence."""
    rows = df.select(id_col, F.posexplode(text.sentences(col)).alias("sentence_no", "sentence"))
    return matched(rows.withColumn("time_of_day", text.time_of_day("sentence", policy)),
                   "sentence", steps, False, "step")


def steps_by_time(df: DataFrame, col: str, steps, time_of_day: Column) -> DataFrame:
    """Steps per time of day, and percent within the time of day."""
    rows = matched(df.withColumn("time_of_day", time_of_day), col, steps, False, "step")
    counts = aggregates.counts(rows, "time_of_day", "step")
    totals = counts.groupBy("time_of_day").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(totals), "time_of_day").withColumn(
        "pct", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def transitions(df: DataFrame, col: str, steps) -> DataFrame:
    """How often one step directly follows another, repeated steps counted once."""
    pairs = windows.adjacent_pairs(windows.without_repeats(sequence(col, steps)))
    return (df.select(F.explode(pairs).alias("p")).groupBy("p.from_step", "p.to_step")
            .agg(F.count("*").alias("n")))


def routines(df: DataFrame, id_col: str, col: str, steps, minimum: int = 10, min_steps: int = 2) -> DataFrame:
    """Whole step sequences used at least ``minimum`` times, with the first text as example."""
    rows = df.select(id_col, F.col(col), windows.without_repeats(sequence(col, steps)).alias("_steps"))
    rows = rows.filter(F.size("_steps") >= min_steps).withColumn("routine", F.array_join("_steps", " > "))
    return rows.groupBy("routine").agg(F.count("*").alias("n"), F.min(id_col).alias("example_id")).filter(
        F.col("n") >= minimum)

