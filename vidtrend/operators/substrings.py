"""Which texts contain which terms as substrings, for any number of terms.

Each term is listed under one of its character grams, the one that the fewest texts hold; terms with a
gram that no text holds are in no text. A text meets the terms listed under its own grams by an equi-join,
and every meeting is confirmed on the text. A term has one gram and a text each gram once, so a text meets
a term at most once. Terms shorter than a gram are listed whole.

A term without white space is in a text if it is in one of the text's runs without white space. Where the
terms may be broadcast, such terms are looked up run by run in tasks, which remember the runs they met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.functions import text
from vidtrend.operators.scale import BROADCAST_ROWS, checked_broadcast
from vidtrend.session import cut_lineage

BROADCAST_BYTES = 64 << 20
#: Runs that a task remembers before it starts anew, and the longest it remembers; neither changes a result.
REMEMBERED, LONGEST = 200_000, 64


def char_grams(value: Column, lengths: Sequence[int]) -> Column:
    """Distinct runs of so many characters; linear in the text, since characters are taken from an array."""
    def of(chars: Column, n: int) -> Column:
        last = F.size(chars) - n
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))

    chars = F.array_remove(F.split(F.coalesce(value, F.lit("")), ""), "")
    return text.bind(chars, lambda c: F.array_distinct(F.concat(*[of(c, n) for n in lengths])))


def _terms_in_runs(terms: Sequence[str]) -> Callable[[Column], Column]:
    """Arrow function: the distinct terms (without white space) that each text contains."""
    remembered, longest, least = REMEMBERED, LONGEST, min(map(len, terms))
    known, lengths = frozenset(terms), {}
    for t in terms:
        lengths.setdefault(t[:least], set()).add(len(t))

    @F.arrow_udf("array<string>")
    def inside(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        met = {}

        def of(run: str) -> list[str]:
            heads = ((i, lengths.get(run[i:i + least])) for i in range(len(run) - least + 1))
            return list({run[i:i + n] for i, ns in heads if ns for n in ns} & known)

        def every(value: str) -> list[str]:
            found = set()
            for run in set(value.split()):
                own = met.get(run)
                if own is None:
                    own = of(run)
                    if len(run) <= longest:
                        if len(met) >= remembered:
                            met.clear()
                        met[run] = own
                found.update(own)
            return list(found)

        for batch in batches:
            yield pa.array((every(v.as_py()) if v.is_valid else [] for v in batch), pa.list_(pa.string()))

    return inside


def contained_terms(df: DataFrame, col: str, terms: DataFrame, term: str = "term", whole_word: bool = False, q: int = 4) -> DataFrame:
    """Rows of ``df`` with a column ``term``: one row per text and term that it contains.

    Null texts and null or empty terms meet nothing; a repeated term counts once, repeated rows each count.
    ``whole_word`` asks that no word character stands before or after the term. Few terms (by rows and
    bytes) are broadcast, so texts are not shuffled; more are joined on the grams, and only rows that met a
    term are read again.
    """
    known = cut_lineage(terms.select(F.col(f"`{term}`").alias("_term")).filter(F.length("_term") > 0).distinct())
    count, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_term")), F.lit(0))).first()
    if 0 < count <= BROADCAST_ROWS and size <= BROADCAST_BYTES and not whole_word:
        every = [r[0] for r in known.collect()]  # checked above
        plain = [t for t in every if t.split() == [t]]
        if plain:
            found = df.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(_terms_in_runs(plain)(F.col(f"`{col}`"))).alias(term))
            if len(plain) == len(every):
                return found
            rest = df.sparkSession.createDataFrame([(t,) for t in every if t.split() != [t]], "_term string")
            return found.union(_by_grams(df, col, rest, term, whole_word, q))
    return _by_grams(df, col, known, term, whole_word, q)


def _by_grams(df: DataFrame, col: str, known: DataFrame, term: str, whole_word: bool, q: int) -> DataFrame:
    lengths = sorted(r[0] for r in known.select(F.least(F.length("_term"), F.lit(q))).distinct().collect())  # at most q numbers
    if not lengths:
        return df.withColumn(term, F.lit(None).cast("string")).filter(F.lit(False))
    value = F.col(f"`{col}`")
    own = known.select("_term", F.explode(F.when(F.length("_term") < q, F.array("_term")).otherwise(char_grams(F.col("_term"), [q]))).alias("_gram"))
    grams = char_grams(value, lengths)
    held = (df.select(F.explode(grams).alias("_gram")).join(checked_broadcast(own.select("_gram").distinct()), "_gram")
            .groupBy("_gram").agg(F.count("*").alias("_texts")))
    listed = cut_lineage(own.join(held, "_gram", "left").groupBy("_term").agg(
        F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "_gram")).alias("_least"))
        .filter("_least._texts > 0").select(F.col("_least._gram").alias("_gram"), "_term"))
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_term")), F.lit(0))).first()
    inside = F.contains(value, F.col("_term"))
    if whole_word:
        inside = inside & F.regexp_like(value, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("_term"), F.lit(r"\E(?!\w)")))
    if count <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        met = df.withColumn("_gram", F.explode(grams)).join(F.broadcast(listed), "_gram")
    else:
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        pairs = rows.select("_row", F.explode(grams).alias("_gram")).join(listed, "_gram").select("_row", "_term")
        met = rows.join(pairs, "_row")
    return met.filter(inside).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_term").alias(term))
