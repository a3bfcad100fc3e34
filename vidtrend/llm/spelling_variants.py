"""Spelling variants of the words of a corpus: an index of variable-length grams, exactly one edit apart.

1. Words. Every run of letters is counted over all texts; words that are long and frequent enough stay.
2. Dictionary. Substrings of the marked words (``^word$``) are counted. A string is worth extending while
   more than ``T`` places hold it; all others are pruned. ``T`` is at least ``LIST`` and at least the number
   of places divided by ``MOST_GRAMS``, so fewer than ``MOST_GRAMS`` strings reach the driver and the tasks.
3. Decomposition. At each position the gram grows from ``QMIN`` while it is in the dictionary, at most to
   ``qmax``; grams inside the one before are left out. Growing reads only the gram itself, so an edit
   changes no gram that ends before it, and of those after it only grams that could lie inside a new
   one: an edit at ``i`` affects at most the grams that end in ``i .. i + qmax - 1``. The largest number of
   gram ends in such a window is the word's bound. ``qmax`` is half of the word, so one gram always survives.
   Words are decomposed per band of lengths, and words one longer than a band also in that band.
4. Merging. Grams are ordered by rarity. Among the first ``bound + 1`` grams of each of two near words
   stands their rarest common survivor, at the same distance from the start (before the edit) or from the
   end (after it). Only these lists, (gram, side, distance), are merged; the longer ones are skipped.
5. Long lists (over ``LIST`` words) are not paired up: their words meet by the hashes of all strings that
   lack one code point, which two near words always share.
6. Candidates are verified by the edit distance of the words themselves.
7. Forms. A word's form is its most frequent near word if that is ``ratio`` times as frequent. Counts grow
   by ``ratio`` along a chain of forms, so its length is logarithmic and pointer doubling ends.

Defined results: a null text has no words; a null id counts as empty text in the checksum; every row of
repeated rows counts; ties go to the smaller word in code-point order; texts and words have any
length. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtrend.llm.common import slices, stored

LETTERS = r"A-Za-zÀ-ÿ"
QMIN, QMOST = 2, 8
#: Words of a gram list that are paired within the list.
LIST = 64
#: Bound on the gram dictionary: strings that the driver and every task hold.
MOST_GRAMS = 200_000
#: Substring counts that a task holds before it passes them on.
HELD = 500_000
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A1C3E5F
_UNBASE = pow(_BASE, -1, _PRIME)


def occurrences(docs: DataFrame, id_col: str, text: str, min_length: int = 7) -> DataFrame:
    """``word`` of each letter run that is long enough, after the contract's deletions."""
    # split is linear in the text; regexp_extract_all copies the text for every match
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.split(F.col(f"`{text}`").cast("string"), f"[^{LETTERS}]+")).alias("run"))
    runs = runs.filter(F.char_length("run") >= min_length)
    runs = runs.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    check = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", check.alias("h"), F.char_length("run").alias("length"))
    place = (F.col("h") % F.col("length")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.col("length")))
    return runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= min_length)


def counted(words: DataFrame, min_count: int = 2) -> DataFrame:
    """Written table ``id, word, n`` of the distinct words that occur often enough."""
    often = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return stored(often.withColumn("id", F.monotonically_increasing_id()), "words")


def bands(min_length: int) -> list[tuple[int, int, int]]:
    """``(first length, last length, qmax)``; the last band has no end."""
    out, low = [], min_length
    while (low + 2) // 2 < QMOST:
        out.append((low, low + 1, max(QMIN, (low + 2) // 2)))
        low += 2
    return [*out, (low, 1 << 60, QMOST)]


def _substrings(longest: int):
    def work(batches):
        held = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
            held.clear()
            return out
        for batch in slices(batches):
            for word in batch.column(0).to_pylist():
                s = f"^{word}$"
                for q in range(QMIN, longest + 1):
                    held.update([s[a:a + q] for a in range(len(s) - q + 1)])
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()
    return work


def dictionary(words: DataFrame, longest: int = QMOST - 1, most: int = MOST_GRAMS, least: int = LIST) -> dict[str, int]:
    """Places of every string that more than ``T`` places hold; fewer than ``most`` strings."""
    grams = stored(words.select("word").mapInArrow(_substrings(longest), "gram string, n bigint")
                   .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > least), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    return {r["gram"]: r["n"] for r in grams.filter(F.col("n") > max(least, total // most)).collect()}


def decompose(word: str, frequent: dict[str, int], qmax: int) -> list[tuple[int, int]]:
    """First and last position of each gram of ``^word$``; both ascend."""
    s, out, last = f"^{word}$", [], -1
    for a in range(len(s) - QMIN + 1):
        q = QMIN
        while q < qmax and a + q < len(s) and s[a:a + q] in frequent:
            q += 1
        if a + q - 1 > last:
            last = a + q - 1
            out.append((a, last))
    return out


def affected(grams: list[tuple[int, int]], qmax: int) -> int:
    """Most grams that one edit can change: gram ends inside a window of ``qmax`` positions."""
    most = start = 0
    for i, (_, end) in enumerate(grams):
        while end - grams[start][1] >= qmax:
            start += 1
        most = max(most, i - start + 1)
    return most


def list_keys(word: str, frequent: dict[str, int], band: int, qmax: int) -> list[int]:
    """Hashed (band, gram, side, distance) of the word's ``bound + 1`` rarest grams."""
    s, grams = f"^{word}$", decompose(word, frequent, qmax)
    ranked = sorted((frequent.get(s[a:b + 1], 0), s[a:b + 1], a, b) for a, b in grams)
    out = []
    for _, gram, a, b in ranked[:affected(grams, qmax) + 1]:
        if b < len(s) - 1:  # an edit may follow
            out.append(f"{band} L{a} {gram}")
        if a > 0:  # an edit may come before
            out.append(f"{band} R{len(s) - b} {gram}")
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in out]


def lacking_one(word: str) -> set[int]:
    """Hashes of the word and of all strings that lack one of its code points, in one pass."""
    codes = [ord(c) for c in word]
    power, prefix, sums, powers = 1, 0, [0], []
    for c in codes:
        prefix = (prefix + c * power) % _PRIME
        sums.append(prefix)
        powers.append(power)
        power = power * _BASE % _PRIME
    return {prefix, *[(sums[i] + (prefix - sums[i + 1]) * _UNBASE) % _PRIME for i in range(len(codes))]}


def signature(word: str) -> int:
    """Length (8 bits) and a set of letters (56 bits): near words differ by 1 in length and in two bits."""
    bits = 0
    for c in set(word):
        bits |= 1 << ord(c) % 56
    return ((len(word) & 255) << 56 | bits) - (1 << 63)


def _keyed(keys_of):
    def work(batches):
        for batch in slices(batches):
            keys, ids, marks = [], [], []
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = keys_of(word)
                keys += own
                ids += [i] * len(own)
                marks += [signature(word)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (keys, ids, marks)], names=["key", "id", "mark"])
    return work


def _postings(words: DataFrame, keys_of) -> DataFrame:
    return stored(words.select("id", "word").mapInArrow(_keyed(keys_of), "key bigint, id bigint, mark bigint"), "postings")


def _pairs(postings: DataFrame) -> DataFrame:
    """Ids ``a < b`` that share a list and whose signatures allow one edit."""
    left = postings.select("key", F.col("id").alias("a"), F.col("mark").alias("x"))
    right = postings.select("key", F.col("id").alias("b"), F.col("mark").alias("y"))
    lengths = F.pmod(F.shiftrightunsigned("x", 56) - F.shiftrightunsigned("y", 56) + 1, F.lit(256)) <= 2
    bits = F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << 56) - 1))) <= 2
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & lengths & bits).select("a", "b")


def near_pairs(words: DataFrame, min_length: int = 7, longest_list: int = LIST, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Id pairs ``a, b`` of all words ``id, word`` that are exactly one edit apart, each once."""
    cuts = bands(min_length)
    frequent = dictionary(words, cuts[-1][2] - 1, most_grams, longest_list)

    def keys_of(word: str) -> list[int]:
        return [key for band, (low, high, qmax) in enumerate(cuts) if low <= len(word) <= high + 1
                for key in list_keys(word, frequent, band, qmax)]
    postings = _postings(words, keys_of)
    lists = stored(postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "lists")
    short = postings.join(lists.filter(F.col("size") <= longest_list).select("key"), "key")
    found = _pairs(short)
    long = lists.filter(F.col("size") > longest_list).select("key")
    crowd = postings.join(long, "key", "left_semi").select("id").distinct()
    found = found.unionByName(_pairs(_postings(words.join(crowd, "id", "left_semi"), lambda w: list(lacking_one(w)))))
    found = stored(found.distinct(), "candidates")
    named = lambda end: words.select(F.col("id").alias(end), F.col("word").alias(f"word_{end}"))
    checked = found.join(named("a"), "a").join(named("b"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1)
    return stored(checked.select("a", "b"), "near")


def forms(words: DataFrame, near: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``id, word, n``."""
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("id")).alias("_other"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("_other").alias("best"))
    linked = words.join(best.withColumnRenamed("a", "id"), "id", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    linked = stored(linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best.word")).alias("form"),
                                  F.when(good, -F.col("best.less")).alias("form_n"), F.when(good, F.col("best.id")).alias("up")), "forms")
    chains = linked.filter("up IS NOT NULL").select("id", "up")
    while True:  # counts grow along a chain, so it has no cycle and doubling halves what is left of it
        onward = chains.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        chains = stored(chains.join(onward, "up", "left").select("id", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("moved")), "chains")
        if chains.filter("moved").isEmpty():
            break
        chains = chains.drop("moved")
    ends = words.select(F.col("id").alias("up"), F.col("word").alias("root"))
    roots = chains.select("id", "up").join(ends, "up").select("id", "root")
    return linked.join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, id_col: str, text: str, min_length: int = 7, min_count: int = 2, ratio: int = 10,
             longest_list: int = LIST, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Spelling forms and roots of all words of a column of texts."""
    words = counted(occurrences(docs, id_col, text, min_length), min_count)
    return forms(words, near_pairs(words, min_length, longest_list, most_grams), ratio)


SQL = rf"""
WITH RECURSIVE tab AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
                     FOR n IN range(256)] AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(
          translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS w FROM documents),
c AS (SELECT w, xor(list_reduce(list_prepend(4294967295, flatten([CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)]
                 ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END FOR x IN string_split(id || w, '')])),
             lambda a, b : xor(a // 256, t[CAST(xor(a, b) % 256 + 1 AS INT)])), 4294967295) AS h FROM r, tab),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM c),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM words, range(0, 100000) p(i) WHERE i < length(word)),
near AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
         UNION SELECT v.word, w.word, w.n FROM v JOIN words w ON w.word = v.less
         UNION SELECT w.word, v.word, v.n FROM v JOIN words w ON w.word = v.less),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -n, b := other)) AS other, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN other END AS form,
             CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
up AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, f.n, n_near, f.form, form_n, up.at AS root FROM f JOIN up ON up.word = f.word AND up.next IS NULL
"""
