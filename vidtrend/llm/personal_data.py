"""Personal data by weak supervision; DataFrame operations only.

Candidates of four kinds come from patterns: the base patterns, whose spans always stay if they pass the
checks, and further ones (numbers that a longer run swallowed, obfuscated addresses). What fails a checksum
or a range is a candidate too, known to be false, and the reliabilities are measured against it. They vote on every candidate,
for, against or not at all: strict patterns, value checks, gazetteers, words in front of it, the
characters around it, and the variety of its characters. Expectation-maximisation on the counts of vote patterns estimates how reliable
each labeler is; its posteriors are the soft labels of a logistic span classifier over votes, length
and kind, which decides on the candidates beyond the base spans.

Everything per document is a row expression: no shuffle of texts, no Python in tasks. Only the counts
of vote patterns (at most kinds x 3^labelers x lengths rows, whatever the data) are aggregated,
combined map-side, and come to the driver for the two fits. Patterns are possessive or bounded, so
long runs neither recurse nor rescan; positions are summed in blocks.

Defined results: a null text counts as empty; an empty text has no spans (the digest is that of the
empty string). Repeated rows give repeated results; extra columns are ignored or kept as they are.
Without any candidate the classifier accepts nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

# Base patterns, written so that each position is tried once: runs are possessive, and a match starts
# where its first run starts or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?[\[(](?:at|AT)[\])]\x20?[{HOST}]{{1,63}}+"
             rf"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[{HOST}]{{1,63}}+){{1,5}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?=\.?(?:[^0-9.]|$))",
    "card": r"(?<![0-9A-Za-z.,])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}+@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}+\.){1,10}+[A-Za-z]{2,12}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$",
    "card": r"^(?:[0-9]{13,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}$",
}
# Gazetteers (fixed values): top-level domains, first digits of card issuers, telephone country codes.
GAZETTEER = {
    "email": r"(?i)(?:\.|\))\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|pt|se|jp|cn|br|in|au|ru)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ip": r"^(?!0\.|255\.)",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|courriel|correo)\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|login|from|adresse)\W*$",
    "card": r"(?i)(?:card|visa|master\w*|amex|credit|karte|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:tel\w*|phone|call|fax|mobil\w*|cell|whatsapp)\W*$",
}
AGAINST = r"(?i)(?:version|release|v|no|nr|isbn|issn|order|license|licence|section|chapter|figure|invoice)[\x20.:#]*$"
LABELERS = ("strict", "value", "gazetteer", "cue", "edges", "variety")
#: Candidates of a kind that weigh as much as the table over all kinds.
LEAN = 10
#: How often the checks of a kind pass what is no personal data (the Luhn sum passes one number of ten).
CHANCE = {"email": 0.5, "ip": 0.1, "card": 0.1, "phone": 0.3}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once although ``use`` reads it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prefix(values: Column) -> Column:
    """Sums before each element of an array of longs (for short arrays)."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _prefix_blocks(values: Column, block: int = 512) -> Column:
    """The same for arrays of any length: blocks are summed, then the inside of each block."""
    def use(v):
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))
        sums = lambda c: F.transform(c, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return bind(cuts, lambda c: F.flatten(F.zip_with(
            c, _prefix(sums(c)), lambda b, o: F.transform(_prefix(b), lambda x: x + o))))
    return bind(values, lambda v: F.when(F.size(v) <= block, _prefix(v)).otherwise(use(v)))


def found(text: Column, pattern: str) -> Column:
    """Array of ``start, end, value`` of all matches, in code points."""
    def use(s):
        size = F.size(s["values"])
        lengths = F.flatten(F.zip_with(F.slice(s["pieces"], 1, size), s["values"], lambda p, v: F.array(
            F.length(p).cast("bigint"), F.length(v).cast("bigint"))))
        return bind(_prefix_blocks(lengths), lambda at: F.transform(s["values"], lambda v, i: F.struct(
            F.get(at, 2 * i + 1).alias("start"), (F.get(at, 2 * i + 1) + F.length(v)).alias("end"), v.alias("value"))))
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return F.when(F.regexp_like(text, F.lit(pattern)), bind(both, use)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a number (a string) pass the Luhn sum."""
    def digit(n, i):
        d = F.substring(n, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)
    return bind(number, lambda n: F.aggregate(F.sequence(F.lit(1), F.length(n)), F.lit(0), lambda a, i: a + digit(n, i)) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    """Checks that base spans must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: bind(
            F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return bind(digits(value), lambda d: F.length(d).between(12, 19) & luhn(d))
    return F.length(digits(value)).between(9, 15)


def candidates(text: Column) -> Column:
    """Array of ``start, kind, end, value, base`` of all candidates of a text."""
    def of(kind: str, guard: Column) -> Column:
        tag = lambda spans, base: F.transform(spans, lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["value"].alias("value"),
            F.lit(base).alias("base")))
        def use(matches):
            def beside(base):
                free = lambda spans: F.filter(spans, lambda m: ~F.exists(base, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"])))
                failed = F.filter(matches, lambda m: ~_valid(kind, m["value"]))
                return F.concat(tag(base, True), F.array_distinct(tag(F.concat(free(found(text, FURTHER[kind])), free(failed)), False)))
            return bind(F.filter(matches, lambda m: _valid(kind, m["value"])), beside)
        joined = bind(found(text, BASE[kind]), use)
        return F.when(guard, joined).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string,base:boolean>>"))
    some_digit = F.regexp_like(text, F.lit("[0-9]"))
    guards = {"email": F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(r"[\[(](?:at|AT)[\])]"))}
    return F.concat(*[of(k, guards.get(k, some_digit)) for k in KINDS])


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0 as a column of tinyint."""
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0).cast("tinyint")


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def votes(text: Column, span: Column) -> Column:
    """Votes of all labelers on a candidate, with its length class."""
    value, kind = span["value"], span["kind"]
    like = lambda c, table: _by_kind(kind, {k: F.regexp_like(c, F.lit(p)) for k, p in table.items()})
    before = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)).cast("int"), F.least(span["start"], F.lit(24)).cast("int"))
    left = F.substring(text, span["start"].cast("int"), F.when(span["start"] > 0, 1).otherwise(0))
    right = F.substring(text, (span["end"] + 1).cast("int"), F.lit(1))
    numeric = digits(value)
    kinds_of = lambda v: F.size(F.array_distinct(F.split(v, "")))
    varied = _by_kind(kind, {"email": kinds_of(value) >= 6, "ip": kinds_of(numeric) >= 3, "card": kinds_of(numeric) >= 4, "phone": kinds_of(numeric) >= 4})
    # valid, but of an odd length: no vote
    valid = _by_kind(kind, {k: _valid(k, value) for k in KINDS})
    usual = _by_kind(kind, {"email": F.length(value) <= 80, "ip": F.lit(True), "card": F.length(numeric) >= 13, "phone": F.length(numeric).between(10, 13)})
    return F.struct(
        kind.alias("kind"), _vote(like(value, STRICT)).alias("strict"), bind(valid, lambda ok: _vote(ok & usual, ~ok)).alias("value"),
        bind(F.when(kind == KINDS.index("card"), numeric).otherwise(value), lambda v: _vote(like(v, GAZETTEER))).alias("gazetteer"),
        bind(before, lambda b: _vote(like(b, CUES), F.regexp_like(b, F.lit(AGAINST)))).alias("cue"),
        _vote(~F.regexp_like(left, F.lit(r"[\p{L}\p{N}_]")) & ~F.regexp_like(right, F.lit(r"[\p{L}\p{N}_]"))).alias("edges"),
        _vote(varied).alias("variety"),
        F.least(F.floor(F.length(value) / 6), F.lit(6)).cast("int").alias("size"))


@dataclass
class SpanModel:
    """Reliabilities of the labelers, weights of the span classifier, and what they were learnt from.

    ``patterns`` lists kind, votes in the order of ``LABELERS``, number of candidates and posterior.
    """

    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    level: float = -20.0
    patterns: list[tuple[str, tuple[int, ...], int, float]] = field(default_factory=list)

    def accepts(self, v: Column, cut: float) -> Column:
        total = F.lit(self.level)
        for (name, value), weight in self.weights.items():
            total = total + F.when(v[name] == value, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total)) >= cut


def expectation_maximisation(rows: np.ndarray, counts: np.ndarray, kinds: np.ndarray, false: np.ndarray, rounds: int = 100):
    """Posterior of each vote pattern and P(vote | truth) of each labeler over all kinds, as ``[labeler, truth, vote]``.

    Patterns marked in ``false`` fail the checks of their kind, so they are no personal data; the others pass,
    as what is none does by ``CHANCE``. A labeler has a table for each kind, which
    leans on that over all kinds with the weight of ``LEAN`` candidates.
    """
    n = rows.shape[1]
    shared = np.empty((n, 2, 3))
    shared[:, 1], shared[:, 0] = (0.1, 0.2, 0.7), (0.6, 0.25, 0.15)  # labelers are better than chance to begin with
    table = np.repeat(shared[:, None], len(KINDS), 1)
    prior, by_chance = np.full(len(KINDS), 0.5), np.array([CHANCE[k] for k in KINDS])
    for _ in range(rounds):
        log = np.log(np.stack([(1 - prior[kinds]) * by_chance[kinds], prior[kinds]], 1))
        for j in range(n):
            log += np.log(table[j, kinds, :, rows[:, j] + 1])
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        post[false] = (1.0, 0.0)
        weight = post * counts[:, None]
        for j in range(n):
            own = np.array([[[weight[(kinds == k) & (rows[:, j] + 1 == v), t].sum() for v in range(3)] for t in (0, 1)] for k in range(len(KINDS))])
            shared[j] = own.sum(0) + 0.5
            shared[j] /= shared[j].sum(1, keepdims=True)
            table[j] = own + LEAN * shared[j]
            table[j] /= table[j].sum(2, keepdims=True)
        for k in range(len(KINDS)):
            own = weight[kinds == k].sum(0)
            prior[k] = (own[1] + 1) / (own.sum() + 2)
    return post[:, 1], shared


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - y)) + penalty * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, text: str) -> SpanModel:
    """Count the vote patterns of all candidates and fit both models on the counts."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spans = docs.select(body.alias("_text")).select("_text", F.explode(candidates(F.col("_text"))).alias("_span"))
    names = ["kind", *LABELERS, "size"]
    rows = (spans.select(votes(F.col("_text"), F.col("_span")).alias("v")).select("v.*").groupBy(*names)
            .agg(F.count("*").alias("n")).orderBy(*names).collect())
    if not rows:
        return SpanModel()
    votes_, counts = np.array([[r[name] for name in LABELERS] for r in rows]), np.array([float(r["n"]) for r in rows])
    kinds = np.array([r["kind"] for r in rows])
    # what fails the checks of its kind (vote -1 of "value") is known to be false, and the others are measured
    # against it; how often the false pass by chance cannot be seen in those that failed, so it is given
    value = LABELERS.index("value")
    seen = votes_.copy()
    seen[:, value] = 0
    posterior, table = expectation_maximisation(seen, counts, kinds, votes_[:, value] == -1)
    table[value] = [[(counts * truth * (votes_[:, value] == v)).sum() + 0.5 for v in (-1, 0, 1)] for truth in (1 - posterior, posterior)]
    table[value] /= table[value].sum(1, keepdims=True)
    keys = sorted({(name, int(r[name])) for r in rows for name in names})
    x = np.array([[1.0] + [float(r[name] == value) for name, value in keys] for r in rows])
    w = logistic(x, posterior, counts)
    return SpanModel({name: (float(table[j, 1, 2]), float(table[j, 0, 0])) for j, name in enumerate(LABELERS)},
                     dict(zip(keys, w[1:])), float(w[0]),
                     [(KINDS[k], tuple(int(x) for x in v), int(n), float(p)) for k, v, n, p in zip(kinds, votes_, counts, posterior)])


def annotate(docs: DataFrame, text: str, model: SpanModel, cut: float = 0.5, name: str = "pii") -> DataFrame:
    """The table with an array ``pii`` of ``start, kind, end, base``, sorted by start and kind."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    spans = bind(body, lambda b: F.filter(candidates(b), lambda s: s["base"] | bind(votes(b, s), lambda v: model.accepts(v, cut))))
    slim = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return docs.withColumn(name, F.array_sort(slim))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.get(names, s["kind"]))).alias("out")))

    whole = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(bind(whole, lambda w: F.concat(
        F.array_join(w["out"], ""), F.substring(text, (w["at"] + 1).cast("int"), F.greatest(F.length(text) - w["at"], F.lit(0)).cast("int")))))


def report(annotated: DataFrame, keep: list[str], name: str = "pii") -> DataFrame:
    """Counts of base spans per kind, their digest, and the list of all spans."""
    base = F.filter(F.col(name), lambda s: s["base"])
    count = lambda k: F.size(F.filter(F.col(name), lambda s: s["base"] & (s["kind"] == k))).cast("bigint")
    per = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return annotated.select(*keep, *per, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(name)).alias("spans"))
