"""SQL spellings of the text functions, for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

from vidtrend.functions import fixed

WORD = r"[\p{L}\p{N}_]"
SPLIT_WORDS = r"regexp_extract_all({c}, '([\p{{L}}\p{{N}}_]+)', 1)"


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def keep(tokens: str, stop: Sequence[str] = (), min_len: int = 1) -> str:
    cond = f"length(x) >= {min_len}" + (f" AND x NOT IN ({quoted(stop)})" if stop else "")
    return f"list_filter({tokens}, lambda x: {cond})"


def letter_tokens(col: str, stop: Sequence[str] = (), min_len: int = 3) -> str:
    return keep(f"string_split(trim(regexp_replace(lower({col}), '[^a-zA-Zäöüß]+', ' ', 'g')), ' ')", stop, min_len)


def whitespace_tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array({col}, '\s+'), lambda x: x <> '')"


def clean_tokens(col: str, stop: Sequence[str] = (), symbols: str = "", max_run: int = 1, min_len: int = 3) -> str:
    t = rf"regexp_replace(lower({col}), '{fixed.URL_OR_MENTION}', ' ', 'g')"
    t = rf"regexp_replace({t}, '[^{fixed.LETTERS}0-9\s{symbols}]+', ' ', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyzäöüß0123456789":
        t = f"regexp_replace({t}, '{c}{{3,}}', '{c * max_run}', 'g')"
    for c in symbols:
        t = rf"regexp_replace({t}, '[{c}]{{3,}}', '{c * max_run}', 'g')"
    return keep(rf"string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' ')", stop, min_len)


def clean(col: str, stop: Sequence[str] = (), **kw) -> str:
    return f"array_to_string({clean_tokens(col, stop, **kw)}, ' ')"


def ngrams(tokens: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{tokens}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: {joined})"


def word_hit(col: str, term: str) -> str:
    t = term.replace("'", "''")
    return rf"regexp_matches({col}, '(^|[^\p{{L}}\p{{N}}_]){t}([^\p{{L}}\p{{N}}_]|$)')"
