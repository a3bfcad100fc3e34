"""Registry of named queries, each with its DataFrame function and its SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtrend.queries.adapters import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: finish(fn(spark, folder))
        if sql:
            ORACLES[name] = with_tables(_expand(sql))
        return fn
    return register


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 digits, dates and times as text, whole numbers as bigint."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ", ")
        cols.append(c.alias(name))
    return df.select(*cols)


def _expand(sql: str) -> str:
    """R6(x) -> round(x, 6) without negative zero; DAY(x) -> date text; TS(x) -> time text."""
    forms = {"R6": "(round(CAST({0} AS DOUBLE), 6) + 0.0)", "DAYTEXT": "CAST(CAST({0} AS DATE) AS VARCHAR)",
             "WEEKTEXT": "CAST(CAST(date_trunc('week', {0}) AS DATE) AS VARCHAR)",
             "TS": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
             "REVEN": "(round_even(CAST({0} AS DOUBLE) * 100, 0) / 100)"}
    pattern = re.compile(r"\b(" + "|".join(forms) + r")\(")
    while True:
        found = None
        for found in pattern.finditer(sql):
            pass  # innermost calls are the last ones to open
        if not found:
            return sql
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:found.start()] + forms[found.group(1)].format(sql[found.end():end - 1]) + sql[end:]
