"""Dates, labels, ratios and engagement sums as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("diggCount", "shareCount", "playCount", "collectCount", "commentCount")
LIKES_SHARES_COMMENTS = ("diggCount", "shareCount", "commentCount")
SOCIAL = ("diggCount", "commentCount", "shareCount", "collectCount")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_timestamp(col: str | Column) -> Column:
    """ISO text to timestamp, null when it cannot be read."""
    return F.try_to_timestamp(_c(col))


def day(col: str | Column) -> Column:
    return F.to_date(_c(col))


def week_start(col: str | Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", _c(col)))


def month_start(col: str | Column) -> Column:
    return F.trunc(F.to_date(_c(col)), "month")


def in_zone(col: str | Column, zone: str | Column) -> Column:
    """Wall-clock time in a zone; ``zone`` may be a column, so each row can have its own."""
    return F.from_utc_timestamp(_c(col), F.lit(zone) if isinstance(zone, str) else zone)


def calendar_fields(col: str | Column) -> dict[str, Column]:
    """Hour, day of week (Monday = 0), weekend flag, names, year and ISO week."""
    ts = _c(col)
    return {
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "is_weekend": F.weekday(ts) >= 5,
        "day_name": F.date_format(ts, "EEEE"), "month_name": F.date_format(ts, "MMM"),
        "year": F.year(ts), "iso_week": F.weekofyear(ts),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), ts),
    }


def period_of_day(hour: str | Column) -> Column:
    h = _c(hour)
    return (F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon")
            .when((h >= 17) & (h < 21), "evening").otherwise("night"))


def engagement(metrics: Sequence[str] = METRICS) -> Column:
    total = F.lit(0)
    for m in metrics:
        total = total + F.coalesce(F.col(m), F.lit(0))
    return total


def engagement_rate(metrics: Sequence[str] = SOCIAL, plays: str = "playCount") -> Column:
    return F.try_divide(engagement(metrics).cast("double"), F.col(plays))


def relative_change(now: str | Column, before: str | Column) -> Column:
    """(now - before) / before with a zero denominator read as one."""
    return (_c(now) - _c(before)) / F.when(_c(before) == 0, F.lit(1.0)).otherwise(_c(before))


def safe_pct_change(now: Column, before: Column) -> Column:
    return F.coalesce(F.try_divide((now - before).cast("double"), before), F.lit(0.0))


def three_way(col: str | Column, low: Column | float, high: Column | float,
              labels: tuple[str, str, str] = ("Dropping", "Stable", "Rising"),
              closed: bool = False) -> Column:
    """Below ``low``, between, above ``high``; bounds belong to the outer labels when closed."""
    c = _c(col)
    if closed:
        return F.when(c >= high, labels[2]).when(c <= low, labels[0]).otherwise(labels[1])
    return F.when(c > high, labels[2]).when(c < low, labels[0]).otherwise(labels[1])


def banded(col: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: the first label up to edges[0], the last above edges[-1]."""
    c = _c(col)
    out = F.when(c <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c <= edge, label)
    return out.when(c > edges[-1], labels[-1])


def lookup(col: str | Column, table: Mapping[str, str | None], default: bool = False) -> Column:
    """Map values by a fixed table; unmatched values stay (``default=False``) or become null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    mapped = F.create_map(*pairs)[_c(col)]
    if default:
        return mapped
    return F.when(_c(col).isin(list(table)), mapped).otherwise(_c(col))


def percent_text(col: str | Column) -> Column:
    return F.format_string("%+.0f%%", _c(col))


def range_text(low: str | Column, high: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f - %.{digits}f", _c(low), _c(high))


def mask_below(label: str | Column, confidence: str | Column, minimum: float) -> Column:
    return F.when(_c(confidence) >= minimum, _c(label))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    micros = lambda c: F.unix_micros(_c(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def ratio(x: str | Column, y: str | Column) -> Column:
    """x / (y + 1)."""
    return _c(x).cast("double") / (_c(y) + 1)


def top_probability(vector: str | Column) -> Column:
    from pyspark.ml.functions import vector_to_array
    return F.array_max(vector_to_array(_c(vector)))
