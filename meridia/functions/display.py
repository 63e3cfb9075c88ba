"""Numbers and times as people read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meridia.functions.scalars import NS

NONE = "–"


def number(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), NONE).otherwise(F.format_number(x, digits))


def price(x: Column) -> Column:
    """Two digits from a thousand on, three from one on, six below."""
    n = x.try_cast("decimal(38,18)")
    return F.when(n.isNull(), NONE).when(n >= 1000, F.format_number(n, 2)).when(n >= 1, F.format_number(n, 3)).otherwise(F.format_number(n, 6))


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), NONE).otherwise(F.concat(number(x * 100, digits), F.lit("%")))


def clock(at_ns: Column) -> Column:
    """The time of day in UTC, whatever the session's zone."""
    s = F.pmod(F.floor(at_ns / F.lit(NS)), F.lit(86_400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def age(at_ns: Column, now_ns: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((now_ns - at_ns) / F.lit(NS) + 0.5))
    return F.when(at_ns.isNull() | (at_ns == 0), "never").when(s < 60, F.format_string("%ds ago", s)).when(s < 3600, F.format_string("%dm ago", F.floor(s / 60))).otherwise(F.format_string("%dh ago", F.floor(s / 3600)))
