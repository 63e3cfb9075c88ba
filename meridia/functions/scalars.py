"""Column expressions of the trade model: exact decimals, alignment, identifiers, text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NS = 1_000_000_000
YEAR_SECS = 31_536_000


def align(t_ns: Column, secs: Column | int) -> Column:
    """Start of the epoch-aligned window that holds ``t_ns``; negative times align downwards."""
    size = (F.lit(secs) if isinstance(secs, int) else secs).cast("long") * F.lit(NS)
    return t_ns - F.pmod(t_ns, size)


def log_return(previous: Column, current: Column) -> Column:
    return F.log(current.cast("double") / previous.cast("double"))


def annualised_vol(variance: Column, secs: Column) -> Column:
    """sqrt(variance) a window of ``secs``, scaled to a year of 365 days; 0 unless both are positive."""
    return F.when((variance > 0) & (secs > 0), F.sqrt(variance) * F.sqrt(F.lit(float(YEAR_SECS)) / secs)).otherwise(F.lit(0.0))


def vwap(spq: Column, sq: Column) -> Column:
    """Sum of price x size over sum of size, to ten places, half away from zero, rounded once.

    Decimal division first gives a nearby tenth place; the exact residual then moves it by
    at most one unit. Needs sums of size below 1e7 and quotients below 1e12.
    """
    v = (spq.cast("decimal(34,16)") / F.nullif(sq.cast("decimal(20,8)"), F.lit(0).cast("decimal(20,8)"))).cast("decimal(28,10)")
    back = (v.cast("decimal(22,10)") * sq.cast("decimal(15,8)")).cast("decimal(37,18)")
    twice = (F.lit(2) * (spq.cast("decimal(37,18)") - back)).cast("decimal(36,18)") * F.lit(10_000_000_000).cast("decimal(11,0)")
    unit = F.lit("0.0000000001").cast("decimal(28,10)")
    moved = F.when(twice >= sq, v + unit).when(twice < -sq, v - unit).otherwise(v)
    return F.coalesce(moved.cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))


def spread_bps(a: Column, b: Column) -> Column:
    """(a - b) over their middle, in basis points, six places, as a double; 0 where a side is missing."""
    mid = (a + b) / F.lit(2)
    exact = (a - b).cast("decimal(24,10)") * F.lit(10_000) / F.nullif(mid, F.lit(0).cast("decimal(28,10)"))
    return F.coalesce(F.round(exact, 6).cast("double"), F.lit(0.0))


def range_bps(high: Column, low: Column, middle: Column) -> Column:
    m = middle.cast("double")
    return F.when(m != 0, (high.cast("double") - low.cast("double")) / m * 1e4)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b))


def round6(x: Column) -> Column:
    """Half away from zero at the sixth place; 0 for NaN and infinities."""
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6).otherwise(F.lit(0.0))


def canonical_decimal(x: Column) -> Column:
    """Plain decimal text without trailing zeros."""
    text = x.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def venue_symbol(x: Column) -> Column:
    """BTC/USD to BTC-USD: the first slash only."""
    return F.regexp_replace(x, "^([^/]*)/", "$1-")


def valid_symbol(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z0-9]{1,12}-[A-Z0-9]{1,12}$"), F.lit(False))


def positive_decimal(x: Column) -> Column:
    """Text as DECIMAL(18,8) where it is a positive number that the type holds exactly, else null."""
    wide = x.try_cast("decimal(38,18)")
    narrow = x.try_cast("decimal(18,8)")
    return F.when((narrow > 0) & (wide == narrow.cast("decimal(38,18)")), narrow)


def dedup_key(exchange: Column, trade_id: Column) -> Column:
    return F.concat_ws("|", exchange, trade_id)


def alert_id(rule: Column, symbol: Column, end_ns: Column, exchange: Column | None = None) -> Column:
    """First 32 hex digits of the SHA-256 of the fields with NUL between them; the exchange only where there is one."""
    parts = F.concat_ws("\0", rule, symbol, end_ns.cast("string"))
    if exchange is not None:
        parts = F.when(F.coalesce(exchange, F.lit("")) == "", parts).otherwise(F.concat_ws("\0", parts, exchange))
    return F.substring(F.sha2(parts, 256), 1, 32)


def alert_sort_key(end_ns: Column, ident: Column) -> Column:
    return F.concat(F.lpad(end_ns.cast("string"), 20, "0"), F.lit("#"), ident)


def rfc3339_ns(text: Column) -> Column:
    """RFC 3339 UTC or offset time to nanoseconds; null if it is none."""
    shape = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(text, shape, i)
    whole = F.concat(part(1), F.lit(" "), part(2), F.when(F.lower(part(4)) == "z", F.lit("+00:00")).otherwise(part(4)))
    secs = F.unix_seconds(F.when(text.rlike(shape), whole).try_cast("timestamp"))
    return secs * F.lit(NS) + F.coalesce(F.rpad(part(3), 9, "0").try_cast("long"), F.lit(0))


def rfc3339(end_ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(end_ns / F.lit(NS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hour_parts(t_ns: Column) -> tuple[Column, Column]:
    at = F.timestamp_seconds(F.floor(t_ns / F.lit(NS)))
    return F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH")


def ntz_ns(ts: Column | str) -> Column:
    """TIMESTAMP_NTZ to nanoseconds since the epoch, whatever the session's zone."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})") * F.lit(1000)


def backoff_ceiling(attempt: Column, base_s: float = 0.5, most_s: float = 30.0) -> Column:
    return F.least(F.lit(base_s) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))), F.lit(most_s))


def murmur2(key: bytes) -> int:
    """The hash of keyed partitioners; used on the driver for a handful of symbols."""
    m, h = 0x5BD1E995, 0x9747B28C ^ len(key)
    for i in range(0, len(key) - len(key) % 4, 4):
        k = int.from_bytes(key[i : i + 4], "little") * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ ((k ^ k >> 24) * m & 0xFFFFFFFF)
    if tail := key[len(key) - len(key) % 4 :]:
        h = (h ^ int.from_bytes(tail, "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def key_partition(symbol: str, partitions: int = 6) -> int:
    return (murmur2(symbol.encode()) & 0x7FFFFFFF) % partitions
