"""Lookups over stored results, and keyed table maintenance."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridia.functions.scalars import NS, alert_sort_key
from meridia.sources import schemas

TTL_DAYS = 30
WINDOWS = (1, 10, 60)


class BadRequest(ValueError):
    """An argument that no lookup can answer."""


class NotFound(LookupError):
    """A symbol or run that is not there."""


def checked(symbol: str, known: list[str], window_secs: int | str | None = None, windows=WINDOWS) -> tuple[str, int]:
    """(symbol, window size) of a request's arguments; the size defaults to the middle one."""
    try:
        secs = windows[len(windows) // 2] if window_secs in (None, "") else int(window_secs)
    except ValueError as e:
        raise BadRequest(f"window {window_secs!r} is no number") from e
    if secs not in windows:
        raise BadRequest(f"window must be one of {', '.join(map(str, windows))}")
    if symbol not in known:
        raise NotFound(f"unknown symbol {symbol}")
    return symbol, secs


def clamp(n: int | None, least: int, most: int, default: int) -> int:
    return default if n is None else max(least, min(most, n))


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; partial aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def upsert_newer(current: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``current`` after the batch: a row is replaced by a strictly newer one only."""
    both = current.withColumn("_old", F.lit(1)).unionByName(newest(batch, keys, version).select(*current.columns).withColumn("_old", F.lit(0)))
    rest = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_old")).alias("_r")).select(*keys, "_r.*").select(*current.columns)


def insert_absent(current: DataFrame, batch: DataFrame, key: str = "alert_id") -> DataFrame:
    """Rows of the batch whose key is not stored yet, once each."""
    return batch.dropDuplicates([key]).join(current.select(key), key, "left_anti").select(*batch.columns)


def alert_items(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("sk", alert_sort_key(F.col("window_end_ns"), F.col("alert_id"))).withColumn("expires_at", F.floor(F.col("window_end_ns") / F.lit(NS)) + F.lit(TTL_DAYS * 86_400))


def latest(metrics: DataFrame, symbol: str, window_secs: int = 10) -> DataFrame:
    return newest(metrics.where((F.col("symbol") == symbol) & (F.col("window_secs") == window_secs)), ["symbol", "window_secs"], "window_end_ns")


def history(metrics: DataFrame, symbol: str, window_secs: int = 10, limit: int | None = None) -> DataFrame:
    """The last windows of a symbol, oldest first."""
    n = clamp(limit, 1, 600, 300)
    rows = metrics.where((F.col("symbol") == symbol) & (F.col("window_secs") == window_secs))
    return rows.orderBy(F.col("window_end_ns").desc()).limit(n).orderBy("window_end_ns")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def kept_history(rows: DataFrame, keys: list[str], arrival: str, at: str, most: int = 600) -> DataFrame:
    """What a store holds that takes only rows beyond all before and keeps the last ``most`` a key."""
    return last_n(monotone(rows, keys, arrival, at), keys, at, most)


def monotone(rows: DataFrame, keys: list[str], arrival: str, at: str) -> DataFrame:
    """Rows in arrival order whose ``at`` is beyond all before."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.max(at).over(w)).where(F.col("_before").isNull() | (F.col(at) > F.col("_before"))).drop("_before")


def encode_cursor(symbol: str, sk: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([symbol, sk]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        symbol, sk = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return str(symbol), str(sk)
    except Exception as e:
        raise ValueError("bad cursor") from e


def alert_page(items: DataFrame, symbol: str | None = None, since_ns: int = 0, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Newest first; the cursor continues after the last row seen."""
    rows = items.where(F.col("sk") >= f"{max(since_ns, 0):020d}")
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    if cursor:
        rows = rows.where(F.col("sk") < decode_cursor(cursor)[1])
    return rows.orderBy(F.col("sk").desc()).limit(clamp(limit, 1, 500, 50))


def symbols_with_health(symbols: DataFrame, health: DataFrame) -> DataFrame:
    """Every configured symbol with its feeds sorted by exchange; an empty list where there is none."""
    feeds = health.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("exchange", "status", "last_trade_ns"))).alias("feeds"))  # a row a venue
    none = F.array().cast(feeds.schema["feeds"].dataType)
    return symbols.join(feeds, "symbol", "left").select("symbol", F.coalesce("feeds", none).alias("feeds"))


def emission_order(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("window_end_ns", "window_secs", "symbol")


def first_windows(metrics: DataFrame, arrival: str) -> DataFrame:
    """The first arrived copy of each window; partial aggregation, no sort."""
    keys = ["symbol", "window_secs", "window_end_ns"]
    rest = [c for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("_r")).select(*keys, "_r.*").select(*metrics.columns)


def alert_board(alerts: DataFrame, most: int = 200) -> DataFrame:
    """The newest alerts, each id once; of copies with one id the newest counts."""
    return newest(alerts, ["alert_id"], "window_end_ns").orderBy(F.col("window_end_ns").desc(), F.col("alert_id").desc()).limit(most)


def health_rows(spark: SparkSession, path: str) -> DataFrame:
    """All stored feed health rows."""
    return spark.read.schema(schemas.FEED_HEALTH).parquet(path)


def envelope(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data"))).alias("value"))


def unwrap(value):
    """The message of a notification envelope, or the value itself."""
    return F.when(F.get_json_object(value, "$.Type") == "Notification", F.get_json_object(value, "$.Message")).otherwise(value)
