"""Raw venue messages to canonical trades and dead letters.

A venue adapter says, as columns over ``value``, what kind of frame a message is and which
raw trades it holds. One bad trade rejects its whole message; deduplication comes after,
so a rejected message marks no trade as seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meridia.functions.scalars import NS, positive_decimal, rfc3339_ns, valid_symbol, venue_symbol
from meridia.operators.sequential import bounded_fifo_dedup, first_delivery

RAW = "array<struct<symbol:string,trade_id:string,price:decimal(38,18),size:decimal(38,18),event_time_ns:long,side:string>>"
MAX_AHEAD_NS = 5 * NS
MAX_AGE_NS = 24 * 3600 * NS


@dataclass(frozen=True)
class Venue:
    """``kind``: trade, heartbeat, control, error or unknown. ``trades``: array of raw trades, null on a parse error."""

    name: str
    kind: Callable[[Column], Column]
    trades: Callable[[Column], Column]
    subscribe: Callable[[list[str]], list[dict]]


def _number(x: Column) -> Column:
    return x.try_cast("decimal(38,18)")


def _match_kind(v: Column) -> Column:
    t = F.get_json_object(v, "$.type")
    return F.when(t.isin("match", "last_match"), "trade").when(t == "heartbeat", "heartbeat").when(t == "subscriptions", "control").when(t == "error", "error").otherwise("unknown")


def _once(parsed: Column, use: Callable[[Column], Column]) -> Column:
    """``use(parsed)`` with the costly ``parsed`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(parsed), use), F.lit(0))


def _match_trades(v: Column) -> Column:
    def use(m):
        # the message has the resting side; the taker's is the other
        side = F.when(m["side"] == "buy", "sell").when(m["side"] == "sell", "buy").otherwise("unknown")
        one = F.struct(m["product_id"].alias("symbol"), m["trade_id"].cast("string").alias("trade_id"), _number(m["price"]).alias("price"), _number(m["size"]).alias("size"), rfc3339_ns(m["time"]).alias("event_time_ns"), side.alias("side"))
        return F.when(m["type"].isin("match", "last_match") & m["trade_id"].isNotNull(), F.array(one).cast(RAW))

    parsed = F.from_json(v, "type string, trade_id decimal(38,0), product_id string, price string, size string, side string, time string")
    return _once(_once(parsed, use), lambda t: F.when(F.get(t, F.lit(0))["event_time_ns"].isNotNull(), t))


def _batch_kind(v: Column) -> Column:
    c, method = F.get_json_object(v, "$.channel"), F.get_json_object(v, "$.method")
    ok = F.get_json_object(v, "$.success")
    return F.when(c == "trade", "trade").when(c == "heartbeat", "heartbeat").when(c == "status", "control").when(method.isNotNull() & (ok == "false"), "error").when(method.isNotNull(), "control").otherwise("unknown")


def _batch_trades(v: Column) -> Column:
    # numbers are decoded as decimals, which keeps their digits
    parsed = F.from_json(v, "channel string, data array<struct<symbol:string,side:string,price:decimal(38,18),qty:decimal(38,18),trade_id:decimal(38,0),timestamp:string>>")
    each = F.transform(
        _once(parsed, lambda m: F.when((m["channel"] == "trade") & (F.size(m["data"]) > 0), m["data"])),
        lambda x: F.struct(
            venue_symbol(x["symbol"]).alias("symbol"), x["trade_id"].cast("string").alias("trade_id"), x["price"].alias("price"), x["qty"].alias("size"), rfc3339_ns(x["timestamp"]).alias("event_time_ns"),
            F.when(x["side"].isin("buy", "sell"), x["side"]).otherwise("unknown").alias("side"),
        ),
    )
    bad = lambda x: x["price"].isNull() | x["size"].isNull() | x["trade_id"].isNull() | x["event_time_ns"].isNull()
    return _once(each, lambda t: F.when(~F.exists(t, bad), t.cast(RAW)))


VENUES: dict[str, Venue] = {
    "coinbase": Venue("coinbase", _match_kind, _match_trades, lambda symbols: [{"type": "subscribe", "channels": ["matches", "heartbeat"], "product_ids": list(symbols)}]),
    "kraken": Venue("kraken", _batch_kind, _batch_trades, lambda symbols: [{"method": "subscribe", "params": {"channel": "trade", "symbol": [s.replace("-", "/", 1) for s in symbols], "snapshot": True}}]),
}


def classify(frames: DataFrame, venues: dict[str, Venue] = VENUES) -> DataFrame:
    """``frames`` with ``kind``."""
    kind = F.lit("unknown")
    for v in venues.values():
        kind = F.when(F.col("exchange") == v.name, v.kind(F.col("value"))).otherwise(kind)
    return frames.withColumn("kind", kind)


def resolve_exchange(frames: DataFrame, prefix: str = "raw.trades.") -> DataFrame:
    """The header's exchange, or the topic's suffix."""
    return frames.withColumn("exchange", F.coalesce(F.nullif(F.col("exchange"), F.lit("")), F.when(F.startswith("topic", F.lit(prefix)), F.substring("topic", len(prefix) + 1, 1000))))


def validation_error(t: Column, recv: Column, allowed: list[str] | None) -> Column:
    """The first failing check of a raw trade, or null."""
    at = t["event_time_ns"]
    known = valid_symbol(t["symbol"])
    configured = F.lit(True) if allowed is None else t["symbol"].isin(allowed)
    price, size = positive_decimal(t["price"].cast("string")), positive_decimal(t["size"].cast("string"))
    timed = F.coalesce(recv, F.lit(0)) > 0
    return (
        F.when(~known, F.concat(F.lit("invalid symbol "), F.coalesce(t["symbol"], F.lit(""))))
        .when(~configured, F.concat(F.lit("symbol "), t["symbol"], F.lit(" not configured")))
        .when(F.coalesce(t["trade_id"], F.lit("")) == "", "empty trade_id")
        .when(price.isNull(), "price: not a positive decimal")
        .when(size.isNull(), "size: not a positive decimal")
        .when(F.coalesce(at, F.lit(0)) <= 0, "missing event time")
        .when(timed & (at > recv + F.lit(MAX_AHEAD_NS)), "event time is ahead of receive time")
        .when(timed & (at < recv - F.lit(MAX_AGE_NS)), "event time is older than 24h")
        .when(~t["side"].isin("buy", "sell"), "unknown side")
    )


def normalise(frames: DataFrame, allowed: list[str] | None = None, venues: dict[str, Venue] = VENUES, service: str = "normaliser", dedup: bool | int = True) -> tuple[DataFrame, DataFrame]:
    """(trades, dead letters) of raw frames. Works on tables; on streams pass ``dedup=False``.

    ``dedup``: a number bounds how many recent trade keys of a log partition are remembered.
    """
    f = resolve_exchange(frames)
    raw = F.lit(None).cast(RAW)
    for v in venues.values():
        raw = F.when(F.col("exchange") == v.name, v.trades(F.col("value"))).otherwise(raw)
    checked = f.withColumn("raw", raw).withColumn("errors", F.transform("raw", lambda t: validation_error(t, F.col("recv_time_ns"), allowed)))
    first_bad = F.get(F.filter("errors", lambda e: e.isNotNull()), F.lit(0))
    known = F.coalesce(F.col("exchange").isin(list(venues)), F.lit(False))
    error = F.when(~known, F.concat(F.lit("unknown exchange "), F.coalesce("exchange", F.lit("")))).when(F.col("raw").isNull(), F.concat_ws(" ", F.col("exchange"), F.lit("parse error"))).otherwise(first_bad)
    reason = F.when(~known, "unknown_exchange").when(F.col("raw").isNull(), "parse").when(first_bad.isNotNull(), "validation")
    marked = checked.withColumn("error", error).withColumn("reason", reason)
    dead = marked.where("error IS NOT NULL").select(
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), "error", "reason", F.col("value").cast("binary").alias("payload"), F.col("recv_time_ns").alias("failed_at_ns"), F.lit(service).alias("service")
    )
    rows = marked.where("error IS NULL").select("exchange", "recv_time_ns", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.posexplode("raw").alias("pos", "t"))
    if dedup:
        rows = rows.withColumn("_id", F.col("t.trade_id")).withColumn("_at", F.struct("kafka_partition", "kafka_offset", "pos"))
        rows = first_delivery(rows, ["exchange", "_id"], "_at") if dedup is True else bounded_fifo_dedup(rows, ["exchange", "_id"], "kafka_partition", "_at", dedup)
    good = rows.select(
        "exchange", "t.symbol", "t.trade_id", "t.event_time_ns", "recv_time_ns", F.col("t.price").cast("decimal(18,8)").alias("price"), F.col("t.size").cast("decimal(18,8)").alias("size"), "t.side", "kafka_partition", "kafka_offset"
    )
    return good, dead
