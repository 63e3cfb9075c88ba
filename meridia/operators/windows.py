"""Exact window metrics over trades, as one declarative plan.

Arrival order is (kafka_partition, kafka_offset). The plan drops redeliveries and late
trades as a record-by-record engine with a per-partition watermark would, aggregates each
window size, and keeps the windows that such an engine would have closed.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window, functions as F

from meridia.functions.scalars import NS, align, annualised_vol, log_return, spread_bps, vwap
from meridia.operators.spans import running
from meridia.sources.staging import stored

SIZES = (1, 10, 60)
LATENESS_NS = 500_000_000
CHUNK = 1_000_000  # offsets of a partition that one task orders
SPAN = 100_000  # stretches of the smallest size that one task orders


def check_sizes(sizes) -> tuple[int, ...]:
    sizes = tuple(sorted(set(sizes)))
    if not sizes or sizes[0] < 1 or any(s % sizes[0] for s in sizes):
        raise ValueError("window sizes must be multiples of the smallest")
    return sizes


def dedup_bucket(trades: DataFrame, size: int, include_symbol: bool = False) -> DataFrame:
    """First delivery of each (exchange, trade_id) within a smallest window, by offset."""
    keys = ["kafka_partition", "exchange", "trade_id", "bucket"] + ["symbol"] * include_symbol
    first = Window.partitionBy(*keys).orderBy("kafka_offset")
    return trades.withColumn("bucket", align(F.col("event_time_ns"), size)).withColumn("copy", F.row_number().over(first))


def running_max_before(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``max_before``: the greatest event time of first deliveries at earlier offsets of the partition."""
    first = F.when(F.col("copy") == 1, F.col("event_time_ns"))
    return running(df, ["kafka_partition"], [F.col("kafka_offset")], F.floor(F.col("kafka_offset") / F.lit(chunk)), first, "max_before")


def outcomes(trades: DataFrame, sizes=SIZES, lateness_ns: int = LATENESS_NS, include_symbol: bool = False) -> DataFrame:
    """Every delivery with ``outcome``: accepted, late or duplicate (late first)."""
    size = check_sizes(sizes)[0]
    marked = running_max_before(dedup_bucket(trades, size, include_symbol))
    late = F.coalesce(F.col("bucket") + F.lit(size * NS) <= F.col("max_before") - F.lit(lateness_ns), F.lit(False))
    return marked.withColumn("outcome", F.when(late, "late").when(F.col("copy") > 1, "duplicate").otherwise("accepted"))


def accepted(trades: DataFrame, sizes=SIZES, lateness_ns: int = LATENESS_NS, in_order: bool = False, include_symbol: bool = False, dedup: bool = True) -> DataFrame:
    """Trades that windows count. ``in_order`` input (a replay) has no late trades and needs no watermark; without ``dedup`` all of it counts."""
    if in_order and not dedup:
        return trades
    if in_order:
        return dedup_bucket(trades, check_sizes(sizes)[0], include_symbol).where("copy = 1").drop("copy")
    return outcomes(trades, sizes, lateness_ns, include_symbol).where("outcome = 'accepted'").drop("outcome", "copy")


def _with_returns(good: DataFrame, sizes: tuple[int, ...], in_order: bool) -> DataFrame:
    """``good`` with ``r<secs>``: each trade's log return within its window of that size and its venue.

    All sizes share one exchange, by venue and the span that holds whole windows of every
    size. In-order trades need one look back for all sizes, as a window's trades are neighbours.
    """
    whole = lcm(*sizes)
    spanned = good.withColumn("_span", align(F.col("event_time_ns"), whole))
    for s in sizes:
        spanned = spanned.withColumn(f"_s{s}", align(F.col("event_time_ns"), s))
    keys, arrival = ["symbol", "exchange", "_span"], ["kafka_partition", "kafka_offset"]
    if in_order:
        w = Window.partitionBy(*keys).orderBy(*arrival)
        spanned = spanned.withColumns({"_p": F.lag("price").over(w), **{f"_b{s}": F.lag(f"_s{s}").over(w) for s in sizes}})
        spanned = spanned.withColumn("_r", log_return(F.col("_p"), F.col("price")))
        return spanned.withColumns({f"r{s}": F.when(F.col(f"_b{s}") == F.col(f"_s{s}"), F.col("_r")) for s in sizes})
    for s in sizes:
        w = Window.partitionBy(*keys, f"_s{s}").orderBy(*arrival)
        spanned = spanned.withColumn(f"r{s}", log_return(F.lag("price").over(w), F.col("price")))
    return spanned


def window_metrics(trades: DataFrame, sizes=SIZES, lateness_ns: int = LATENESS_NS, flush: bool = False, in_order: bool = False, include_symbol: bool = False, dedup: bool = True) -> DataFrame:
    """One row per (symbol, window_secs, window); with ``flush`` open windows are emitted too.

    ``dedup=False``, for ``in_order`` input only, counts every row: for tables whose trades come once but whose ids repeat.
    """
    if not (dedup or in_order):
        raise ValueError("out of order, trades are deduplicated")
    sizes = check_sizes(sizes)
    good = accepted(trades, sizes, lateness_ns, in_order, include_symbol, dedup)
    smallest, square = sizes[0], lambda s: F.sum(F.col(f"r{s}") * F.col(f"r{s}"))
    rows = _with_returns(good, sizes, in_order)
    # running maxima of the partition's event times, by the part of the smallest window that the lateness parts off
    peak = F.col("event_time_ns")
    if not in_order:  # in-order trades are their own running maxima
        peak = F.when(F.col("max_before").isNull() | (peak > F.col("max_before")), peak)
    early = F.col("event_time_ns") - F.col(f"_s{smallest}") < lateness_ns % (smallest * NS)
    # by venue and smallest window, in the partitioning that the returns came in; all that follows reads this table
    parts = rows.groupBy("symbol", "exchange", "_span", F.col(f"_s{smallest}").alias("_start")).agg(
        F.sum(F.col("price") * F.col("size")).alias("spq"),
        F.sum("size").alias("sq"),
        F.count(F.lit(1)).alias("n"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(F.struct("event_time_ns", "kafka_partition", "kafka_offset", "price")).alias("last"),
        F.max("kafka_partition").alias("kafka_partition"),
        *[square(s).alias(f"var{s}") for s in sizes],  # null: no return
        F.min(F.when(early, peak)).alias("early_peak"),
        F.min(F.when(~early, peak)).alias("late_peak"),
    )
    parts = stored(parts, "venue_windows")
    each = parts.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("window_secs"), align(F.col("_start"), s).alias("window_start_ns"), F.col(f"var{s}").alias("var")) for s in sizes])).alias("w"))
    keys = ["symbol", "window_secs", "window_start_ns"]
    by_venue = each.select("symbol", "exchange", "spq", "sq", "n", "high", "low", "last", "kafka_partition", "w.*").groupBy(*keys, "exchange").agg(
        F.sum("spq").alias("spq"),
        F.sum("sq").alias("sq"),
        F.sum("n").alias("n"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("last").alias("last"),
        F.sum("var").alias("var"),
        F.max("kafka_partition").alias("kafka_partition"),
    )
    venue = F.struct(
        "exchange",
        vwap(F.col("spq"), F.col("sq")).alias("vwap"),
        F.col("sq").cast("decimal(28,8)").alias("volume"),
        F.col("n").alias("trade_count"),
        F.col("last.event_time_ns").alias("last_trade_ns"),
    )
    whole = by_venue.groupBy(*keys).agg(
        F.sum("spq").alias("spq"),
        F.sum("sq").alias("sq"),
        F.sum("n").alias("trade_count"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("last").alias("last"),
        F.avg("var").alias("var"),
        F.max("kafka_partition").alias("kafka_partition"),
        F.array_sort(F.collect_list(venue)).alias("exchanges"),  # a row a venue
    )
    two = F.size("exchanges") >= 2
    out = whole.select(
        "symbol",
        "window_secs",
        "window_start_ns",
        (F.col("window_start_ns") + F.col("window_secs").cast("long") * F.lit(NS)).alias("window_end_ns"),
        vwap(F.col("spq"), F.col("sq")).alias("vwap"),
        F.col("sq").cast("decimal(28,8)").alias("volume"),
        "trade_count",
        annualised_vol(F.coalesce("var", F.lit(0.0)), F.col("window_secs")).alias("realised_vol"),
        "high",
        "low",
        F.col("last.price").alias("last_price"),
        F.when(two, spread_bps(F.col("exchanges")[0]["vwap"], F.get("exchanges", F.lit(1))["vwap"])).otherwise(F.lit(0.0)).alias("xex_spread_bps"),
        "exchanges",
        "kafka_partition",
    )
    return _closed(out, parts, smallest, lateness_ns, flush).drop("kafka_partition")


def _closed(windows: DataFrame, parts: DataFrame, smallest: int, lateness_ns: int, flush: bool) -> DataFrame:
    """Windows that the watermark passed, with ``emitted_at_ns``: the watermark that closed them.

    A window closes at the first trade of its partition whose event time, the greatest so
    far, reaches its end plus the lateness; that is the least running maximum at or above
    it. Ends are multiples of the smallest size, so one running maximum, the least, of each
    stretch of that size (shifted by the lateness) is enough to carry on.
    """
    size = F.lit(smallest * NS)
    stretch = F.floor(F.col("_start") / size) - F.lit(lateness_ns // (smallest * NS))
    each = F.array(F.struct((stretch - 1).alias("k"), F.col("early_peak").alias("peak")), F.struct(stretch.alias("k"), F.col("late_peak").alias("peak")))
    peaks = parts.select("kafka_partition", F.inline(each)).where("peak IS NOT NULL").groupBy("kafka_partition", "k").agg(F.min("peak").alias("peak"))
    ends = windows.select("kafka_partition", F.floor(F.col("window_end_ns") / size).alias("k")).distinct()
    both = ends.withColumn("end", F.lit(True)).unionByName(peaks, allowMissingColumns=True)
    # an end's own stretch counts: its running maxima reach the end plus the lateness
    found = running(both, ["kafka_partition"], [F.col("k").desc(), F.col("peak").asc_nulls_last()], F.floor(F.col("k") / F.lit(SPAN)), F.col("peak"), "closer", inclusive=True, after=True).where("end")
    closing = found.select("kafka_partition", (F.col("k") * size).alias("window_end_ns"), "closer")
    out = windows.join(closing, ["kafka_partition", "window_end_ns"])
    if not flush:
        return out.where(F.col("closer").isNotNull()).withColumn("emitted_at_ns", F.col("closer") - F.lit(lateness_ns)).drop("closer")
    final = parts.groupBy("kafka_partition").agg(F.max("last.event_time_ns").alias("final"))  # a row a partition of the log
    return out.join(final, "kafka_partition").withColumn("emitted_at_ns", F.coalesce("closer", "final") - F.lit(lateness_ns)).drop("closer", "final")


def watermark_windows(stream: DataFrame, secs: int, lateness: str = "500 milliseconds") -> DataFrame:
    """The same aggregates by Spark's own event-time windows; ``ts`` is a timestamp.

    Works on streams and tables. The watermark is the query's, not a partition's, and moves
    a micro-batch at a time, so late trades can count where the exact plan drops them.
    """
    grouped = stream.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", f"{secs} seconds").alias("w"))
    return grouped.agg(
        F.sum(F.col("price") * F.col("size")).alias("spq"), F.sum("size").alias("sq"), F.count(F.lit(1)).alias("trade_count"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("last_price")
    ).select("symbol", F.lit(secs).alias("window_secs"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), vwap(F.col("spq"), F.col("sq")).alias("vwap"), F.col("sq").alias("volume"), "trade_count", "high", "low", "last_price")


def with_clock(metrics: DataFrame, clock: str = "event") -> DataFrame:
    """``metrics`` with ``emitted_at_ns`` by the ``event`` clock (the closing watermark, repeatable) or the ``wall`` clock."""
    if clock not in ("event", "wall"):
        raise ValueError("the clock is event or wall")
    return metrics if clock == "event" else metrics.withColumn("emitted_at_ns", F.unix_micros(F.current_timestamp()) * 1000)
