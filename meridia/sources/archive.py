"""The trade archive (Hive-partitioned Parquet), its replay, and recorded frames."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meridia.functions.scalars import NS, canonical_decimal, hour_parts
from meridia.sources import schemas

PARTITIONS = ("exchange", "symbol", "date", "hour")
REPLAY_ORDER = ("event_time_ns", "exchange", "trade_id")


def to_rows(trades: DataFrame) -> DataFrame:
    """Trades as archive rows: decimals as plain text, partition columns from the event time."""
    date, hour = hour_parts(F.col("event_time_ns"))
    return trades.select("exchange", "symbol", "trade_id", "event_time_ns", "recv_time_ns", canonical_decimal(F.col("price")).alias("price"), canonical_decimal(F.col("size")).alias("size"), "side", "kafka_offset", date.alias("date"), hour.alias("hour"))


def to_trades(rows: DataFrame) -> DataFrame:
    dec = lambda c: F.col(c).cast("decimal(18,8)").alias(c)
    return rows.select("exchange", "symbol", "trade_id", "event_time_ns", "recv_time_ns", dec("price"), dec("size"), "side", F.lit(0).alias("kafka_partition"), "kafka_offset")


def archive_key(exchange: Column, symbol: Column, at_ns: Column, first: Column, last: Column) -> Column:
    """The key of the part that holds offsets ``first`` to ``last`` of a venue's symbol in the hour of ``at_ns``."""
    date, hour = hour_parts(at_ns)
    return F.format_string("trades/exchange=%s/symbol=%s/date=%s/hour=%s/part-%020d-%020d.parquet", exchange, symbol, date, hour, first, last)


def parse_archive_key(key: Column) -> Column:
    """struct(exchange, symbol, date, hour, first, last) of a key, or null if it is none."""
    shape = r"^trades/exchange=([^/]+)/symbol=([^/]+)/date=(\d{4}-\d{2}-\d{2})/hour=([01]\d|2[0-3])/part-(\d{20})-(\d{20})\.parquet$"
    part = lambda i: F.regexp_extract(key, shape, i)
    day = part(3).try_cast("date")
    return F.when(key.rlike(shape) & day.isNotNull(), F.struct(part(1).alias("exchange"), part(2).alias("symbol"), day.cast("string").alias("date"), part(4).alias("hour"), part(5).try_cast("long").alias("first"), part(6).try_cast("long").alias("last")))


def write_archive(trades: DataFrame, path: str, files_per_hour: int = 1) -> None:
    """Sorted zstd files by (exchange, symbol, date, hour) and the range of offsets that a call writes there.

    A repeated call with the same trades has the same ranges and overwrites its own files, so
    a batch that is written again doubles nothing. A busy hour can be spread over several
    files; each is sorted, and replay orders across. ``trades`` is read twice.
    """
    rows = to_rows(trades).withColumn("_file", F.pmod(F.xxhash64("trade_id"), F.lit(files_per_hour)))
    ranges = rows.groupBy(*PARTITIONS).agg(F.format_string("%020d-%020d", F.min("kafka_offset"), F.max("kafka_offset")).alias("part"))  # a row an hour
    rows = rows.join(ranges, list(PARTITIONS)).repartition(*PARTITIONS, "_file").sortWithinPartitions(*PARTITIONS, *REPLAY_ORDER[:1], "trade_id").drop("_file")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PARTITIONS, "part").parquet(path)


def read_archive(spark: SparkSession, path: str, symbols: list[str] | None = None, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Archive rows of [from, to). The range also prunes date and hour directories, which Catalyst cannot derive."""
    rows = spark.read.schema(f"{schemas.ARCHIVE}, part string").parquet(path).drop("part")
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(list(symbols)))
    stamp = lambda ns: datetime.fromtimestamp(ns // NS, timezone.utc).strftime("%Y-%m-%d %H")
    at = F.concat_ws(" ", "date", "hour")
    if from_ns is not None:
        low = stamp(from_ns)
        rows = rows.where((F.col("date") >= low[:10]) & (at >= low) & (F.col("event_time_ns") >= from_ns))
    if to_ns is not None:
        high = stamp(to_ns - 1)
        rows = rows.where((F.col("date") <= high[:10]) & (at <= high) & (F.col("event_time_ns") < to_ns))
    return rows


def replay(rows: DataFrame) -> DataFrame:
    """Rows once each, in replay order (event time, exchange, trade id compared as text)."""
    return rows.dropDuplicates(list(REPLAY_ORDER)).orderBy(*REPLAY_ORDER)


def paced(rows: DataFrame, speed: float) -> DataFrame:
    """``rows`` with ``due_ns``: when a replay at ``speed`` would send them after its start; 0 is at once."""
    if speed <= 0:
        return rows.withColumn("due_ns", F.lit(0).cast("long"))
    first = rows.agg(F.min("event_time_ns").alias("_t0"))
    return rows.join(F.broadcast(first)).withColumn("due_ns", ((F.col("event_time_ns") - F.col("_t0")) / F.lit(float(speed))).cast("long")).drop("_t0")  # one row is broadcast


def read_frames(spark: SparkSession, path: str, exchange: str, topic: str | None = None) -> DataFrame:
    """Recorded frames, a message a line, with the columns of a keyed log."""
    lines = spark.read.text(path)
    return lines.select(F.lit(topic or f"raw.trades.{exchange}").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(None).cast("string").alias("key"), "value", F.lit(exchange).alias("exchange"), F.lit(0).cast("long").alias("recv_time_ns"))


def log_reader(spark: SparkSession, options: dict[str, str], streaming: bool = False, starting: str = "earliest") -> DataFrame:
    """A Kafka topic as frames; needs the connector on the class path. Bounded unless ``streaming``."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options).option("startingOffsets", starting).option("includeHeaders", "true")
    if not streaming:
        reader = reader.option("endingOffsets", "latest")
    header = lambda k: F.expr(f"cast(filter(headers, h -> h.key = '{k}')[0].value AS string)")
    return reader.load().select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), header("exchange").alias("exchange"), header("recv_time_ns").cast("long").alias("recv_time_ns"))
