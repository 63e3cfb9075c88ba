"""Trades derived from the star-schema tables, for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.functions.scalars import NS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_as_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an unchecked trade; a size of 0 is invalid."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_type").alias("exchange"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"), F.lit("-USD")).alias("symbol"),
        F.col("event_id").cast("string").alias("trade_id"),
        (micros * 1000).alias("event_time_ns"),
        (micros * 1000 + F.lit(NS // 1000)).alias("recv_time_ns"),
        F.col("value").cast("decimal(18,8)").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("decimal(18,8)").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        (F.col("user_id") % 3).cast("int").alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
    )


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_raw(spark, sf_dir).where("size > 0 AND price > 0")


def messy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades redelivered (every 20th) and out of order: deterministic lateness and duplicates."""
    good = trades_from_events(spark, sf_dir)
    moved = good.withColumn("kafka_offset", F.col("kafka_offset") * 10 + (F.col("kafka_offset") * 7919 % 23) * 10)
    again = moved.where("CAST(trade_id AS BIGINT) % 20 = 0").withColumn("kafka_offset", F.col("kafka_offset") + 5)
    ordered = moved.unionByName(again)
    # offsets must be unique: ties by trade id
    return ordered.withColumn("kafka_offset", F.col("kafka_offset") * 100_000_000 + F.col("trade_id").cast("long"))


def trades_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger table of trades, for throughput. Every row is a trade, though its order and line number, the id, may repeat."""
    li = table(spark, sf_dir, "lineitem")
    at = (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)") + F.col("l_orderkey") * 7 % 86400 + F.col("l_linenumber")) * F.lit(NS)
    return li.select(
        F.col("l_returnflag").alias("exchange"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string"), F.lit("-USD")).alias("symbol"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("trade_id"),
        at.alias("event_time_ns"),
        at.alias("recv_time_ns"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,8)").alias("price"),
        F.col("l_quantity").cast("decimal(18,8)").alias("size"),
        F.lit("buy").alias("side"),
        (F.col("l_suppkey") % 50).cast("int").alias("kafka_partition"),
        (at / F.lit(NS) * 100_000 + F.col("l_orderkey") % 100_000).cast("long").alias("kafka_offset"),
    )


def generate_trades(spark: SparkSession, minutes: int = 20, per_second: int = 10, symbols=("BTC-USD", "ETH-USD", "SOL-USD"), exchanges=("coinbase", "kraken"), seed: int = 1, start_ns: int = 1_791_121_800 * NS) -> DataFrame:
    """Seeded synthetic trades: drifting prices, jumps, volume bursts and venue divergence; any size, no driver state."""
    n = minutes * 60 * per_second
    r = spark.range(n).select("id", F.rand(seed).alias("u"), F.randn(seed + 1).alias("g"), F.rand(seed + 2).alias("v"), F.rand(seed + 3).alias("w"))
    sec = F.floor(F.col("id") / per_second)
    pick = lambda names, x: F.element_at(F.array(*map(F.lit, names)), F.least(F.floor(x * len(names)) + 1, F.lit(len(names))).cast("int"))
    level = F.lit(100.0) * (1 + 0.01 * F.sin(sec / 97.0) + 0.004 * F.sin(sec / 11.0) + F.when(F.pmod(sec, F.lit(311)) < 5, 0.01).otherwise(0.0))
    venue = F.when((F.col("exchange") == exchanges[-1]) & (F.pmod(sec, F.lit(501)) < 7), 1.004).otherwise(1.0)
    rows = r.withColumn("symbol", pick(symbols, F.col("v"))).withColumn("exchange", pick(exchanges, F.col("w")))
    at = F.lit(start_ns) + (F.col("id") * (NS // per_second)).cast("long") + F.floor(F.col("u") * (NS // per_second // 2)).cast("long")
    burst = F.when(F.pmod(sec, F.lit(211)) < 3, 8.0).otherwise(1.0)
    return rows.select(
        "exchange", "symbol", F.col("id").cast("string").alias("trade_id"), at.alias("event_time_ns"), (at + F.lit(4_000_000)).alias("recv_time_ns"),
        (level * venue * (1 + 0.0002 * F.col("g"))).cast("decimal(18,4)").cast("decimal(18,8)").alias("price"),
        ((0.01 + F.col("u")) * burst).cast("decimal(18,4)").cast("decimal(18,8)").alias("size"),
        F.when(F.col("u") < 0.5, "buy").otherwise("sell").alias("side"),
        F.pmod(F.hash("symbol"), F.lit(6)).alias("kafka_partition"), F.col("id").alias("kafka_offset"),
    )
