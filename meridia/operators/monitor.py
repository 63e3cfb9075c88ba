"""Figures about streams: latencies, rates, counts and points for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meridia.functions.scalars import NS, align

# The least bucket of latencies in seconds, and how many buckets double from it.
LEAST_BUCKET, BUCKETS = 0.0005, 16


def latency_buckets(rows: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """(keys, le, n): rows with at most ``le`` seconds, cumulative as in a histogram; the last ``le`` is infinity."""
    bounds = [LEAST_BUCKET * 2**i for i in range(BUCKETS)]
    counts = rows.groupBy(*keys).agg(*[F.count_if(seconds <= F.lit(b)).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(seconds).alias("_all"))
    each = [F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n"))]
    return counts.select(*keys, F.inline(F.array(*each)))


def latency_quantiles(rows: DataFrame, keys: list[str], seconds: Column, exact: bool = False) -> DataFrame:
    """(keys, p50, p95, p99). A sketch of bounded size unless ``exact``, which holds a count a distinct value."""
    at = [0.5, 0.95, 0.99]
    found = F.percentile(seconds, F.array(*map(F.lit, at))) if exact else F.percentile_approx(seconds, at, 10_000)
    out = rows.groupBy(*keys).agg(found.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(at)])


def increase(rows: DataFrame, keys: list[str], at_ns: str, secs: int) -> DataFrame:
    """(keys, start_ns, n, per_sec): rows in each stretch of ``secs`` seconds, and the rate."""
    counted = rows.groupBy(*keys, align(F.col(at_ns), secs).alias("start_ns")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("per_sec", F.col("n") / F.lit(float(secs)))


def distinct_symbols(trades: DataFrame) -> DataFrame:
    return trades.select("symbol").distinct().orderBy("symbol")


def point_a_second(curve: DataFrame, keys: list[str], at_ns: str, value: str, order: list[str]) -> DataFrame:
    """(keys, time, value): the last point in ``order`` of each second, rounded half up."""
    second = F.floor((F.col(at_ns) + F.lit(NS // 2)) / F.lit(NS)).alias("time")
    return curve.groupBy(*keys, second).agg(F.max_by(value, F.struct(*order)).alias("value"))


def sorted_keys(values: Column) -> Column:
    return F.array_sort(F.map_keys(values))
