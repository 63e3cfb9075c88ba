"""As-of look-ups by union and running extremes: one shuffle on key and time span, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meridia.functions.scalars import NS
from meridia.operators.spans import running

SPAN = 3600 * NS  # time of a key's rows that one task orders


def _found(probes: DataFrame, series: DataFrame, by: list[str], at: str, on: str, values: dict[str, str], after: bool, span: int) -> DataFrame:
    """Probes and series rows along one time axis; a probe takes the nearest series row on its side, a tie included."""
    hit = F.struct(F.col(on).alias("_t"), F.struct(*[c for c in dict.fromkeys(values) if c != on]).alias("_rest")) if set(values) - {on} else F.struct(F.col(on).alias("_t"))
    right = series.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_at"), F.lit(0).alias("_probe"), hit.alias("_hit"))
    left = probes.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = [F.col("_at").desc() if after else F.col("_at"), F.col("_probe")]  # series rows first: ties count
    out = running(both, by, order, F.floor(F.col("_at") / F.lit(span)), F.col("_hit"), "_best", inclusive=True, after=after).where("_probe = 1")
    cell = lambda c: "_best._t" if c == on else f"_best._rest.{c}"
    return out.select("_row.*", *[F.when(F.col("_at").isNotNull(), F.col(cell(c))).alias(n) for c, n in values.items()])


def asof_backward(probes: DataFrame, series: DataFrame, by: list[str], at: str, on: str, values: dict[str, str], span: int = SPAN) -> DataFrame:
    """Each probe with the values of the latest series row with ``on`` <= ``at``; ``values``: column to output name.

    Of series rows at one time the one with the greatest values counts.
    """
    return _found(probes, series, by, at, on, values, False, span)


def asof_forward(probes: DataFrame, series: DataFrame, by: list[str], at: str, on: str, values: dict[str, str], span: int = SPAN) -> DataFrame:
    """Each probe with the values of the first series row with ``on`` >= ``at``; of rows at one time, the least values."""
    return _found(probes, series, by, at, on, values, True, span)


def future_move_bps(points: DataFrame, prices: DataFrame, at: str, horizon_ns: int, out: str = "move_bps") -> DataFrame:
    """|p(t + h) - p(t)| / p(t) in basis points; null without a price, or where t + h is past the symbol's last price.

    ``prices``: (symbol, end_ns, price).
    """
    last = prices.groupBy("symbol").agg(F.max("end_ns").alias("_last"))  # a row a symbol
    p = asof_backward(points.withColumn("_later", F.col(at) + F.lit(horizon_ns)), prices, ["symbol"], at, "end_ns", {"price": "_p0"})
    p = asof_backward(p, prices, ["symbol"], "_later", "end_ns", {"price": "_p1"}).join(last, "symbol", "left")
    move = F.when((F.col("_later") <= F.col("_last")) & (F.col("_p0") != 0), F.abs(F.col("_p1") - F.col("_p0")) / F.col("_p0") * 1e4)
    return p.withColumn(out, move).drop("_later", "_p0", "_p1", "_last")


def labelled(points: DataFrame, prices: DataFrame, at: str, horizon_ns: int, event_bps: float) -> DataFrame:
    """Points whose horizon lies within the data, with ``event``: did the price move that far."""
    moved = future_move_bps(points, prices, at, horizon_ns)
    return moved.where("move_bps IS NOT NULL").withColumn("event", F.col("move_bps") >= event_bps)


def previous_mean(value: Column, n: int, w) -> Column:
    """Mean of the n rows before the current one, null unless there are n."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
