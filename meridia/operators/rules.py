"""Rules over window metrics: conditions become columns, cooldown becomes a session fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meridia.functions.dsl import STALENESS, Condition, Expr, Rule, RuleSet, number_text
from meridia.functions.scalars import NS, alert_id, range_bps, rfc3339
from meridia.operators.asof import SPAN
from meridia.operators.sequential import greedy_cooldown
from meridia.operators.spans import running

DEGENERATE = 1e-12  # a spread this small against the mean is a constant baseline


def field_value(name: str) -> Column:
    """A metrics field as a double, null where undefined."""
    if name == "range_bps":
        return range_bps(F.col("high"), F.col("low"), F.col("vwap"))
    if name == "xex_spread_bps":  # undefined with fewer than two venues
        return F.when(F.size("exchanges") >= 2, F.col(name))
    return F.col(name).cast("double")


def compare(value: Column, op: str, threshold: float) -> Column:
    return {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}[op]


def _with_value(rows: DataFrame, e: Expr) -> DataFrame:
    """``rows`` with value (null: undefined) and info, a map of the numbers behind it."""
    none = F.create_map().cast("map<string,double>")
    if e.func == "abs":
        return _with_value(rows, e.arg).withColumn("value", F.abs("value"))
    if not e.func:
        value = F.col("_staleness") if e.field == STALENESS else field_value(e.field)
        return rows.withColumn("value", value).withColumn("info", none)
    # the look-back counts rows whose field is defined, so undefined rows go aside
    kept = rows.withColumn("current", field_value(e.field))
    w = Window.partitionBy("symbol").orderBy("window_end_ns").rowsBetween(-e.lookback, -1)
    defined = kept.where("current IS NOT NULL").withColumn("_full", F.count("current").over(w) == e.lookback)
    if e.func == "zscore":
        mean, std = F.avg("current").over(w), F.stddev_samp("current").over(w)
        d = defined.withColumn("_mean", mean).withColumn("_std", std)
        good = F.col("_full") & (F.col("_std") > DEGENERATE * F.abs("_mean"))
        d = d.withColumn("value", F.when(good, (F.col("current") - F.col("_mean")) / F.col("_std")))
        info = F.create_map(F.lit("mean"), "_mean", F.lit("std"), "_std", F.lit("current"), "current")
    else:
        d = defined.withColumn("_median", F.percentile("current", F.lit(0.5)).over(w))
        good = F.col("_full") & (F.col("_median") > 0)
        d = d.withColumn("value", F.when(good, F.col("current") / F.col("_median")))
        info = F.create_map(F.lit("median"), "_median", F.lit("current"), "current")
    d = d.withColumn("info", info).select(*rows.columns, "value", "info")
    aside = kept.where("current IS NULL").withColumn("value", F.lit(None).cast("double")).withColumn("info", none).select(*rows.columns, "value", "info")
    return d.unionByName(aside)


def staleness_rows(metrics: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """A row per (record, exchange) with seconds since its last trade.

    An exchange is known from its first trade on; expected ones from the symbol's first record.
    """
    seen = metrics.select("symbol", "window_end_ns", F.explode("exchanges").alias("x")).select("symbol", F.col("x.exchange").alias("exchange"), "window_end_ns", F.col("x.last_trade_ns").alias("seen_ns"))
    first = metrics.groupBy("symbol").agg(F.min("window_start_ns").alias("seen_ns"), F.min("window_end_ns").alias("window_end_ns"))
    names = first.select("symbol", "window_end_ns", "seen_ns", F.explode(F.array(*map(F.lit, expected))).alias("exchange")) if expected else None
    known = seen.unionByName(names) if names is not None else seen
    pairs = known.groupBy("symbol", "exchange").agg(F.min("window_end_ns").alias("since"))
    # every record of the symbol with every exchange known by then: a few venues a symbol
    rows = metrics.join(pairs, "symbol").where(F.col("window_end_ns") >= F.col("since"))
    at = known.groupBy("symbol", "exchange", "window_end_ns").agg(F.max("seen_ns").alias("seen_ns"))
    joined = rows.join(at, ["symbol", "exchange", "window_end_ns"], "left")
    w = Window.partitionBy("symbol", "exchange").orderBy("window_end_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("_staleness", (F.col("window_end_ns") - F.max("seen_ns").over(w)) / F.lit(float(NS))).drop("since", "seen_ns")


def evaluate_rule(metrics: DataFrame, rule: Rule, expected: tuple[str, ...] = ()) -> DataFrame:
    """Every evaluation of a rule: rule, symbol, end, exchange, value, defined, crossed, info, last_price."""
    rows = metrics.where(F.col("window_secs") == rule.window_secs)
    rows = staleness_rows(rows, expected) if rule.per_exchange else rows.withColumn("exchange", F.lit(""))
    c = rule.condition
    valued = _with_value(rows, c.expr)
    crossed = F.coalesce(compare(F.col("value"), c.op, c.threshold), F.lit(False))
    return valued.select(F.lit(rule.name).alias("rule"), "symbol", F.col("window_end_ns").alias("end_ns"), "exchange", "value", F.col("value").isNotNull().alias("defined"), crossed.alias("crossed"), "info", F.col("last_price").cast("double").alias("last_price"))


def evaluate(metrics: DataFrame, rules: RuleSet) -> DataFrame:
    return reduce(DataFrame.unionByName, [evaluate_rule(metrics, r, rules.expected_exchanges) for r in rules.rules])


def message(rule: Rule) -> Column:
    c: Condition = rule.condition
    subject = F.when(F.col("exchange") == "", F.col("symbol")).otherwise(F.concat_ws(" ", "exchange", "symbol"))
    return F.concat(F.lit(f"{rule.name} "), subject, F.lit(f": {c.expr} = "), F.format_string("%.2f", F.col("value")), F.lit(f" {c.op} {number_text(c.threshold)} ({rule.window_secs}s window ending "), rfc3339(F.col("end_ns")), F.lit(")"))


def fire(evals: DataFrame, rule: Rule) -> DataFrame:
    """Alerts of one rule: crossings that its cooldown lets through."""
    own = evals.where((F.col("rule") == rule.name) & F.col("crossed"))
    own = own.withColumn("fires", F.lit(True)) if not rule.cooldown_secs else greedy_cooldown(own, ["rule", "symbol", "exchange"], "end_ns", rule.cooldown_secs * NS)
    return own.where("fires").select(*alert_columns((rule,)))


def alert_columns(rules: tuple[Rule, ...]) -> list[Column]:
    """The columns of alerts over fired evaluations (rule, symbol, end_ns, exchange, value, info, last_price)."""

    def by_rule(column: Callable[[Rule], Column]) -> Column:
        out = column(rules[-1])
        for r in reversed(rules[:-1]):
            out = F.when(F.col("rule") == r.name, column(r)).otherwise(out)
        return out

    threshold = by_rule(lambda r: F.lit(float(r.condition.threshold)))
    values = F.map_filter(F.map_concat(F.create_map(F.lit("value"), "value", F.lit("threshold"), threshold, F.lit("last_price"), "last_price"), "info"), lambda _, v: v.isNotNull())
    ident = alert_id(F.col("rule"), F.col("symbol"), F.col("end_ns"), F.col("exchange")).alias("alert_id")
    return [ident, F.col("rule").alias("rule_name"), F.col("symbol"), by_rule(lambda r: F.lit(r.severity)).alias("severity"), F.col("end_ns").alias("window_end_ns"), by_rule(message).alias("message"), values.alias("values"), F.col("exchange")]


def at_least(alerts: DataFrame, severity: str) -> DataFrame:
    """Alerts of a severity or a graver one."""
    order = ["INFO", "WARN", "CRITICAL"]
    return alerts.where(F.col("severity").isin(order[order.index(severity) :]))


def alerts(metrics: DataFrame, rules: RuleSet) -> DataFrame:
    return reduce(DataFrame.unionByName, [fire(evaluate_rule(metrics, r, rules.expected_exchanges), r) for r in rules.rules])


def alert_counts(alerts: DataFrame, rules: RuleSet) -> DataFrame:
    """(rule_name, severity, n): a row for each rule, with 0 where it has no alert."""
    n = alerts.groupBy("rule_name", "severity").agg(F.count(F.lit(1)).alias("n"))
    names = alerts.sparkSession.createDataFrame([(r.name, r.severity) for r in rules.rules], "rule_name string, severity string")
    return names.join(n, ["rule_name", "severity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def feed_gaps(frames: DataFrame, symbols: list[str], least_ns: int = 2 * NS) -> DataFrame:
    """One ``feed_gap`` alert a symbol where an exchange's receive times leave a gap."""
    at = F.col("recv_time_ns")
    seen = running(frames.select("exchange", "recv_time_ns"), ["exchange"], [at], F.floor(at / F.lit(SPAN)), at, "_before")
    gaps = seen.withColumn("gap", at - F.col("_before")).where(F.col("gap") >= least_ns)
    each = gaps.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols)))).withColumn("rule_name", F.lit("feed_gap"))
    return each.select(alert_id(F.col("rule_name"), F.col("symbol"), F.col("recv_time_ns"), F.col("exchange")).alias("alert_id"), "rule_name", "symbol", F.lit("WARN").alias("severity"), F.col("recv_time_ns").alias("window_end_ns"), F.create_map(F.lit("gap_secs"), F.col("gap") / F.lit(float(NS))).alias("values"), "exchange")


def feed_health(trades: DataFrame, now_ns: Column, stale_ns: int = 15 * NS, connected: Column | None = None) -> DataFrame:
    """Status of each (exchange, symbol) at a report time."""
    last = trades.groupBy("exchange", "symbol").agg(F.max("recv_time_ns").alias("last_trade_ns"))
    up = F.lit(True) if connected is None else connected
    status = F.when(~up, "reconnecting").when(F.col("last_trade_ns").isNull() | (now_ns - F.col("last_trade_ns") > stale_ns), "stale").otherwise("connected")
    return last.select("exchange", "symbol", "last_trade_ns", F.lit(0).cast("long").alias("reconnects"), status.alias("status"), now_ns.alias("reported_at_ns"))
