"""Walk-forward scoring of rules and of a mean-reversion signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meridia.functions.dsl import Rule, RuleSet
from meridia.functions.scalars import NS, ratio, round6
from meridia.operators import rules as R
from meridia.operators.asof import asof_forward, labelled, previous_mean
from meridia.operators.sequential import greedy_cooldown, non_overlapping
from meridia.sources.staging import stored

# The grids that tuning tries.
THRESHOLD_SCALES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
SIGNAL_GRID = (5.0, 10.0, 15.0, 20.0, 30.0, 50.0)
LEAST_TRADES = 5


@dataclass(frozen=True)
class Options:
    from_ns: int
    to_ns: int
    folds: int = 5
    train_blocks: int = 2
    horizon_ns: int = 60 * NS
    event_bps: float = 20.0
    cost_bps: float = 5.0
    lookback: int = 6
    hold_ns: int = 60 * NS
    price_secs: int = 1
    bar_secs: int = 10

    def __post_init__(self):
        if self.to_ns <= self.from_ns or self.folds < 2 or not 1 <= self.train_blocks < self.folds or self.lookback < 1 or self.hold_ns < 1 or self.cost_bps < 0:
            raise ValueError("bad backtest options")

    def start(self, i: int) -> int:
        return self.from_ns + i * ((self.to_ns - self.from_ns) // self.folds)


def folds(spark: SparkSession, o: Options) -> DataFrame:
    """(fold, train_from, test_from, test_to): a few rows."""
    rows = [(i + 1, o.start(i - o.train_blocks), o.start(i), o.start(i + 1)) for i in range(o.train_blocks, o.folds)]
    return spark.createDataFrame(rows, "fold int, train_from long, test_from long, test_to long")


def prices(metrics: DataFrame, secs: int = 1) -> DataFrame:
    return metrics.where(F.col("window_secs") == secs).select("symbol", F.col("window_end_ns").alias("end_ns"), F.col("last_price").cast("double").alias("price"))


def confusion(points: DataFrame, keys: list[str], cooldown_ns: int) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by ``keys``; points have symbol, end_ns, value, threshold, op, event.

    A crossing within the cooldown counts as not fired; cooldown starts empty in each key.
    """
    crossed = points.where("crossed").select(*keys, "symbol", "end_ns", "event")
    fired = greedy_cooldown(crossed, [*keys, "symbol"], "end_ns", cooldown_ns).select(*keys, "event", "fires")
    rest = points.where("NOT crossed").select(*keys, "event", F.lit(False).alias("fires"))
    n = lambda c: F.count_if(c)
    counts = fired.unionByName(rest).groupBy(*keys).agg(n(F.col("fires") & F.col("event")).alias("tp"), n(F.col("fires") & ~F.col("event")).alias("fp"), n(~F.col("fires") & F.col("event")).alias("fn"))
    return with_f1(counts)


def with_f1(counts: DataFrame) -> DataFrame:
    """Rounded precision and recall, and F1 of the rounded ones."""
    c = counts.withColumn("precision", round6(ratio(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", round6(ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    return c.withColumn("f1", round6(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def label_points(metrics: DataFrame, rule: Rule, o: Options) -> DataFrame:
    evals = R.evaluate_rule(metrics, rule).where("defined").select("symbol", "end_ns", "value")
    return labelled(evals, prices(metrics, o.price_secs), "end_ns", o.horizon_ns, o.event_bps)


def walk_forward(metrics: DataFrame, rule: Rule, o: Options) -> DataFrame:
    """A row a fold: the tuned threshold, its training F1, and out-of-sample counts tuned and fixed."""
    points = stored(label_points(metrics, rule, o), "points")  # read for training and for testing
    base = rule.condition.threshold
    fold = F.broadcast(folds(metrics.sparkSession, o))  # a few rows
    grid = F.explode(F.array(*[F.lit(base * s) for s in THRESHOLD_SCALES])).alias("threshold")
    train = points.join(fold, (F.col("end_ns") >= F.col("train_from")) & (F.col("end_ns") < F.col("test_from"))).select("fold", "symbol", "end_ns", "value", "event", grid)
    test = points.join(fold, (F.col("end_ns") >= F.col("test_from")) & (F.col("end_ns") < F.col("test_to"))).select("fold", "symbol", "end_ns", "value", "event", grid)
    cross = lambda df: df.withColumn("crossed", F.coalesce(_crossed(rule), F.lit(False)))
    cool = rule.cooldown_secs * NS
    trained = confusion(cross(train), ["fold", "threshold"], cool)
    best = trained.groupBy("fold").agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("tuned"), F.max("f1").alias("train_f1"))
    tested = confusion(cross(test), ["fold", "threshold"], cool)
    cells = ["tp", "fp", "fn", "precision", "recall", "f1"]
    tuned = tested.select("fold", F.col("threshold").alias("tuned"), *[F.col(c).alias(f"tuned_{c}") for c in cells])
    fixed = tested.where(F.col("threshold") == base).select("fold", *[F.col(c).alias(f"fixed_{c}") for c in cells])
    out = best.join(tuned, ["fold", "tuned"], "left").join(fixed, "fold", "left")
    return out.fillna(0).withColumn("rule", F.lit(rule.name))


def _crossed(rule: Rule):
    v, t = F.col("value"), F.col("threshold")
    return {">": v > t, ">=": v >= t, "<": v < t, "<=": v <= t}[rule.condition.op]


def total(walked: DataFrame, kind: str = "tuned") -> DataFrame:
    sums = walked.groupBy("rule").agg(*[F.sum(f"{kind}_{c}").alias(c) for c in ("tp", "fp", "fn")])
    return with_f1(sums)


def rule_report(metrics: DataFrame, rules: RuleSet, o: Options) -> dict[str, DataFrame]:
    """Per-exchange rules are operational and are not scored."""
    return {r.name: walk_forward(metrics, r, o) for r in rules.rules if not r.per_exchange}


def signal_candidates(metrics: DataFrame, o: Options) -> DataFrame:
    """Bars with a baseline and an exit: symbol, entry_ns, exit_ns, dev, side, net_return."""
    bars = metrics.where(F.col("window_secs") == o.bar_secs).select("symbol", F.col("window_end_ns").alias("end_ns"), F.col("vwap").cast("double").alias("vwap"), F.col("last_price").cast("double").alias("last"))
    w = Window.partitionBy("symbol").orderBy("end_ns")
    based = bars.withColumn("base", previous_mean(F.col("vwap"), o.lookback, w)).where("base IS NOT NULL").withColumn("_at", F.col("end_ns") + F.lit(o.hold_ns))
    out = asof_forward(based, bars, ["symbol"], "_at", "end_ns", {"end_ns": "exit_ns", "last": "exit_last"}).where("exit_ns IS NOT NULL")
    dev = (F.col("last") - F.col("base")) / F.col("base") * 1e4
    out = out.withColumn("dev", dev).withColumn("side", F.when(F.col("dev") < 0, 1).otherwise(-1))
    net = F.col("side") * (F.col("exit_last") - F.col("last")) / F.col("last") - F.lit(2 * o.cost_bps / 1e4)
    return out.select("symbol", F.col("end_ns").alias("entry_ns"), "exit_ns", "dev", "side", net.alias("net_return"))


def compounded(returns: Column, over=None) -> Column:
    """The product of 1 + return, aggregated or over a window; returns of -1 and below count as the product has them."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    factor = 1 + returns
    size = F.exp(at(F.sum(F.log(F.when(factor != 0, F.abs(factor))))))  # the log of no factor at all is null
    odd = at(F.sum((factor < 0).cast("int"))) % 2 == 1
    ruined = at(F.max((factor == 0).cast("int"))) == 1
    return F.when(ruined, F.lit(0.0)).otherwise(F.when(odd, -size).otherwise(size))


def simulate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One position a symbol at a time within ``keys``."""
    return non_overlapping(candidates, [*keys, "symbol"], "entry_ns", "exit_ns")


def trade_stats(trades: DataFrame, keys: list[str], span_ns) -> DataFrame:
    """Count, hit rate, mean, spread, Sharpe and return of trades by ``keys``."""
    mean, std = F.avg("net_return"), F.coalesce(F.stddev_samp("net_return"), F.lit(0.0))
    out = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"), mean.alias("_mean"), std.alias("_std"), (compounded(F.col("net_return")) - 1).alias("total_return"))
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") / F.when(F.col("_std") > 0, F.col("_std"))).otherwise(F.lit(0.0))
    days = (span_ns if not isinstance(span_ns, (int, float)) else F.lit(float(span_ns))) / F.lit(float(86_400 * NS))
    return out.withColumn("sharpe_per_trade", sharpe).withColumn("mean_return_bps", F.col("_mean") * 1e4).withColumn("std_return_bps", F.col("_std") * 1e4).withColumn("trades_per_day", F.col("trades") / days).withColumn(
        "sharpe_annualised", F.when(days >= 1, F.col("sharpe_per_trade") * F.sqrt(F.col("trades_per_day") * 365)).otherwise(F.lit(0.0))
    ).drop("_mean", "_std")


def tune_signal(metrics: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(folds with the tuned k, out-of-sample trades). A fold without a trusted setting has k = 0."""
    base = stored(signal_candidates(metrics, o), "candidates")
    fold = F.broadcast(folds(metrics.sparkSession, o))
    grid = F.explode(F.array(*map(F.lit, SIGNAL_GRID))).alias("k")
    within = lambda a, b: (F.col("entry_ns") >= F.col(a)) & (F.col("entry_ns") < F.col(b))
    cells = lambda df: df.select("fold", *base.columns, grid).where(F.abs("dev") >= F.col("k"))
    train = simulate(cells(base.join(fold, within("train_from", "test_from"))), ["fold", "k"])
    stats = trade_stats(train, ["fold", "k"], o.start(1) - o.from_ns).where(F.col("trades") >= LEAST_TRADES)
    best = stats.groupBy("fold").agg(F.max_by("k", F.struct("sharpe_per_trade", -F.col("k"))).alias("k"), F.max("sharpe_per_trade").alias("train_sharpe"))
    chosen = fold.select("fold").join(best, "fold", "left").select("fold", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce(round6(F.col("train_sharpe")), F.lit(0.0)).alias("train_sharpe"))
    test = simulate(cells(base.join(fold, within("test_from", "test_to"))), ["fold", "k"]).join(chosen.select("fold", "k"), ["fold", "k"], "left_semi")
    return chosen, test


def equity_curve(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Compounded equity, running peak and drawdown after each exit, by ``keys``.

    Trades of one run are few (positions do not overlap); a running product orders them once.
    """
    w = Window.partitionBy(*keys).orderBy("exit_ns", "symbol")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = trades.withColumn("equity", compounded(F.col("net_return"), run))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(run)))
    return e.select(*keys, "exit_ns", "symbol", "equity", "peak", (1 - F.col("equity") / F.col("peak")).alias("drawdown"))


def downsample(curve: DataFrame, keys: list[str], order: list[str], most: int = 500) -> DataFrame:
    """At most ``most`` evenly spaced rows, ends included: those at index i * (len - 1) / (most - 1)."""
    w = Window.partitionBy(*keys)
    c = curve.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slot = F.ceil(F.col("_i") * F.lit(most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    picked = (F.col("_n") <= most) | (F.floor(slot * (F.col("_n") - 1) / F.lit(most - 1)) == F.col("_i"))
    return c.where(picked).drop("_i", "_n")


def fingerprint(rows: DataFrame, line, order, block) -> DataFrame:
    """SHA-256 of the rows' text in order: rows are digested by ``block`` (say, a day), then the blocks' digests are."""
    lined = rows.select(block.alias("b"), F.struct(order.alias("o"), line.alias("line")).alias("x"))
    each = lined.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), 256).alias("digest"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("fingerprint"))


def fingerprint_tree(rows: DataFrame, line: Column, order: Column, at: Column, spans: tuple[int, ...]) -> DataFrame:
    """As ``fingerprint``, in levels: rows are digested by the smallest span of ``at``, those digests by the next one, and so on."""
    level = rows.select(at.alias("at"), F.struct(order.alias("o"), line.alias("line")).alias("x"))
    for span in spans:
        start = (F.col("at") - F.pmod(F.col("at"), F.lit(span))).alias("at")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
        each = level.groupBy(start).agg(F.sha2(joined, 256).alias("line"))
        level = each.select("at", F.struct(F.col("at").alias("o"), "line").alias("x"))
    return level.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), 256).alias("fingerprint"))
