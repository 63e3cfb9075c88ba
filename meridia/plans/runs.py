"""A whole run: trades to windows, alerts and evaluations, then a walk-forward report on storage."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meridia.functions.dsl import RuleSet
from meridia.functions.scalars import NS
from meridia.operators import backtest as B, rules as R
from meridia.operators.monitor import distinct_symbols
from meridia.operators.serve import BadRequest, NotFound, first_windows
from meridia.operators.windows import LATENESS_NS, SIZES, window_metrics
from meridia.sources.staging import stored

BLOCK_NS = 3600 * NS  # rows of an hour are digested together
SECOND_NS = NS


@dataclass(frozen=True)
class Run:
    """``evals`` leaves out per-exchange rules, which are not scored. ``trades`` is None in a run from metrics."""

    trades: DataFrame | None
    metrics: DataFrame
    alerts: DataFrame
    evals: DataFrame

    def counts(self) -> dict[str, int]:
        return {"trades": 0 if self.trades is None else self.trades.count(), "windows": self.metrics.count(), "alerts": self.alerts.count()}


def check_run_id(run_id: str) -> str:
    """A run id is part of a path: letters, digits, - and _ only."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id or ""):
        raise BadRequest("invalid run id")
    return run_id


def run_pipeline(trades: DataFrame, rules: RuleSet, sizes=SIZES, lateness_ns: int = LATENESS_NS, flush: bool = False) -> Run:
    """Trades as delivered to windows, alerts and evaluations. Windows still open at the end are left out unless ``flush``."""
    metrics = stored(window_metrics(trades, sizes, lateness_ns, flush), "metrics")
    return replace(_ruled(metrics, rules), trades=trades)


def run_from_metrics(metrics: DataFrame, rules: RuleSet, arrival: str) -> Run:
    """The same from windows made elsewhere; repeats, as after a restart, count once, by ``arrival``."""
    return _ruled(stored(first_windows(metrics, arrival).drop(arrival), "metrics"), rules)


def _ruled(metrics: DataFrame, rules: RuleSet) -> Run:
    scored = tuple(r for r in rules.rules if not r.per_exchange)
    evals = R.evaluate(metrics, RuleSet(scored, rules.expected_exchanges)) if scored else metrics.sparkSession.createDataFrame([], "rule string, symbol string, end_ns long, value double, defined boolean")
    return Run(None, metrics, R.alerts(metrics, rules), evals.select("rule", "symbol", "end_ns", "value", "defined"))


def _line(rows: DataFrame) -> Column:
    """A row's text: its columns by name, so that their order in the table does not count."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def _digest(rows: DataFrame, at: str, order: Column) -> DataFrame:
    return B.fingerprint_tree(rows, _line(rows), order, F.col(at), (SECOND_NS, BLOCK_NS))


def input_fingerprint(trades: DataFrame) -> DataFrame:
    """SHA-256 over trades in replay order, whatever their partitioning and delivery."""
    t = trades.select("exchange", "symbol", "trade_id", "event_time_ns", "recv_time_ns", "price", "size", "side")
    return _digest(t, "event_time_ns", F.struct("event_time_ns", "exchange", "trade_id", "symbol", "recv_time_ns", "price", "size", "side"))


def metrics_fingerprint(metrics: DataFrame) -> DataFrame:
    """SHA-256 over every column of the windows by (end, size, symbol)."""
    return _digest(metrics, "window_end_ns", F.struct("window_end_ns", "window_secs", "symbol"))


def trades_by_exit(trades: DataFrame) -> DataFrame:
    return trades.orderBy("exit_ns", "symbol")


def report(run: Run, rules: RuleSet, o: B.Options, run_id: str) -> dict:
    """What a run found, out of sample. It has no times of its own, so equal inputs and options give equal reports.

    Each rule has a row a fold and the signal at most 500 points, so all that comes to the driver is small.
    """
    at = _stamp
    out_rules = []
    for name, walked in B.rule_report(run.metrics, rules, o).items():
        walked = stored(walked, "folds")
        folds = [{"fold": r["fold"], "test_from": at(o.start(r["fold"] - 1)), "threshold": r["tuned"], "train_f1": r["train_f1"], "test": {c: r[f"tuned_{c}"] for c in ("tp", "fp", "fn", "precision", "recall", "f1")}} for r in walked.orderBy("fold").collect()]
        totals = {kind: [t.asDict() for t in B.total(walked, kind).drop("rule").collect()] for kind in ("tuned", "fixed")}
        out_rules.append({"name": name, "folds": folds, **{f"out_of_sample_{k}": (v or [{}])[0] for k, v in totals.items()}})
    chosen, tested = B.tune_signal(run.metrics, o)
    tested = stored(tested, "signal_trades")
    span = o.start(o.folds) - o.start(o.train_blocks)
    stats = [r.asDict() for r in B.trade_stats(tested.withColumn("_all", F.lit(1)), ["_all"], span).drop("_all").collect()]
    curve = B.equity_curve(tested.withColumn("_all", F.lit(1)), ["_all"])
    drawdown = curve.agg(F.max("drawdown")).first()[0]
    points = B.downsample(curve, ["_all"], ["exit_ns", "symbol"]).orderBy("exit_ns", "symbol").collect()
    none = {"trades": 0, "hit_rate": 0.0, "mean_return_bps": 0.0, "sharpe_per_trade": 0.0, "sharpe_annualised": 0.0, "total_return": 0.0}
    signal = {
        "folds": [r.asDict() for r in chosen.orderBy("fold").collect()],
        "out_of_sample": {**(stats[0] if stats else none), "max_drawdown": drawdown or 0.0},
        "equity_curve": [{"time_ns": p["exit_ns"], "equity": p["equity"]} for p in points],
    }
    prints = {"input_sha256": None if run.trades is None else input_fingerprint(run.trades).first()[0], "metrics_sha256": metrics_fingerprint(run.metrics).first()[0]}
    return {
        "run_id": check_run_id(run_id), "from": at(o.from_ns), "to": at(o.to_ns),
        "symbols": [r[0] for r in distinct_symbols(run.metrics).collect()],  # the configured few
        "options": {"folds": o.folds, "train_blocks": o.train_blocks, "horizon_secs": o.horizon_ns / NS, "event_bps": o.event_bps, "cost_bps_per_fill": o.cost_bps, "signal_lookback_windows": o.lookback, "signal_hold_secs": o.hold_ns / NS},
        "data": {**run.counts(), **prints}, "rules": out_rules, "signal": signal,
    }


def _stamp(ns: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ns // NS, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def markdown(rep: dict) -> str:
    data, o, s = rep["data"], rep["options"], rep["signal"]["out_of_sample"]
    cell = lambda x, kind, c: f"{x[f'out_of_sample_{kind}'].get(c, 0.0):.2f}"
    rules = [f"| {x['name']} | " + " | ".join(cell(x, k, c) for k in ("tuned", "fixed") for c in ("precision", "recall")) + " |" for x in rep["rules"]]
    return "\n".join([
        f"# Backtest {rep['run_id']}", "",
        f"{rep['from']} to {rep['to']}; symbols {', '.join(rep['symbols'])}; {data['trades']} trades, {data['windows']} windows, {data['alerts']} alerts.", "",
        f"{o['folds']} blocks, each test block tuned on the {o['train_blocks']} before it. An event is a move of {o['event_bps']:.0f} bps or more within {o['horizon_secs']:.0f} s.", "",
        "## Rules, out of sample", "", "| Rule | Precision, tuned | Recall, tuned | Precision, configured | Recall, configured |", "|-|-|-|-|-|", *rules, "",
        "## Signal, out of sample", "", "| Trades | Hit rate | Mean, bps | Sharpe a trade | Sharpe a year | Largest drawdown | Return |", "|-|-|-|-|-|-|-|",
        f"| {s['trades']} | {s['hit_rate']:.2f} | {s['mean_return_bps']:.2f} | {s['sharpe_per_trade']:.3f} | {s['sharpe_annualised']:.2f} | {s['max_drawdown']:.2%} | {s['total_return']:.2%} |", "",
        f"Input SHA-256: `{data['input_sha256']}`", "",
    ])


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_report(spark: SparkSession, rep: dict, root: str) -> str:
    """report.json and report.md under ``root``/<run id>, on any file system that Spark reaches; a repeated run overwrites them."""
    folder = f"{root.rstrip('/')}/{check_run_id(rep['run_id'])}"
    for name, text in (("report.md", markdown(rep)), ("report.json", json.dumps(rep, indent=2, sort_keys=True))):  # the listed file comes last
        fs, target = _fs(spark, f"{folder}/{name}")
        out = fs.create(target, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    return folder


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of the runs that have a report, sorted."""
    fs, target = _fs(spark, f"{root.rstrip('/')}/*/report.json")
    return sorted(f.getPath().getParent().getName() for f in (fs.globStatus(target) or []))


def read_report(spark: SparkSession, root: str, run_id: str) -> dict:
    path = f"{root.rstrip('/')}/{check_run_id(run_id)}/report.json"
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        raise NotFound("no such backtest")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
