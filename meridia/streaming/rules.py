"""Rules over a stream of window metrics: look-backs, last trades and cooldowns are state of a symbol."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from math import sqrt
from statistics import fmean, median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meridia.functions.dsl import STALENESS, Expr, Rule, RuleSet
from meridia.operators.rules import DEGENERATE, alert_columns

NS = 1_000_000_000
FIRED = "rule string, symbol string, end_ns long, exchange string, value double, info map<string,double>, last_price double"


class SymbolRules:
    """The rules' state for one symbol, as plain values; records come in order of their ends."""

    def __init__(self, rules: RuleSet):
        self.rules = rules
        self.history: dict[tuple[str, int], deque[float]] = {}
        self.seen: dict[str, int] = {}
        self.fired: dict[tuple[str, str], int] = {}
        self.begun = False

    def take(self, record: dict) -> list[tuple]:
        """(rule, end, exchange, value, info, last price) of each alert that a record fires."""
        if not self.begun:
            self.begun = True
            self.seen = {x: record["window_start_ns"] for x in self.rules.expected_exchanges}
        for x in record["exchanges"]:
            self.seen[x["exchange"]] = max(self.seen.get(x["exchange"], x["last_trade_ns"]), x["last_trade_ns"])
        out = []
        for rule in self.rules.rules:
            if rule.window_secs != record["window_secs"]:
                continue
            for exchange in sorted(self.seen) if rule.per_exchange else [""]:
                value, info = self._value(rule, rule.condition.expr, record, exchange)
                if value is not None and self._fires(rule, record["window_end_ns"], exchange, value):
                    out.append((rule.name, record["window_end_ns"], exchange, value, info, float(record["last_price"])))
            # after the decision: a record is never part of its own baseline
            for slot, node in enumerate(rule.condition.expr.walk()):
                if node.lookback and (v := _field(node.field, record)) is not None:
                    self.history.setdefault((rule.name, slot), deque(maxlen=node.lookback)).append(v)
        return out

    def _fires(self, rule: Rule, end: int, exchange: str, value: float) -> bool:
        t = rule.condition.threshold
        if not {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t}[rule.condition.op]:
            return False
        last = self.fired.get((rule.name, exchange))
        if last is not None and end - last < rule.cooldown_secs * NS:
            return False
        self.fired[rule.name, exchange] = end
        return True

    def _value(self, rule: Rule, e: Expr, record: dict, exchange: str, slot: int = 0) -> tuple[float | None, dict[str, float]]:
        if e.func == "abs":
            value, info = self._value(rule, e.arg, record, exchange, slot + 1)
            return (None if value is None else abs(value)), info
        if not e.func:
            return ((record["window_end_ns"] - self.seen[exchange]) / NS if e.field == STALENESS else _field(e.field, record)), {}
        current, held = _field(e.field, record), self.history.get((rule.name, slot), ())
        if current is None or len(held) < e.lookback:
            return None, {}
        if e.func == "median_ratio":
            m = median(held)
            return (current / m if m > 0 else None), {"median": m, "current": current}
        mean = fmean(held)
        std = sqrt(sum((x - mean) ** 2 for x in held) / (len(held) - 1))
        return ((current - mean) / std if std > DEGENERATE * abs(mean) else None), {"mean": mean, "std": std, "current": current}


def _field(name: str, record: dict) -> float | None:
    if name == "range_bps":
        return (float(record["high"]) - float(record["low"])) / float(record["vwap"]) * 1e4 if record["vwap"] else None
    if name == "xex_spread_bps" and len(record["exchanges"]) < 2:
        return None
    return None if record[name] is None else float(record[name])


class RulesProcessor(StatefulProcessor):
    """One symbol a key. State is bounded by the rules' look-backs, and the engine's checkpoint restores it."""

    def __init__(self, rules: RuleSet):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rules", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = SymbolRules(self.rules)
        if self.state.exists():
            s.history, s.seen, s.fired, s.begun = pickle.loads(self.state.get()[0])
        batch = pd.concat(list(rows)).sort_values(["window_end_ns", "window_secs"])
        out = [(a[0], key[0], *a[1:]) for r in batch.to_dict("records") for a in s.take(r)]
        self.state.update((pickle.dumps((s.history, s.seen, s.fired, s.begun)),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIRED.replace("map<string,double>", "map").split(", ")])

    def close(self) -> None:
        pass


def stream_alerts(metrics: DataFrame, rules: RuleSet) -> DataFrame:
    """Alerts of a stream of window metrics, with the columns of the batch plan's."""
    fired = metrics.groupBy("symbol").transformWithStateInPandas(RulesProcessor(rules), FIRED, "Append", "None")
    return fired.select(*alert_columns(rules.rules))
