"""The rule language: conditions over metric fields, parsed into small frozen nodes.

    condition := expr ('>' | '>=' | '<' | '<=') number
    expr      := field | abs(expr) | zscore(field, lookback=N) | median_ratio(field, lookback=N)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Fixed values of the language.
FIELDS = ("last_price", "vwap", "volume", "trade_count", "realised_vol", "xex_spread_bps", "high", "low", "range_bps", "seconds_since_last_trade")
STALENESS = "seconds_since_last_trade"
LOOKBACK, LEAST_LOOKBACK, MOST_LOOKBACK = 30, 2, 10_000
SEVERITIES = {"INFO": "INFO", "WARN": "WARN", "WARNING": "WARN", "CRITICAL": "CRITICAL"}

TOKEN = re.compile(r"\s*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>>=|<=|>|<)|(?P<sign>[(),=]))")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Expr:
    func: str  # '', 'abs', 'zscore' or 'median_ratio'
    field: str = ""
    lookback: int = 0
    arg: Expr | None = None

    def __str__(self) -> str:
        if self.func == "abs":
            return f"abs({self.arg})"
        return f"{self.func}({self.field}, lookback={self.lookback})" if self.func else self.field

    def walk(self):
        yield self
        if self.arg:
            yield from self.arg.walk()

    def uses(self, field: str) -> bool:
        return any(x.field == field for x in self.walk())


@dataclass(frozen=True)
class Condition:
    expr: Expr
    op: str
    threshold: float

    def __str__(self) -> str:
        return f"{self.expr} {self.op} {number_text(self.threshold)}"


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Condition
    severity: str = "WARN"
    window_secs: int = 1
    cooldown_secs: int = 0

    @property
    def per_exchange(self) -> bool:
        return self.condition.expr.uses(STALENESS)

    def with_threshold(self, threshold: float) -> Rule:
        return replace(self, condition=replace(self.condition, threshold=threshold))


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    expected_exchanges: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Rule:
        return next(r for r in self.rules if r.name == name)


def number_text(x: float) -> str:
    """Shortest text of a number."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise RuleError(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", ""))

    def next(self, kind: str, value: str | None = None) -> str:
        k, v = self.tokens[0]
        if k != kind or value not in (None, v):
            raise RuleError(f"expected {value or kind}, found {v or 'the end'!r} in {self.text!r}")
        self.tokens.pop(0)
        return v

    def field(self) -> str:
        name = self.next("name")
        if name not in FIELDS:
            raise RuleError(f"unknown field {name!r}")
        return name

    def expr(self) -> Expr:
        name = self.next("name")
        if self.tokens[0] != ("sign", "("):
            if name not in FIELDS:
                raise RuleError(f"unknown field {name!r}")
            return Expr("", name)
        self.next("sign", "(")
        if name == "abs":
            out = Expr("abs", arg=self.expr())
        elif name in ("zscore", "median_ratio"):
            field, lookback = self.field(), LOOKBACK
            if field == STALENESS:
                raise RuleError(f"{field} has no history")
            while self.tokens[0] == ("sign", ","):
                self.next("sign", ",")
                self.next("name", "lookback")
                self.next("sign", "=")
                n = self.next("num")
                if not n.isdigit() or not LEAST_LOOKBACK <= int(n) <= MOST_LOOKBACK:
                    raise RuleError(f"lookback must be {LEAST_LOOKBACK} to {MOST_LOOKBACK}")
                lookback = int(n)
            out = Expr(name, field, lookback)
        else:
            raise RuleError(f"unknown function {name!r}")
        self.next("sign", ")")
        return out


def parse_condition(text: str) -> Condition:
    r = _Reader(text)
    out = Condition(r.expr(), r.next("op"), float(r.next("num")))
    r.next("end")
    return out


def make_rule(raw: dict) -> Rule:
    if unknown := set(raw) - {"name", "window_secs", "condition", "severity", "cooldown_secs"}:
        raise RuleError(f"unknown keys {sorted(unknown)}")
    name = str(raw.get("name", ""))
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise RuleError(f"bad rule name {name!r}")
    severity = SEVERITIES.get(str(raw.get("severity", "")).strip().upper())
    if severity is None:
        raise RuleError(f"bad severity {raw.get('severity')!r} of {name}")
    window, cooldown = raw.get("window_secs") or 1, raw.get("cooldown_secs", 0)
    if not isinstance(window, int) or window < 1 or not isinstance(cooldown, int) or cooldown < 0:
        raise RuleError(f"window_secs must be positive and cooldown_secs not negative in {name}")
    return Rule(name, parse_condition(str(raw.get("condition", ""))), severity, window, cooldown)


def load_rules(text: str) -> RuleSet:
    """A YAML document; unknown keys, repeated names and empty sets are errors."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or set(raw) - {"expected_exchanges", "rules"}:
        raise RuleError("the document must have rules and may have expected_exchanges")
    rules = tuple(make_rule(r) for r in raw.get("rules") or ())
    if not rules:
        raise RuleError("no rules")
    if len({r.name for r in rules}) < len(rules):
        raise RuleError("repeated rule name")
    return RuleSet(rules, tuple(raw.get("expected_exchanges") or ()))


# The rules shipped by default.
DEFAULT_RULES = """
expected_exchanges: [coinbase, kraken]
rules:
  - {name: price_jump, window_secs: 10, condition: "abs(zscore(last_price, lookback=30)) > 4", severity: WARN, cooldown_secs: 60}
  - {name: volume_spike, window_secs: 10, condition: "median_ratio(volume, lookback=60) > 5", severity: WARN, cooldown_secs: 120}
  - {name: cross_exchange_divergence, window_secs: 1, condition: "abs(xex_spread_bps) > 25", severity: CRITICAL, cooldown_secs: 30}
  - {name: stale_feed, condition: "seconds_since_last_trade > 15", severity: CRITICAL, cooldown_secs: 60}
"""
