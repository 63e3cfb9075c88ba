"""Settings of a deployment, from variables of the environment or any mapping."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

SYMBOL = re.compile(r"[A-Z0-9]{1,12}-[A-Z0-9]{1,12}")


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


@dataclass(frozen=True)
class Settings:
    # The defaults.
    log_level: str = "info"
    brokers: tuple[str, ...] = ("localhost:9092",)
    symbols: tuple[str, ...] = ("BTC-USD", "ETH-USD", "SOL-USD")
    topic_raw_prefix: str = "raw.trades."
    topic_trades: str = "md.trades"
    topic_metrics: str = "md.metrics"
    topic_alerts: str = "risk.alerts"
    topic_feed_health: str = "md.feed_health"
    topic_dlq_prefix: str = "dlq."
    trace_sample_ratio: float = 0.01

    def __post_init__(self):
        if self.log_level.lower() not in ("debug", "info", "warn", "error"):
            raise ValueError(f"log level {self.log_level!r} is none of debug, info, warn, error")
        if not 0 <= self.trace_sample_ratio <= 1:
            raise ValueError("the trace sample ratio is between 0 and 1")
        if not self.brokers or not self.symbols:
            raise ValueError("brokers and symbols must not be empty")
        if bad := [s for s in self.symbols if not SYMBOL.fullmatch(s)]:
            raise ValueError(f"{bad[0]!r} is not in BASE-QUOTE form")

    @classmethod
    def load(cls, values: Mapping[str, str] = os.environ) -> Settings:
        names = {"log_level": "LOG_LEVEL", "symbols": "SYMBOLS", "brokers": "KAFKA_BROKERS", "trace_sample_ratio": "OTEL_TRACE_SAMPLE_RATIO"}
        names |= {f: f.upper() for f in cls.__dataclass_fields__ if f.startswith("topic_")}
        read = {"symbols": _list, "brokers": _list, "trace_sample_ratio": float}
        return cls(**{f: read.get(f, str)(values[n]) for f, n in names.items() if values.get(n)})

    def for_run(self, run_id: str) -> Settings:
        """The same with topics of their own for a replay."""
        return Settings(**{**self.__dict__, **{f: f"replay.{run_id}.{v}" for f, v in self.__dict__.items() if f.startswith("topic_")}})
