"""Live window metrics: a stateful processor per partition, and idempotent sinks."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meridia.operators.serve import insert_absent, upsert_newer
from meridia.operators.windows import LATENESS_NS, SIZES, check_sizes

NS = 1_000_000_000
OUTPUT = (
    "kafka_partition int, symbol string, window_secs int, window_start_ns long, window_end_ns long, vwap decimal(28,10), volume decimal(28,8), trade_count long, realised_vol double, "
    "high decimal(18,8), low decimal(18,8), last_price decimal(18,8), xex_spread_bps double, emitted_at_ns long, "
    "exchanges array<struct<exchange:string,vwap:decimal(28,10),volume:decimal(28,8),trade_count:long,last_trade_ns:long>>"
)
COLUMNS = [c.split()[0] for c in OUTPUT.partition(", exchanges")[0].split(", ")] + ["exchanges"]
TEN, SIX = Decimal(1).scaleb(-10), Decimal(1).scaleb(-6)


def _quotient(a: Decimal, b: Decimal, unit: Decimal) -> Decimal:
    return (a / b).quantize(unit, rounding=ROUND_HALF_UP)


class WindowState:
    """Open windows, recent keys and the watermark of one partition, as plain values.

    ``seen`` has a set of (exchange, trade id) for each smallest window. ``windows`` maps (symbol,
    size, start) to venue -> [spq, sq, n, high, low, last time, last price, last arrival price,
    sum of squared returns, returns, arrival of the last price].
    """

    def __init__(self, sizes=SIZES, lateness_ns=LATENESS_NS):
        self.sizes, self.lateness = check_sizes(sizes), lateness_ns
        self.high: int | None = None
        self.arrivals = 0
        self.seen: dict[int, set[tuple[str, str]]] = {}
        self.windows: dict[tuple[str, int, int], dict[str, list]] = {}
        self.counts: Counter = Counter()

    @property
    def watermark(self) -> int | None:
        return None if self.high is None else self.high - self.lateness

    def add(self, exchange: str, symbol: str, trade_id: str, t: int, price: Decimal, size: Decimal) -> str:
        outcome = self._add(exchange, symbol, trade_id, t, price, size)
        self.counts[outcome] += 1
        return outcome

    def _add(self, exchange, symbol, trade_id, t, price, size) -> str:
        smallest = self.sizes[0] * NS
        start = t - t % smallest
        if self.high is not None and start + smallest <= self.watermark:
            return "late"
        bucket = self.seen.setdefault(start, set())
        if (exchange, trade_id) in bucket:
            return "duplicate"
        bucket.add((exchange, trade_id))
        self.arrivals += 1
        for s in self.sizes:
            venues = self.windows.setdefault((symbol, s, t - t % (s * NS)), {})
            v = venues.get(exchange)
            if v is None:
                venues[exchange] = [price * size, size, 1, price, price, t, price, price, 0.0, 0, self.arrivals]
                continue
            r = log(float(price) / float(v[7]))
            v[0] += price * size
            v[1] += size
            v[2] += 1
            v[3], v[4] = max(v[3], price), min(v[4], price)
            if t >= v[5]:
                v[5], v[6], v[10] = t, price, self.arrivals
            v[7] = price
            v[8] += r * r
            v[9] += 1
        self.high = t if self.high is None else max(self.high, t)
        return "accepted"

    def close(self, watermark: int | None = None) -> list[tuple]:
        """Rows of the windows that end by the watermark, in emission order; their state goes."""
        mark = self.watermark if watermark is None else watermark
        if mark is None:
            return []
        done = sorted((k for k in self.windows if k[2] + k[1] * NS <= mark), key=lambda k: (k[2] + k[1] * NS, k[1], k[0]))
        out = [self._row(k, self.windows.pop(k), mark) for k in done]
        if done:
            self.seen = {start: keys for start, keys in self.seen.items() if start + self.sizes[0] * NS > mark}
        return out

    @staticmethod
    def _row(key, venues, mark):
        symbol, secs, start = key
        spq, sq = sum(v[0] for v in venues.values()), sum(v[1] for v in venues.values())
        means = [(name, _quotient(v[0], v[1], TEN)) for name, v in sorted(venues.items())]
        spread = 0.0
        if len(means) > 1 and (mid := (means[0][1] + means[1][1]) / 2):
            spread = float(((means[0][1] - means[1][1]) * 10_000 / mid).quantize(SIX, rounding=ROUND_HALF_UP))
        variances = [v[8] for v in venues.values() if v[9]]
        variance = sum(variances) / len(variances) if variances else 0.0
        last = max(venues.values(), key=lambda v: (v[5], v[10]))  # of equal times the later arrival
        each = [{"exchange": name, "vwap": mean, "volume": venues[name][1], "trade_count": venues[name][2], "last_trade_ns": venues[name][5]} for name, mean in means]
        return (symbol, secs, start, start + secs * NS, _quotient(spq, sq, TEN), sq, sum(v[2] for v in venues.values()), sqrt(variance) * sqrt(31_536_000 / secs) if variance > 0 else 0.0, max(v[3] for v in venues.values()), min(v[4] for v in venues.values()), last[6], spread, mark, each)


def _marks(venues: dict[str, list]) -> int:
    """Changes with every trade that a window takes."""
    return sum(v[2] for v in venues.values())


class MetricsProcessor(StatefulProcessor):
    """Per-record watermarks and closing, one partition of the log a key.

    Rows of a micro-batch are put in offset order first. State is a row for each open window,
    one for the keys of each smallest window still open, and one for the watermark; a batch writes
    the rows that it changed and deletes those it closed. The engine's checkpoint restores them.
    """

    def __init__(self, sizes=SIZES, lateness_ns: int = LATENESS_NS, idle_ns: int = 0):
        self.sizes, self.lateness, self.idle = tuple(sizes), lateness_ns, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "high long, arrivals long")
        self.open = handle.getMapState("open", "symbol string, secs int, start long", "venues binary")
        self.keys = handle.getMapState("keys", "start long", "keys binary")

    def _load(self) -> WindowState:
        s = WindowState(self.sizes, self.lateness)
        if self.mark.exists():
            s.high, s.arrivals = self.mark.get()
        s.windows = {tuple(k): pickle.loads(v[0]) for k, v in self.open.iterator()}
        s.seen = {k[0]: pickle.loads(v[0]) for k, v in self.keys.iterator()}
        self.before = {**{k: _marks(v) for k, v in s.windows.items()}, **{k: len(v) for k, v in s.seen.items()}}
        return s

    def _save(self, s: WindowState) -> None:
        if s.high is not None:
            self.mark.update((s.high, s.arrivals))
        for k, venues in s.windows.items():
            if self.before.get(k) != _marks(venues):
                self.open.updateValue(k, (pickle.dumps(venues),))
        for k, keys in s.seen.items():
            if self.before.get(k) != len(keys):
                self.keys.updateValue((k,), (pickle.dumps(keys),))
        for k in self.before:
            if isinstance(k, tuple):
                if k not in s.windows:
                    self.open.removeKey(k)
            elif k not in s.seen:
                self.keys.removeKey((k,))

    def _frame(self, key, rows) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values("kafka_offset")
        for r in batch.itertuples(index=False):
            if s.add(r.exchange, r.symbol, r.trade_id, int(r.event_time_ns), r.price, r.size) == "accepted":
                out += s.close()
        self._save(s)
        if self.idle:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle // 1_000_000)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: the watermark moves to the clock less the idle time."""
        s = self._load()
        mark = timerValues.getCurrentProcessingTimeInMs() * 1_000_000 - self.idle
        rows = s.close(mark)
        s.high = max(s.high or 0, mark + self.lateness)
        self._save(s)
        yield from self._frame(key, rows)

    def close(self) -> None:
        pass


def stream_metrics(trades: DataFrame, sizes=SIZES, lateness_ns: int = LATENESS_NS, idle_ns: int = 0) -> DataFrame:
    """Streaming window metrics with the exact plan's results; state is partitioned by the log's partition."""
    mode = "ProcessingTime" if idle_ns else "None"
    return trades.groupBy("kafka_partition").transformWithStateInPandas(MetricsProcessor(sizes, lateness_ns, idle_ns), OUTPUT, "Append", mode)


def upsert_sink(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps the newest row of each key in generations under ``path``.

    A batch writes its own generation, so a repeated batch overwrites the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/generation={batch_id - 1}")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch
        if fs.exists(target):
            rows = upsert_newer(spark.read.schema(batch.schema).parquet(f"{path}/generation={batch_id - 1}"), batch, keys, version)
        rows.write.mode("overwrite").parquet(f"{path}/generation={batch_id}")

    return write


def alert_sink(path: str, deliver: Callable[[list[dict]], list[int]] | None = None, batch_size: int = 10, tries: int = 5) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: alerts are stored once by id; new ones are delivered in small groups, failed ones again.

    ``deliver`` gets a group and returns the positions that failed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = batch.dropDuplicates(["alert_id"])
        if fs.exists(target):
            new = insert_absent(spark.read.parquet(path).where(F.col("batch") != batch_id), batch)
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if deliver is None:
            return
        group: list[dict] = []
        for row in new.toLocalIterator():  # alerts of one micro-batch, streamed
            group.append(row.asDict(recursive=True))
            if len(group) == batch_size:
                _send(deliver, group, tries)
                group = []
        if group:
            _send(deliver, group, tries)

    return write


def _send(deliver, group: list[dict], tries: int) -> None:
    for _ in range(tries):
        failed = deliver(group)
        group = [group[i] for i in failed]
        if not group:
            return
    raise RuntimeError(f"{len(group)} alerts could not be delivered")
