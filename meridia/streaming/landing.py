"""Frames that land as files, and the sinks of streams: archive, keyed log, counters, live clients."""

from __future__ import annotations

import os
import time
from collections import Counter, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from meridia.functions.scalars import venue_symbol
from meridia.sources.archive import write_archive


class Recorder:
    """Writes a feed's frames to ``folder`` as <first offset>.jsonl, a message a line, of ``most`` lines at most.

    A file appears under its name when it is full or closed, so that a stream reads whole
    files only. Lines are ``receive time in ns<tab>message``. Offsets go on after the last file.
    """

    def __init__(self, folder: str, most: int = 10_000):
        self.folder, self.most, self.lines = folder, most, []
        os.makedirs(folder, exist_ok=True)
        last = max((f for f in os.listdir(folder) if f.endswith(".jsonl")), default=None)
        self.offset = 0
        if last is not None:
            with open(os.path.join(folder, last), encoding="utf-8") as f:
                self.offset = int(last.partition(".")[0]) + sum(1 for _ in f)

    def add(self, message: str, recv_time_ns: int | None = None) -> None:
        at = time.time_ns() if recv_time_ns is None else recv_time_ns
        self.lines.append(f"{at}\t{' '.join(message.splitlines())}\n")
        if len(self.lines) >= self.most:
            self.close()

    def close(self) -> None:
        if not self.lines:
            return
        name = os.path.join(self.folder, f"{self.offset:020d}.jsonl")
        with open(os.path.join(self.folder, f".{self.offset}.part"), "w", encoding="utf-8") as f:
            f.writelines(self.lines)
        os.rename(f.name, name)
        self.offset += len(self.lines)
        self.lines = []


def frame_symbol(value: Column) -> Column:
    """The symbol that a raw message is keyed by; null for messages of no symbol."""
    return F.coalesce(F.get_json_object(value, "$.product_id"), venue_symbol(F.get_json_object(value, "$.data[0].symbol")))


def landed_frames(spark: SparkSession, path: str, exchange: str, topic: str | None = None, files_a_batch: int = 100) -> DataFrame:
    """A stream of what ``Recorder`` lands, with the columns of a keyed log; offsets are those of the files' names and lines.

    A file is a row until it is split, and has as many lines as its recorder allows.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.jsonl").load(path)
    first = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.jsonl$", 1).try_cast("long").alias("_first")
    lines = files.select(first, F.posexplode(F.split("value", "\n")).alias("_n", "_line")).where("_line <> ''")
    value = F.regexp_extract("_line", r"^\d+\t(.*)$", 1)
    recv = F.regexp_extract("_line", r"^(\d+)\t", 1).try_cast("long")
    return lines.select(
        F.lit(topic or f"raw.trades.{exchange}").alias("topic"), F.lit(0).alias("partition"), (F.col("_first") + F.col("_n")).alias("offset"), frame_symbol(value).alias("key"),
        value.alias("value"), F.lit(exchange).alias("exchange"), F.coalesce(recv, F.lit(0)).alias("recv_time_ns"),
    )


def archive_sink(path: str, files_per_hour: int = 1) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of trades to the archive. A batch that is repeated after a crash overwrites its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # the batch is read for its ranges of offsets and for its rows
        try:
            if not kept.isEmpty():
                write_archive(kept, path, files_per_hour)
        finally:
            kept.unpersist()

    return write


def keyed(rows: DataFrame, key: str = "symbol", headers: tuple[str, ...] = ()) -> DataFrame:
    """(key, value[, headers]) for a log: rows as JSON, keyed so that a symbol's rows keep their order."""
    out = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")]
    if headers:
        out.append(F.array(*[F.struct(F.lit(h).alias("key"), F.col(h).cast("string").cast("binary").alias("value")) for h in headers]).alias("headers"))
    return rows.select(*out)


def publish(rows: DataFrame, options: dict[str, str], topic: str, checkpoint: str | None = None):
    """Rows of ``keyed`` to a Kafka topic, acknowledged by all replicas; a stream needs ``checkpoint``. Needs the connector."""
    settings = {**options, "topic": topic, "kafka.acks": "all", "includeHeaders": "true"}
    if rows.isStreaming:
        return rows.writeStream.format("kafka").options(**settings).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**settings).save()


def counted(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``rows``, observed: their number as ``rows`` and how many meet each condition. Costs no pass of its own."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])


class Counters(StreamingQueryListener):
    """Running totals of what ``counted`` observes in the session's streams, as <name>.<count>."""

    def __init__(self):
        self.totals: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            for k, n in row.asDict().items():
                self.totals[f"{name}.{k}"] += n or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Client:
    """What waits for one client: alerts, which are never dropped, and the newest other messages."""

    def __init__(self, symbols=(), most_others: int = 256, most_alerts: int = 1000):
        self.symbols, self.most_alerts, self.gone, self.dropped = frozenset(symbols), most_alerts, False, 0
        self.alerts: deque = deque()
        self.others: deque = deque(maxlen=most_others)

    def offer(self, kind: str, symbol: str, message: str) -> None:
        """A client too far behind on alerts is cut off rather than left without some."""
        if self.gone or (self.symbols and symbol not in self.symbols):
            return
        if kind != "alert":
            self.dropped += len(self.others) == self.others.maxlen
            self.others.append(message)
        elif len(self.alerts) >= self.most_alerts:
            self.gone = True
        else:
            self.alerts.append(message)

    def take(self) -> list[str]:
        """All that waits, alerts first."""
        out = [*self.alerts, *self.others]
        self.alerts.clear()
        self.others.clear()
        return out


def fan_out_sink(clients: set[Client], kind: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that offers a batch's rows (symbol, value) to live clients, streamed through the driver."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("symbol", "value").toLocalIterator():
            for c in list(clients):
                c.offer(kind, row["symbol"], row["value"])

    return write
