import json

import pytest
from pyspark.sql import functions as F

from meridia.functions import display as X, dsl
from meridia.operators import backtest as B, monitor as M, normalise as N, serve as V, windows as W
from meridia.plans import runs
from meridia.sources import archive as A, tables as T
from meridia.sources import staging
from meridia.sources.settings import Settings
from meridia.streaming import landing as L

NS = 1_000_000_000
T0 = 1_791_118_800 * NS


def test_archive_written_again_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    trades = T.generate_trades(spark, minutes=2, per_second=5, start_ns=T0 + 3540 * NS)
    first, second = trades.where("kafka_offset < 300"), trades.where("kafka_offset >= 300")
    for batch in (first, second, first):
        A.write_archive(batch, path, files_per_hour=2)
    got = A.read_archive(spark, path)
    assert got.count() == 600 and got.select("exchange", "trade_id").distinct().count() == 600 and "part" not in got.columns


def test_archive_keys(spark):
    key = spark.range(1).select(A.archive_key(F.lit("kraken"), F.lit("BTC-USD"), F.lit(T0), F.lit(7), F.lit(12)).alias("k"))
    assert key.select(A.parse_archive_key(F.col("k")).alias("p")).select("p.*").first()[:] == ("kraken", "BTC-USD", "2026-10-04", "13", 7, 12)
    bad = ["", "trades/x", key.first()[0].replace("hour=13", "hour=24"), key.first()[0].replace("2026-10-04", "2026-13-04"), key.first()[0][:-1]]
    df = spark.createDataFrame([(b,) for b in bad], "k string").select(A.parse_archive_key(F.col("k")).alias("p"))
    assert all(r.p is None for r in df.collect())


def test_landed_frames_to_archive(spark, tmp_path):
    """Recorded messages are streamed, normalised and archived; a second run goes on where the first ended."""
    land, out = str(tmp_path / "land"), str(tmp_path / "archive")
    message = lambda i: json.dumps({"type": "match", "trade_id": i, "side": "sell", "size": "0.5", "price": "100.1", "product_id": "BTC-USD", "time": "2026-10-04T13:00:00.5Z"})
    at = T0 + NS
    counters = L.Counters()
    spark.streams.addListener(counters)
    try:
        for part in (range(0, 5), range(5, 9)):
            recorder = L.Recorder(land, most=2)
            for i in part:
                recorder.add(message(i), at)
            recorder.add("{broken", at)
            recorder.close()
            frames = L.landed_frames(spark, land, "coinbase")
            good, _ = N.normalise(frames, dedup=False)
            seen = L.counted(good, "trades", buys=F.col("side") == "buy")
            seen.writeStream.foreachBatch(L.archive_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        rows = A.read_archive(spark, out).orderBy("kafka_offset").collect()
        for _ in range(50):  # progress is reported a little later
            if counters.totals["trades.rows"] == 9:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert [(r.trade_id, r.kafka_offset) for r in rows] == [(str(i), i + (i > 4)) for i in range(9)]
    assert counters.totals == {"trades.rows": 9, "trades.buys": 9}


def test_frame_symbols(spark):
    df = spark.createDataFrame([('{"product_id": "BTC-USD"}',), ('{"data": [{"symbol": "ETH/USD"}]}',), ('{"channel": "status"}',), ("no json",)], "v string")
    assert [r[0] for r in df.select(L.frame_symbol(F.col("v"))).collect()] == ["BTC-USD", "ETH-USD", None, None]


def test_keyed_rows(spark):
    row = L.keyed(spark.createDataFrame([("BTC-USD", 1, 5)], "symbol string, n int, at long"), headers=("at",)).first()
    assert row.key == "BTC-USD" and json.loads(row.value) == {"symbol": "BTC-USD", "n": 1, "at": 5} and [(h.key, bytes(h.value)) for h in row.headers] == [("at", b"5")]


def test_clients():
    c = L.Client(["X-USD"], most_others=2, most_alerts=2)
    for i in range(3):
        c.offer("metrics", "X-USD", f"m{i}")
        c.offer("metrics", "Y-USD", "not asked for")
    c.offer("alert", "X-USD", "a")
    assert c.take() == ["a", "m1", "m2"] and c.dropped == 1 and c.take() == []
    for _ in range(3):
        c.offer("alert", "X-USD", "a")
    assert c.gone and L.Client().symbols == frozenset()


def test_requests():
    assert V.checked("X-USD", ["X-USD"]) == ("X-USD", 10) and V.checked("X-USD", ["X-USD"], "60") == ("X-USD", 60)
    for window in ("7", "x"):
        with pytest.raises(V.BadRequest):
            V.checked("X-USD", ["X-USD"], window)
    with pytest.raises(V.NotFound):
        V.checked("Z-USD", ["X-USD"])


def test_settings():
    s = Settings.load({"SYMBOLS": "A-B, C-D", "TOPIC_TRADES": "t", "KAFKA_BROKERS": ""})
    assert s.symbols == ("A-B", "C-D") and s.topic_trades == "t" and s.brokers == ("localhost:9092",)
    assert s.for_run("r1").topic_trades == "replay.r1.t" and s.for_run("r1").symbols == s.symbols
    for bad in ({"SYMBOLS": "btc"}, {"LOG_LEVEL": "loud"}, {"OTEL_TRACE_SAMPLE_RATIO": "2"}, {"SYMBOLS": ","}):
        with pytest.raises(ValueError):
            Settings.load(bad)


def test_display(spark):
    r = spark.range(1).select(
        X.price(F.lit("65000.5")), X.price(F.lit("2.5")), X.price(F.lit("0.12")), X.price(F.lit("")), X.number(F.lit(None).cast("double")), X.percent(F.lit(0.1234)),
        X.clock(F.lit(T0 + 61 * NS)), X.age(F.lit(T0), F.lit(T0 + 59 * NS)), X.age(F.lit(T0), F.lit(T0 + 3599 * NS)), X.age(F.lit(T0), F.lit(T0 + 7300 * NS)), X.age(F.lit(0), F.lit(T0)),
        F.array_join(M.sorted_keys(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), ","),
    ).first()
    assert r[:] == ("65,000.50", "2.500", "0.120000", "–", "–", "12.3%", "13:01:01", "59s ago", "59m ago", "2h ago", "never", "a,b")


def test_clocks(spark):
    m = spark.createDataFrame([(1,)], "emitted_at_ns long")
    assert W.with_clock(m).first()[0] == 1 and W.with_clock(m, "wall").first()[0] > T0 // 2
    with pytest.raises(ValueError):
        W.with_clock(m, "moon")


RULES = """
rules:
  - {name: jump, window_secs: 10, condition: "abs(zscore(last_price, lookback=5)) > 1.5", severity: WARN, cooldown_secs: 20}
"""


def test_run_and_report(spark, tmp_path):
    """Two runs over the same trades, one of them shuffled and with repeated windows, give one report."""
    trades = T.generate_trades(spark, minutes=10, per_second=5).cache()
    rules, start = dsl.load_rules(RULES), 1_791_121_800 * NS
    o = B.Options(start, start + 600 * NS, event_bps=5.0, hold_ns=20 * NS, horizon_ns=20 * NS)
    run = runs.run_pipeline(trades, rules)
    rep = runs.report(run, rules, o, "first")
    m = run.metrics
    again = runs.run_from_metrics(m.withColumn("arrival", F.lit(1)).unionByName(m.withColumn("high", F.col("high") + 1).withColumn("arrival", F.lit(2))), rules, "arrival")
    assert again.counts() == {**run.counts(), "trades": 0}
    assert runs.metrics_fingerprint(again.metrics).first()[0] == rep["data"]["metrics_sha256"]
    assert runs.input_fingerprint(trades.repartition(3)).first()[0] == rep["data"]["input_sha256"] != runs.input_fingerprint(trades.limit(2999)).first()[0]
    assert rep["data"]["trades"] == 3000 and rep["data"]["alerts"] > 0 and len(rep["rules"][0]["folds"]) == 3
    runs.write_report(spark, rep, str(tmp_path))
    runs.write_report(spark, {**rep, "run_id": "second"}, str(tmp_path))
    assert runs.list_runs(spark, str(tmp_path)) == ["first", "second"] and runs.read_report(spark, str(tmp_path), "first") == json.loads(json.dumps(rep))
    assert f"| jump | {rep['rules'][0]['out_of_sample_tuned']['precision']:.2f} |" in (tmp_path / "first" / "report.md").read_text()
    with pytest.raises(V.NotFound):
        runs.read_report(spark, str(tmp_path), "third")
    for bad in ("", "a/b", "..", "a b"):
        with pytest.raises(V.BadRequest):
            runs.check_run_id(bad)


def test_stored_tables_are_data_files_only(spark):
    """Each checksum file or mark of success costs the writing JVM a process; row groups are held whole by who reads them."""
    import os

    import pyarrow.parquet as pq

    df = spark.range(400, numPartitions=1).select("id", F.expr("array_join(transform(sequence(1, 1600), i -> sha2(concat(id, chr(95), i), 256)), chr(95))").alias("text"))
    out = staging.stored(df, "files")
    path = staging._paths[out].removeprefix("file://")
    names = os.listdir(path)
    assert names and all(n.startswith("part-") for n in names)
    assert sum(pq.ParquetFile(f"{path}/{n}").metadata.num_row_groups for n in names) > 1
    assert out.count() == 400 and out.exceptAll(df).isEmpty()
    assert staging.stored(df.limit(0), "files").count() == 0
