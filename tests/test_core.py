import hashlib
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meridia.functions import dsl, scalars as S
from meridia.operators import backtest as B, normalise as N, rules as R, sequential as Q, serve as V, windows as W
from meridia.sources import archive as A, schemas, tables as T
from meridia.streaming.metrics import WindowState

NS = 1_000_000_000
T0 = 1_791_118_800 * NS


def make_trades(spark, rows):
    """(exchange, symbol, id, ms after T0, price, size) in arrival order."""
    out = [(e, s, i, T0 + ms * 1_000_000, 0, Decimal(p), Decimal(q), "buy", 0, k) for k, (e, s, i, ms, p, q) in enumerate(rows)]
    return spark.createDataFrame(out, schemas.TRADES)


HAND = [("coinbase", "X-USD", "1", 100, "100.00", "1"), ("kraken", "X-USD", "a", 200, "100.20", "2"), ("coinbase", "X-USD", "2", 300, "101.00", "1"), ("kraken", "X-USD", "b", 400, "99.80", "1"), ("coinbase", "X-USD", "3", 1600, "100.50", "1")]


def test_hand_computed_window(spark):
    rows = W.window_metrics(make_trades(spark, HAND), (1, 10)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.window_start_ns, r.window_end_ns, r.trade_count, r.emitted_at_ns) == (T0, T0 + NS, 4, T0 + 1_100_000_000)
    assert (r.vwap, r.volume, r.high, r.low, r.last_price) == (Decimal("100.24"), 5, 101, Decimal("99.8"), Decimal("99.8"))
    assert [(x.exchange, x.vwap) for x in r.exchanges] == [("coinbase", Decimal("100.5")), ("kraken", Decimal("100.0666666667"))]


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["X-USD", "Y-USD"]), st.integers(0, 25), st.integers(0, 30_000), st.integers(1, 500), st.integers(1, 90)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_plan_equals_record_by_record_engine(spark, rows):
    given_rows = [(e, s, f"{s}{i}", ms, f"{p}.37", f"{q}.5") for e, s, i, ms, p, q in rows]
    state, want, outcomes = WindowState((1, 10), 500_000_000), [], []
    for e, s, i, ms, p, q in given_rows:
        outcomes.append(state.add(e, s, i, T0 + ms * 1_000_000, Decimal(p), Decimal(q)))
        want += state.close()
    trades = make_trades(spark, given_rows)
    got = W.window_metrics(trades, (1, 10)).collect()
    assert [r.outcome for r in W.outcomes(trades, (1, 10)).orderBy("kafka_offset").collect()] == outcomes
    key = lambda r: (r[0], r[1], r[2])
    mine = sorted(((r.symbol, r.window_secs, r.window_start_ns, r.vwap, r.volume, r.trade_count, r.high, r.low, r.last_price, r.emitted_at_ns) for r in got), key=key)
    theirs = sorted(((w[0], w[1], w[2], w[4], w[5], w[6], w[8], w[9], w[10], w[12]) for w in want), key=key)
    assert mine == theirs
    vol = {key(w): (w[7], w[11]) for w in want}
    for r in got:
        v, x = vol[r.symbol, r.window_secs, r.window_start_ns]
        assert r.realised_vol == pytest.approx(v, rel=1e-9) and r.xex_spread_bps == pytest.approx(x, abs=1e-6)


def reference_engine(rows, sizes, lateness):
    """(outcomes, {(symbol, secs, start): (count, last price)}) by the plainest bookkeeping."""
    high, seen, open_, closed, outcomes = None, set(), {}, {}, []
    for n, (e, s, i, t, p) in enumerate(rows):
        start = t - t % (sizes[0] * NS)
        if high is not None and start + sizes[0] * NS <= high - lateness:
            outcomes.append("late")
        elif (e, i, start) in seen:
            outcomes.append("duplicate")
        else:
            outcomes.append("accepted")
            seen.add((e, i, start))
            for w in sizes:
                open_.setdefault((s, w, t - t % (w * NS)), []).append((t, n, p))
            high = t if high is None else max(high, t)
            for k in [k for k in open_ if k[2] + k[1] * NS <= high - lateness]:
                closed[k] = (len(open_[k]), max(open_.pop(k))[2])
    return outcomes, closed


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["X-USD", "Y-USD"]), st.integers(0, 6), st.integers(0, 50), st.integers(1, 500)), min_size=1, max_size=60))
def test_record_by_record_engine(rows):
    rows = [(e, s, f"{s}{i}", T0 + 100 * ms * 1_000_000, Decimal(p)) for e, s, i, ms, p in rows]
    state, outcomes, closed = WindowState((1, 10), 500_000_000), [], {}
    for e, s, i, t, p in rows:
        outcomes.append(state.add(e, s, i, t, p, Decimal(1)))
        closed |= {(w[0], w[1], w[2]): (w[6], w[10]) for w in state.close()}
    assert (outcomes, closed) == reference_engine(rows, (1, 10), 500_000_000)
    assert sum(state.counts.values()) == len(rows)


def test_closing_grows_in_proportion(spark):
    """Frames that start at the first row: no plan recomputes a span for each of its rows."""
    trades = T.generate_trades(spark, minutes=5, per_second=200)
    plan = W.window_metrics(trades, flush=True)._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()
    assert W.window_metrics(trades, flush=True, in_order=True).agg(F.sum("trade_count")).first()[0] == 3 * 60_000


def test_products_of_ruinous_returns(spark):
    for returns in ([0.5, -1.5, 0.2], [-2.0, -3.0], [0.1, -1.0, 0.3], [0.25]):
        rows = spark.createDataFrame([("r", i, "s", float(x)) for i, x in enumerate(returns)], "run string, exit_ns long, symbol string, net_return double")
        want = []
        for x in returns:
            want.append((want[-1] if want else 1.0) * (1 + x))
        got = [r.equity for r in B.equity_curve(rows, ["run"]).orderBy("exit_ns").collect()]
        assert got == pytest.approx(want)
        assert B.trade_stats(rows, ["run"], 1).first().total_return == pytest.approx(want[-1] - 1)


@pytest.mark.parametrize("capacity", [1, 3, 100])
def test_bounded_dedup(spark, capacity):
    ids = [1, 2, 1, 3, 4, 1, 5, 2, 2, 6, 7, 8, 1]
    ring, want = [], []
    for n, i in enumerate(ids):
        if i not in ring:
            want.append(n)
            ring = [*ring, i][-capacity:]
    rows = spark.createDataFrame([(0, n, i) for n, i in enumerate(ids)], "part int, off int, id int")
    assert sorted(r.off for r in Q.bounded_fifo_dedup(rows, ["id"], "part", "off", capacity).collect()) == want


def test_exact_vwap(spark):
    pairs = [("10000.005", "3"), ("1", "3"), ("2", "3"), ("0.00000001", "7"), ("123456.78901234", "9.87654321")]
    rows = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "a decimal(38,16), b decimal(28,8)").select("a", "b", S.vwap(F.col("a"), F.col("b")).alias("v")).collect()
    for r in rows:
        assert r.v == (r.a / r.b).quantize(Decimal("1e-10"), ROUND_HALF_UP)


def test_scalar_functions(spark):
    r = spark.range(1).select(
        S.align(F.lit(-1), 10).alias("floor"), S.canonical_decimal(F.lit("1.500")).alias("d1"), S.canonical_decimal(F.lit("1500")).alias("d2"), S.venue_symbol(F.lit("A/B/C")).alias("sym"),
        S.rfc3339_ns(F.lit("2026-09-30T01:34:19.123456789Z")).alias("t"), S.rfc3339_ns(F.lit("yesterday")).alias("none"), S.alert_id(F.lit("r"), F.lit("s"), F.lit(5), F.lit("e")).alias("id"), S.round6(F.lit(0.0000005)).alias("r6"), S.positive_decimal(F.lit("0.000000001")).alias("tiny")
    ).first()
    assert (r.floor, r.d1, r.d2, r.sym, r.none, r.r6, r.tiny) == (-10 * NS, "1.5", "1500", "A-B/C", None, 1e-6, None)
    assert r.t % NS == 123456789 and r.id == hashlib.sha256(b"r\0s\x005\0e").hexdigest()[:32]
    assert [S.key_partition(s) for s in ("BTC-USD", "ETH-USD", "SOL-USD")] == [3, 2, 5]


FRAMES = [
    ("raw.trades.coinbase", '{"type":"match","trade_id":7,"side":"sell","size":"0.50","price":"100.10","product_id":"BTC-USD","time":"2026-09-30T01:34:19.5Z"}'),
    ("raw.trades.coinbase", '{"type":"match","trade_id":7,"side":"sell","size":"0.50","price":"100.10","product_id":"BTC-USD","time":"2026-09-30T01:34:19.5Z"}'),
    ("raw.trades.kraken", '{"channel":"trade","type":"update","data":[{"symbol":"ETH/USD","side":"buy","price":2668.10,"qty":0.00000010,"trade_id":1,"timestamp":"2026-09-30T01:34:19Z"},{"symbol":"ETH/USD","side":"sell","price":2669.1,"qty":5e-05,"trade_id":2,"timestamp":"2026-09-30T01:34:20Z"}]}'),
    ("raw.trades.kraken", '{"channel":"trade","data":[{"symbol":"ETH/'),
    ("raw.trades.coinbase", '{"type":"match","trade_id":8,"side":"sell","size":"0.50","price":"-1","product_id":"BTC-USD","time":"2026-09-30T01:34:19.5Z"}'),
    ("raw.trades.coinbase", '{"type":"match","trade_id":9,"side":"sell","size":"0.50","price":"1","product_id":"DOGE-USD","time":"2026-09-30T01:34:19.5Z"}'),
    ("raw.trades.nowhere", "{}"),
]


def test_normalise(spark):
    f = spark.createDataFrame([(t, 0, i, None, v, "", 0) for i, (t, v) in enumerate(FRAMES)], schemas.FRAMES)
    good, dead = N.normalise(f, ["BTC-USD", "ETH-USD"])
    rows = good.orderBy("kafka_offset", "trade_id").collect()
    assert [(r.symbol, str(r.price.normalize()), r.side) for r in rows] == [("BTC-USD", "100.1", "buy"), ("ETH-USD", "2668.1", "buy"), ("ETH-USD", "2669.1", "sell")]
    assert rows[1].size == Decimal("0.0000001") and rows[2].size == Decimal("0.00005")
    found = {r.source_offset: (r.reason, r.error) for r in dead.collect()}
    assert {k: v[0] for k, v in found.items()} == {3: "parse", 4: "validation", 5: "validation", 6: "unknown_exchange"}
    assert "not configured" in found[5][1] and "price" in found[4][1]


def test_frame_kinds(spark, tmp_path):
    lines = [v for _, v in FRAMES[:3]] + ['{"type":"heartbeat","product_id":"BTC-USD"}', '{"type":"subscriptions"}', '{"type":"error","message":"m"}', "{}"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    kinds = N.classify(A.read_frames(spark, str(tmp_path / "a.jsonl"), "coinbase")).orderBy("offset").collect()
    assert [r.kind for r in kinds] == ["trade", "trade", "unknown", "heartbeat", "control", "error", "unknown"]


@pytest.mark.parametrize("text", ["vwap = 1", "vwap > ", "zscore(vwap, lookback=1) > 2", "zscore(seconds_since_last_trade) > 1", "foo > 1", "abs(vwap > 1", "vwap > 1 2", "zscore(vwap, window=3) > 1", "sqrt(vwap) > 1"])
def test_bad_conditions(text):
    with pytest.raises(dsl.RuleError):
        dsl.parse_condition(text)


def test_rules_document():
    rules = dsl.load_rules(dsl.DEFAULT_RULES)
    assert str(rules["price_jump"].condition) == "abs(zscore(last_price, lookback=30)) > 4"
    assert rules["stale_feed"].per_exchange and not rules["volume_spike"].per_exchange
    assert rules["volume_spike"].with_threshold(2.5).condition.threshold == 2.5
    for bad in ("rules: []", "rules: [{name: a, condition: vwap > 1, severity: LOUD}]", "rules: [{name: a, condition: vwap > 1, severity: INFO, x: 1}]", "oops: 1"):
        with pytest.raises(dsl.RuleError):
            dsl.load_rules(bad)


def greedy(times, cool):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= cool:
            out.append(t)
            last = t
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 200), unique=True, min_size=1, max_size=40))
def test_cooldown_sessions_equal_the_sequence(spark, times):
    df = spark.createDataFrame([("k", t) for t in times], "key string, t long")
    got = [r.t for r in Q.greedy_cooldown(df, ["key"], "t", 12).where("fires").orderBy("t").collect()]
    assert got == greedy(times, 12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 30)), unique_by=lambda x: x[0], min_size=1, max_size=40))
def test_non_overlapping_equals_the_sequence(spark, entries):
    rows = sorted((a, a + d) for a, d in entries)
    busy, want = None, []
    for a, b in rows:
        if busy is None or a > busy:
            want.append(a)
            busy = b
    df = spark.createDataFrame([("k", a, b) for a, b in rows], "key string, a long, b long")
    assert [r.a for r in Q.non_overlapping(df, ["key"], "a", "b").orderBy("a").collect()] == want


def test_archive_round_trip_and_pruning(spark, tmp_path):
    trades = T.generate_trades(spark, minutes=2, per_second=5, start_ns=T0 + 3540 * NS)
    A.write_archive(trades, str(tmp_path / "a"))
    every = A.read_archive(spark, str(tmp_path / "a"))
    assert every.count() == 600
    part = A.read_archive(spark, str(tmp_path / "a"), ["BTC-USD"], T0 + 3600 * NS, T0 + 3630 * NS)
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters")[1][:300]
    assert part.count() == trades.where(f"symbol = 'BTC-USD' AND event_time_ns >= {T0 + 3600 * NS} AND event_time_ns < {T0 + 3630 * NS}").count() > 0
    order = [(r.event_time_ns, r.exchange, r.trade_id) for r in A.replay(every.unionByName(every.limit(50))).collect()]
    assert order == sorted(order) and len(order) == 600
    assert A.to_trades(every).select(F.sum("price")).first()[0] == trades.select(F.sum("price")).first()[0]


def test_serving(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "keep")], "k string, v long, s string")
    b = spark.createDataFrame([("x", 2, "new"), ("x", 1, "late"), ("y", 5, "tie"), ("z", 1, "add")], "k string, v long, s string")
    assert {r.k: r.s for r in V.upsert_newer(a, b, ["k"], "v").collect()} == {"x": "new", "y": "keep", "z": "add"}
    assert V.decode_cursor(V.encode_cursor("BTC-USD", "00#a")) == ("BTC-USD", "00#a")
    with pytest.raises(ValueError):
        V.decode_cursor("???")


def test_stream_equals_batch(spark, tmp_path):
    from meridia.streaming.metrics import stream_metrics

    trades = T.generate_trades(spark, minutes=1, per_second=20).coalesce(1)
    trades.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schemas.TRADES).parquet(str(tmp_path / "in"))
    q = stream_metrics(src, (1, 10)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    row = lambda r: ((r.symbol, r.window_secs, r.window_start_ns), (r.vwap, r.trade_count, r.emitted_at_ns, r.last_price, r.exchanges))
    got = dict(row(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = dict(row(r) for r in W.window_metrics(spark.read.parquet(str(tmp_path / "in")), (1, 10)).collect())
    assert got == want and want


STREAM_RULES = """
expected_exchanges: [coinbase, ghost]
rules:
  - {name: jump, window_secs: 1, condition: "abs(zscore(last_price, lookback=5)) > 1.5", severity: WARN, cooldown_secs: 3}
  - {name: spike, window_secs: 1, condition: "median_ratio(volume, lookback=4) > 1.2", severity: INFO, cooldown_secs: 2}
  - {name: wide, window_secs: 10, condition: "abs(xex_spread_bps) > 1", severity: WARN}
  - {name: silent, window_secs: 1, condition: "seconds_since_last_trade > 2", severity: CRITICAL, cooldown_secs: 10}
"""


def test_stream_rules_equal_batch_across_a_restart(spark, tmp_path):
    """The first run ends after half of the windows; the second goes on from its checkpoint."""
    from meridia.streaming.rules import stream_alerts

    rules = dsl.load_rules(STREAM_RULES)
    metrics = W.window_metrics(T.generate_trades(spark, minutes=1, per_second=10), (1, 10), in_order=True).drop("kafka_partition").orderBy("window_end_ns").collect()
    names = [c.split()[0] for c in schemas.METRICS.partition(", exchanges")[0].split(", ")] + ["exchanges"]
    half = sorted({r.window_end_ns for r in metrics})[30]
    for part, rows in (("a", [r for r in metrics if r.window_end_ns <= half]), ("b", [r for r in metrics if r.window_end_ns > half])):
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.METRICS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schemas.METRICS).parquet(str(tmp_path / "in"))
        q = stream_alerts(src, rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    row = lambda r: (r.alert_id, r.rule_name, r.symbol, r.severity, r.window_end_ns, r.exchange, r.message)
    got = sorted(row(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = R.alerts(spark.read.schema(schemas.METRICS).parquet(str(tmp_path / "in")), rules)
    assert got == sorted(row(r) for r in want.collect()) and {r[1] for r in got} >= {"jump", "silent"}
    assert R.at_least(want, "CRITICAL").select("rule_name").distinct().collect()[0][0] == "silent"
