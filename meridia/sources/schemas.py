"""Schemas of the trade model; nothing is inferred."""

TRADES = "exchange string, symbol string, trade_id string, event_time_ns long, recv_time_ns long, price decimal(18,8), size decimal(18,8), side string, kafka_partition int, kafka_offset long"
ARCHIVE = "exchange string, symbol string, trade_id string, event_time_ns long, recv_time_ns long, price string, size string, side string, kafka_offset long, date string, hour string"
FRAMES = "topic string, partition int, offset long, key string, value string, exchange string, recv_time_ns long"
METRICS = (
    "symbol string, window_secs int, window_start_ns long, window_end_ns long, vwap decimal(28,10), volume decimal(28,8), trade_count long, realised_vol double, "
    "high decimal(18,8), low decimal(18,8), last_price decimal(18,8), xex_spread_bps double, emitted_at_ns long, "
    "exchanges array<struct<exchange:string,vwap:decimal(28,10),volume:decimal(28,8),trade_count:long,last_trade_ns:long>>"
)
ALERTS = "alert_id string, rule_name string, symbol string, severity string, window_end_ns long, message string, values map<string,double>, exchange string"
FEED_HEALTH = "exchange string, symbol string, last_trade_ns long, reconnects long, status string, reported_at_ns long"
DEAD_LETTERS = "source_topic string, source_partition int, source_offset long, error string, reason string, payload binary, failed_at_ns long, service string"
