"""Spark-native analytics over trade streams: exact window metrics, rules, backtests."""
