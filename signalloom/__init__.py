"""Equity signal analytics on Spark: clean quotes, point-in-time fundamentals, scores, backtest."""

__version__ = "0.1.0"
