"""Daily price panels on Spark: regularise, forecast, backtest, score risk, report."""

__version__ = "0.1.0"
