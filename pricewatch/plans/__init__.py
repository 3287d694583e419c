"""Whole jobs composed from the operators: forecasts, backtests, risk, reports."""
