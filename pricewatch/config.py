"""Settings of the forecast and risk jobs.

Everything here is small, fixed-size configuration. Jobs turn it into literals
inside the plan (see ``functions.literals``), so it never becomes a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Horizon:
    """One operational forecast: ``days`` steps labelled from ``train_end + 1``."""

    name: str
    days: int
    train_end: date


@dataclass(frozen=True)
class EvalWindow:
    """One backtest: train up to ``train_end``, test on ``[start, end]``."""

    name: str
    train_end: date
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class Weights:
    """Blend weights of the autoregressive and the seasonal forecast."""

    arima: float = 0.5
    seasonal: float = 0.5


# Horizon lengths in days.
SHORT_DAYS = 30
MID_DAYS = 180
LONG_DAYS = 365

# Blend weights per horizon; other horizons use 0.5 / 0.5.
BLEND = {
    "short": Weights(0.8, 0.2),
    "mid": Weights(0.5, 0.5),
    "long": Weights(0.3, 0.7),
}

# Operational cut-offs.
HORIZONS = (
    Horizon("short", SHORT_DAYS, date(2026, 1, 31)),
    Horizon("mid", MID_DAYS, date(2025, 7, 31)),
    Horizon("long", LONG_DAYS, date(2026, 1, 31)),
)

# Backtest windows.
EVAL_WINDOWS = (
    EvalWindow("short", date(2025, 11, 30), date(2025, 12, 1), date(2025, 12, 31)),
    EvalWindow("mid", date(2025, 6, 30), date(2025, 7, 1), date(2025, 12, 31)),
    EvalWindow("long", date(2024, 12, 31), date(2025, 1, 1), date(2025, 12, 31)),
)

# Range drawn on the charts.
CHART_RANGE = (date(2019, 1, 1), date(2025, 12, 31))


@dataclass(frozen=True)
class RiskSettings:
    """Windows of the risk features, in calendar days."""

    average_days: int = 30
    trend_days: int = 7
    vol_recent_days: int = 90
    vol_baseline_days: int = 365


@dataclass(frozen=True)
class Settings:
    horizons: tuple[Horizon, ...] = HORIZONS
    eval_windows: tuple[EvalWindow, ...] = EVAL_WINDOWS
    blend: dict[str, Weights] = field(default_factory=lambda: dict(BLEND))
    chart_range: tuple[date, date] = CHART_RANGE
    risk: RiskSettings = RiskSettings()
    interpolation_limit: int = 30
    fit_ttl_hours: int = 24

    def weights(self, horizon: str) -> Weights:
        return self.blend.get(horizon, Weights())


DEFAULT = Settings()
