"""Settings of the registered queries: the windows moved onto the calendar of the tables."""

from __future__ import annotations

from datetime import date

from pricewatch.config import EvalWindow, Horizon, Settings

SETTINGS = Settings(
    horizons=(
        Horizon("short", 30, date(2001, 7, 31)),
        Horizon("mid", 180, date(2001, 1, 31)),
        Horizon("long", 365, date(2001, 7, 31)),
    ),
    eval_windows=(
        EvalWindow("short", date(2000, 11, 30), date(2000, 12, 1), date(2000, 12, 31)),
        EvalWindow("mid", date(2000, 6, 30), date(2000, 7, 1), date(2000, 12, 31)),
        EvalWindow("long", date(1999, 12, 31), date(2000, 1, 1), date(2000, 12, 31)),
    ),
    chart_range=(date(1995, 1, 1), date(2000, 12, 31)),
)
