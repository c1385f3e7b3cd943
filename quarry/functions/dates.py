"""Date shortcuts to inclusive ranges."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from ..errors import ValidationError


def date_range(spec, today: dt.date | None = None) -> tuple[dt.datetime, dt.datetime]:
    """today, yesterday, tomorrow, this_week, last_week (from Monday), this_month, last_month, YYYY, YYYY-MM, YYYY-MM-DD, or (start, end)."""
    today = today or dt.date.today()
    day = dt.timedelta(days=1)
    monday = today - today.weekday() * day
    first = today.replace(day=1)
    if isinstance(spec, (tuple, list)):
        a, b = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in spec)
    elif spec in ("today", "yesterday", "tomorrow"):
        a = b = today + {"today": 0, "yesterday": -1, "tomorrow": 1}[spec] * day
    elif spec in ("this_week", "last_week"):
        a = monday - (7 * day if spec == "last_week" else 0 * day)
        b = a + 6 * day
    elif spec in ("this_month", "last_month"):
        a = first if spec == "this_month" else (first - day).replace(day=1)
        b = a.replace(day=calendar.monthrange(a.year, a.month)[1])
    elif re.fullmatch(r"\d{4}", spec):
        a, b = dt.date(int(spec), 1, 1), dt.date(int(spec), 12, 31)
    elif re.fullmatch(r"\d{4}-\d{2}", spec):
        a = dt.date.fromisoformat(spec + "-01")
        b = a.replace(day=calendar.monthrange(a.year, a.month)[1])
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", spec):
        a = b = dt.date.fromisoformat(spec)
    else:
        raise ValidationError(f"unknown date shortcut {spec!r}")
    return dt.datetime.combine(a, dt.time.min), dt.datetime.combine(b, dt.time.max)
