"""Window functions with PostgreSQL's null order and default frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "variance": F.variance}
DIRECTIONS = {
    "asc": Column.asc_nulls_last, "desc": Column.desc_nulls_first, "asc_nulls_first": Column.asc_nulls_first, "asc_nulls_last": Column.asc_nulls_last, "desc_nulls_first": Column.desc_nulls_first, "desc_nulls_last": Column.desc_nulls_last,
}
MICROS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def bound(b, sign: int) -> int:
    if b in ("unbounded_preceding", "unbounded_following"):
        return Window.unboundedPreceding if b == "unbounded_preceding" else Window.unboundedFollowing
    if b == "current_row":
        return 0
    if isinstance(b, tuple) and len(b) == 2:
        way, n = b
        if way == "interval":
            m = re.fullmatch(r"(\d+)\s+(\w+?)s?", n.strip())
            if m and m[2].lower() in MICROS:
                return sign * int(m[1]) * MICROS[m[2].lower()]
        elif way in ("preceding", "following") and isinstance(n, int) and n > 0:
            return -n if way == "preceding" else n
    raise ValidationError(f"bad window boundary {b!r}")


def window(name: str, args: list, sel, partition=(), order=(), frame=None) -> Column:
    """A window function. sel turns a selector into a Column; order: f or (f, direction) or (direction, f)."""
    w = Window.partitionBy(*[sel(p) for p in partition])
    keys = []
    for o in order:
        f, d = (o, "asc") if not isinstance(o, tuple) or o[0] not in DIRECTIONS and o[-1] not in DIRECTIONS else (o[0], o[1]) if o[1] in DIRECTIONS else (o[1], o[0])
        keys.append((sel(f), d))
    ranged = frame and frame[0] == "range" and any(isinstance(b, tuple) for b in frame[1:])
    if ranged and len(keys) != 1:
        raise ValidationError("a RANGE frame with a distance needs one ordering")
    if ranged and any(isinstance(b, tuple) and b[0] == "interval" for b in frame[1:]):
        # timestamps by seconds, so that the frame is a range of numbers
        keys = [((F.unix_micros(keys[0][0].cast("timestamp")) / 1e6), keys[0][1])]
    if keys:
        w = w.orderBy(*[DIRECTIONS[d](c) for c, d in keys])
    if frame:
        kind, a, b = frame
        if kind not in ("rows", "range"):
            raise ValidationError(f"a frame is rows or range, not {kind!r}")
        lo, hi = bound(a, -1), bound(b, 1)
        w = w.rowsBetween(lo, hi) if kind == "rows" else w.rangeBetween(lo, hi)
    if name in RANKS:
        return RANKS[name]().over(w)
    if name == "ntile":
        return F.ntile(args[0] if args else 4).over(w)
    if name in ("lag", "lead"):
        return getattr(F, name)(sel(args[0]), *args[1:]).over(w)
    if name in ("first_value", "last_value"):
        return (F.first if name == "first_value" else F.last)(sel(args[0])).over(w)
    if name == "nth_value":
        return F.nth_value(sel(args[0]), args[1]).over(w)
    if name == "count":
        return F.count(F.lit(1) if not args or args[0] == "*" else sel(args[0])).over(w)
    if name in AGGREGATES:
        return AGGREGATES[name](sel(args[0])).over(w)
    raise ValidationError(f"unknown window function {name!r}")
