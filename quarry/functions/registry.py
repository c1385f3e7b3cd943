"""Functions by name: each takes Columns and gives a Column. PostgreSQL semantics where Spark's differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError
from . import arrays, jsonops

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")

#: PostgreSQL to_char patterns and Java's, longest first.
CHAR_PATTERNS = [
    ("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("Month", "MMMM"), ("MONTH", "MMMM"), ("Mon", "MMM"), ("MON", "MMM"), ("Day", "EEEE"), ("Dy", "EEE"),
    ("DDD", "DDD"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"), ("Q", "q"),
]


def java_pattern(pg: str) -> str:
    out, i = "", 0
    while i < len(pg):
        for a, b in CHAR_PATTERNS:
            if pg.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out, i = out + (f"'{pg[i]}'" if pg[i].isalpha() else pg[i]), i + 1
    return out


def to_char(c: Column, fmt: str) -> Column:
    return F.to_char(c, F.lit(fmt)) if set(fmt) <= set("09.,$SDG-MI") and "9" in fmt or set(fmt) <= set("0.,") else F.date_format(c, java_pattern(fmt))


def date_part(part: str, c: Column) -> Column:
    p = part.lower()
    special = {
        "dow": lambda: F.dayofweek(c) - 1,
        "isodow": lambda: F.weekday(c) + 1,
        "epoch": lambda: F.unix_micros(c.cast("timestamp")) / 1e6,
        "doy": lambda: F.dayofyear(c),
        "century": lambda: F.ceil(F.year(c) / 100),
        "decade": lambda: F.floor(F.year(c) / 10),
        "isoyear": lambda: F.extract(F.lit("yearofweek"), c),
    }
    return special[p]() if p in special else F.date_part(F.lit(p), c)


def interval(n, unit: str | None = None) -> Column:
    if unit is None:
        n, unit = str(n).split(None, 1)
    unit = unit.strip().lower().rstrip("s")
    if unit not in ("year", "month", "week", "day", "hour", "minute", "second") or not re.fullmatch(r"-?\d+", str(n)):
        raise ValidationError(f"bad interval {n} {unit}")
    return F.expr(f"INTERVAL '{int(n)}' {unit.upper()}" if unit != "week" else f"INTERVAL '{7 * int(n)}' DAY")


def age(a: Column, b: Column | None = None) -> Column:
    """Symbolic difference a - b (today - a if alone) as a struct of years, months and days."""
    if b is None:
        a, b = F.current_date(), a
    m = F.months_between(F.to_date(a), F.to_date(b), False)
    whole = F.when(m < 0, F.ceil(m)).otherwise(F.floor(m)).cast("int")
    day = F.datediff(F.to_date(a), F.add_months(F.to_date(b), whole))
    return F.struct((whole / 12).cast("int").alias("years"), (whole % 12).cast("int").alias("months"), day.cast("int").alias("days"))



#: Positions of arguments that are plain values, not fields.
VALUES_AT = {
    "date_trunc": {0}, "date_part": {0}, "extract": {1}, "position": {0}, "replace": {1, 2}, "split_part": {1, 2}, "array_to_string": {1, 2}, "string_to_array": {1, 2}, "to_char": {1}, "interval": {0, 1},
    "substr": {1, 2}, "substring": {1, 2}, "round": {1}, "string_agg": {1}, "ntile": {0}, "array_contains": {1}, "array_contained": {1}, "array_overlap": {1}, "array_eq": {1}, "array_append": {1},
    "array_prepend": {0}, "array_position": {1}, "array_positions": {1}, "array_remove": {1}, "array_replace": {1, 2}, "array_fill": {0, 1}, "array_length": {1}, "lpad": {1, 2}, "rpad": {1, 2},
    "json_extract": {1}, "json_extract_text": {1}, "json_extract_path": {1}, "json_extract_path_text": {1}, "json_set": {1, 2}, "jsonb_set": {1, 2}, "json_insert": {1, 2}, "jsonb_insert": {1, 2},
    "json_remove": {1}, "jsonb_delete": {1}, "jsonb_delete_path": {1}, "json_contains": {1}, "json_contained": {1}, "json_exists": {1}, "json_path_exists": {1}, "left": {1}, "right": {1},
    "jsonb_extract_path": {1}, "jsonb_extract_path_text": {1}, "json_get": {1},
}

SCALARS = {
    "substr": lambda c, s, n=None: F.substr(c, F.lit(s), *([F.lit(n)] if n is not None else [])),
    "trim": lambda c: F.trim(c), "ltrim": lambda c: F.ltrim(c), "rtrim": lambda c: F.rtrim(c), "upper": F.upper, "lower": F.lower, "length": F.length, "initcap": F.initcap, "reverse": F.reverse,
    "position": lambda sub, c: F.position(F.lit(sub), c),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "split_part": lambda c, d, n: F.split_part(c, F.lit(d), F.lit(n)),
    "left": lambda c, n: F.left(c, F.lit(n)), "right": lambda c, n: F.right(c, F.lit(n)),
    "concat": lambda *c: F.concat_ws("", *c), "coalesce": lambda *c: F.coalesce(*c), "greatest": lambda *c: F.greatest(*c), "least": lambda *c: F.least(*c), "nullif": lambda a, b: F.nullif(a, b),
    "abs": F.abs, "sqrt": F.sqrt, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "round": lambda c, p=0: F.round(c, p), "power": F.pow, "mod": lambda a, b: a % b,
    "exp": F.exp, "ln": F.ln, "sign": F.sign, "random": lambda: F.rand(),
    "now": lambda: F.current_timestamp(), "current_date": lambda: F.current_date(), "date_trunc": lambda p, c: F.date_trunc(p, c), "date_part": date_part, "extract": lambda c, p: date_part(p, c), "interval": interval, "age": age, "to_char": to_char,
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b),
    "row": lambda *c: F.struct(*c),
    "array_length": arrays.length, "cardinality": F.size, "array_to_string": arrays.to_string, "string_to_array": arrays.from_string, "array_cat": lambda a, b: F.concat(a, b),
    "array_contains": arrays.contains, "array_contained": arrays.contained, "array_overlap": arrays.overlap, "array_eq": lambda c, v: c == arrays.literal(v), "array": lambda *c: F.array(*c),
    "array_append": lambda c, v: F.array_append(c, F.lit(v)), "array_prepend": lambda v, c: F.array_prepend(c, F.lit(v)), "array_position": arrays.position, "array_positions": arrays.positions,
    "array_remove": lambda c, v: F.array_remove(c, v), "array_replace": arrays.replace, "array_union": F.array_union, "array_intersect": F.array_intersect, "array_except": F.array_except,
    "array_fill": arrays.fill, "array_ndims": arrays.ndims, "array_dims": arrays.dims, "unnest": F.explode,
    "json_extract": jsonops.extract, "json_extract_text": jsonops.extract_text, "json_get": jsonops.extract, "json_extract_path": jsonops.extract, "json_extract_path_text": jsonops.extract_text, "jsonb_extract_path": jsonops.extract, "jsonb_extract_path_text": jsonops.extract_text,
    "json_typeof": jsonops.typeof, "jsonb_typeof": jsonops.typeof, "json_array_length": F.json_array_length, "jsonb_array_length": F.json_array_length,
    "json_build_object": jsonops.build_object, "jsonb_build_object": jsonops.build_object, "json_build_array": jsonops.build_array, "jsonb_build_array": jsonops.build_array,
    "json_set": jsonops.set_path, "jsonb_set": jsonops.set_path, "json_insert": jsonops.insert_path, "jsonb_insert": jsonops.insert_path, "json_remove": jsonops.remove_path, "jsonb_delete": jsonops.remove_path, "jsonb_delete_path": jsonops.remove_path,
    "json_contains": jsonops.contains, "json_contained": jsonops.contained, "json_exists": jsonops.exists, "json_path_exists": jsonops.path_exists,
}
SCALARS |= {"substring": SCALARS["substr"], "pow": F.pow, "ceiling": SCALARS["ceil"]}

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "variance": F.variance, "count_distinct": F.count_distinct, "bool_and": F.bool_and, "bool_or": F.bool_or,
    "array_agg": arrays.agg, "array_agg_distinct": lambda c: F.array_sort(F.collect_set(c)), "string_agg": arrays.string_agg, "json_agg": jsonops.agg, "jsonb_agg": jsonops.agg,
    "json_object_agg": jsonops.object_agg, "jsonb_object_agg": lambda k, v: jsonops.object_agg(k, v, last=True), "approx_count_distinct": F.approx_count_distinct, "median": F.median, "percentile": lambda c, p: F.percentile(c, p),
    "first": F.first, "last": F.last, "corr": F.corr,
}

#: Aggregates with a condition that a NULL in place of a value would not leave out.
FILTERED = {
    "array_agg": lambda keep, c, order=None: arrays.agg(c, order, keep), "json_agg": lambda keep, c, order=None: jsonops.agg(c, order, keep), "jsonb_agg": lambda keep, c, order=None: jsonops.agg(c, order, keep),
    "json_object_agg": lambda keep, k, v: jsonops.object_agg(k, v, keep), "jsonb_object_agg": lambda keep, k, v: jsonops.object_agg(k, v, keep, last=True),
    "first": lambda keep, c: F.first(F.when(keep, F.struct(c.alias("v"))), ignorenulls=True)["v"], "last": lambda keep, c: F.last(F.when(keep, F.struct(c.alias("v"))), ignorenulls=True)["v"],
}


def call(name: str, args: list) -> Column:
    """A scalar by name; names that aren't registered go to Spark's own and registered functions."""
    key = name.lower()
    if key in SCALARS:
        return SCALARS[key](*args)
    if not NAME.match(name):
        raise ValidationError(f"bad function name {name!r}")
    return F.call_function(name, *args)
