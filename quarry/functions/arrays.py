"""Array functions with PostgreSQL's treatment of NULL and empty arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v


def contains(c: Column, v) -> Column:
    return F.size(F.array_except(literal(v), c)) == 0


def contained(c: Column, v) -> Column:
    return F.size(F.array_except(c, literal(v))) == 0


def overlap(c: Column, v) -> Column:
    return F.coalesce(F.arrays_overlap(c, literal(v)), F.when(c.isNotNull(), F.lit(False)))


def length(c: Column, dim: int = 1) -> Column:
    """NULL for an empty array, as in PostgreSQL."""
    for _ in range(dim - 1):
        c = F.get(c, F.lit(0))
    return F.nullif(F.size(c), F.lit(0))


def ndims(c: Column) -> Column:
    return F.size(F.split(F.typeof(c), "array<")) - 1


def dims(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit("[1:"), F.size(c).cast("string"), F.lit("]")))


def position(c: Column, v) -> Column:
    return F.nullif(F.array_position(c, v), F.lit(0).cast("bigint"))


def positions(c: Column, v) -> Column:
    hits = F.transform(c, lambda x, i: F.when(x.eqNullSafe(F.lit(v)), i + 1))
    return F.filter(hits, lambda i: i.isNotNull())


def replace(c: Column, old, new) -> Column:
    return F.transform(c, lambda x: F.when(x.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(x))


def fill(v, dims) -> Column:
    out = F.lit(v)
    for n in reversed(dims if isinstance(dims, (list, tuple)) else [dims]):
        out = F.array_repeat(out, F.lit(n))
    return out


def to_string(c: Column, d: str, null: str | None = None) -> Column:
    return F.array_join(c, d) if null is None else F.array_join(c, d, null)


def from_string(c: Column, d: str, null: str | None = None) -> Column:
    """The delimiter is text, not a pattern."""
    out = F.split(c, re.sub(r"([^\w\s])", r"\\\1", d), -1)
    return out if null is None else F.transform(out, lambda x: F.nullif(x, F.lit(null)))


def agg(c: Column, order: Column | None = None, keep: Column | None = None) -> Column:
    """array_agg that keeps NULLs; sorted by order, or by value (NULLs first) for a stable result.

    No rows make an empty array. keep: the rows that count; if there are none, NULL.
    """
    item = F.struct((c if order is None else order).alias("k"), c.alias("v"))
    item = item if keep is None else F.when(keep, item)
    rows = F.array_sort(F.collect_list(item))
    out = F.transform(rows, lambda x: x["v"])
    return out if keep is None else F.when(F.size(rows) > 0, out)


def string_agg(c: Column, d: str = ",", order: Column | None = None) -> Column:
    """Joined values without NULLs, sorted by order, or by value; NULL if there are none."""
    item = F.when(c.isNotNull(), F.struct((c if order is None else order).alias("k"), c.cast("string").alias("v")))
    kept = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])
    return F.when(F.size(kept) > 0, F.array_join(kept, d))
