"""Filters from the values that a form sends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ValidationError
from .tables import Tables, options


def form_filter(field: str, given, provider: dict | None = None, tables: Tables | None = None):
    """A predicate for a form's value or values of a field; None if nothing was chosen.

    With a provider (as for options()) each value must be one of its values; only the values given are
    looked up, so its list may be long. One value compares for equality, several are a list.
    """
    chosen = [v for v in (given if isinstance(given, (list, tuple, set)) else [given]) if v not in (None, "")]
    chosen = list(dict.fromkeys(chosen))
    if not chosen:
        return None
    if provider is not None:
        text = [str(v) for v in chosen]
        pairs = options(provider, tables, limit=None)
        known = {r[0] for r in pairs.where(F.col("value").cast("string").isin(text)).select(F.col("value").cast("string")).distinct().collect()}
        if bad := [v for v in text if v not in known]:
            raise ValidationError(f"{field} can't be {bad}", options=sorted(known))
    return (field, chosen[0]) if len(chosen) == 1 else (field, chosen)
