"""Result shapes: rows, dicts, objects, JSON and CSV text, batches; type coercion. Files: use DataFrame.write."""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TransformationError


def camel(s: str) -> str:
    head, *rest = s.split("_")
    return head + "".join(p.title() for p in rest)


def snake(s: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s).lower()


RENAME = {"camel": camel, "snake": snake, None: lambda s: s}


def _dict(row, rename, nulls, keys):
    d = {rename(k): v for k, v in row.asDict(recursive=True).items() if nulls != "remove" or v is not None}
    return {keys(k): v for k, v in d.items()} if keys else d


def dicts(df: DataFrame, transform: str | None = None, nulls: str = "preserve", keys=None) -> list[dict]:
    return [_dict(r, RENAME[transform], nulls, keys) for r in df.collect()]


def batches(df: DataFrame, size: int = 1000) -> Iterator[list[dict]]:
    """Lists of up to size dicts; one partition at a time reaches the driver."""
    held = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def objects(df: DataFrame, cls, mapping: dict | None = None, defaults: dict | None = None, enforce: tuple = ()) -> Iterator:
    """Instances of cls (a dataclass, say) from rows."""
    names = [(mapping or {}).get(c, c) for c in df.columns]
    if missing := [k for k in enforce if k not in names and k not in (defaults or {})]:
        raise TransformationError(f"columns missing for {cls.__name__}: {missing}")
    for r in df.toLocalIterator():
        yield cls(**{**(defaults or {}), **{k: v for k, v in zip(names, r, strict=True) if v is not None or k not in (defaults or {})}})


def _plain(v, dates, decimals):
    if isinstance(v, decimal.Decimal):
        return str(v) if decimals == "string" else float(v)
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat() if dates == "iso8601" else v.strftime(dates)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return {k: _plain(x, dates, decimals) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x, dates, decimals) for x in v]
    return v


def to_json(df: DataFrame, meta: bool = False, pretty: bool = False, nulls: str = "null", dates: str = "iso8601", decimals: str = "string") -> str:
    """nulls: null, omit or empty_string."""
    data = []
    for d in dicts(df, nulls="remove" if nulls == "omit" else "preserve"):
        data.append({k: "" if v is None and nulls == "empty_string" else _plain(v, dates, decimals) for k, v in d.items()})
    out = {"data": data, "meta": {"columns": df.columns, "types": dict(df.dtypes), "count": len(data)}} if meta else data
    return json.dumps(out, indent=2 if pretty else None, ensure_ascii=False)


def json_lines(df: DataFrame, name: str = "json", ignore_nulls: bool = False) -> DataFrame:
    """A column of JSON text, built on the executors."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(ignore_nulls).lower()}).alias(name))


def to_csv(df: DataFrame, headers: bool = True, delimiter: str = ",", quote: str = '"', null: str = "", force_quotes: bool = False, line_ending: str = "\n") -> str:
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, quotechar=quote, quoting=csv.QUOTE_ALL if force_quotes else csv.QUOTE_MINIMAL, lineterminator=line_ending)
    if headers:
        w.writerow(df.columns)
    for r in df.toLocalIterator():
        w.writerow([null if v is None else _plain(v, "iso8601", "string") for v in r])
    return out.getvalue()


TYPES = {
    "id": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "int2": "bigint", "int4": "bigint", "int8": "bigint",
    "decimal": "decimal(38,18)", "numeric": "decimal(38,18)", "money": "decimal(38,18)", "float": "double", "real": "double", "double": "double", "float4": "double", "float8": "double",
    "string": "string", "text": "string", "varchar": "string", "char": "string", "uuid": "string", "json": "string", "jsonb": "string", "map": "string", "inet": "string", "cidr": "string",
    "boolean": "boolean", "bool": "boolean", "date": "date", "time": "time", "naive_datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "utc_datetime": "timestamp", "timestamptz": "timestamp", "binary": "binary", "bytea": "binary",
}


#: What the text of a value of unknown type may look like, the narrowest first.
LOOKS = [
    ("integer", r"^[+-]?\d{1,18}$"), ("decimal", r"^[+-]?\d*\.\d+$|^[+-]?\d+$"), ("boolean", r"^(?i:true|false|t|f|yes|no)$"), ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("utc_datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
]


def detect(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The logical type that all values of each text column look like (one aggregation over all rows); else string."""
    counts = [F.count_if(F.trim(c).rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, (_, p) in enumerate(LOOKS)]
    got = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)], *counts).first()
    fits = lambda i: [kind for k, (kind, _) in enumerate(LOOKS) if got[f"{i}_{k}"] == got[f"n_{i}"]]
    return {c: (fits(i) or ["string"])[0] if got[f"n_{i}"] else "string" for i, c in enumerate(columns)}


def coerce(df: DataFrame, types: dict, mode: str = "safe", custom=None) -> DataFrame:
    """Columns cast to logical types; "auto" is the type that detect() finds.

    strict: a bad value raises; safe: it becomes null; ignore: as it is; custom: custom(Column) or
    custom(Column, type) makes the column. A callable as a type makes its own column in any mode.
    """
    import inspect

    if mode not in ("strict", "safe", "ignore", "custom") or (mode == "custom") != (custom is not None):
        raise TransformationError(f"bad coercion mode {mode!r}")
    if auto := [c for c, kind in types.items() if kind == "auto"]:
        types = {**types, **detect(df, auto)}
    out = {}
    for c, kind in types.items():
        if callable(kind):
            out[c] = kind(F.col(c))
        elif mode == "custom":
            out[c] = custom(F.col(c), kind) if len(inspect.signature(custom).parameters) > 1 else custom(F.col(c))
        elif mode != "ignore":
            out[c] = cast(df, c, kind, mode)
    return df.withColumns(out)


def cast(df: DataFrame, c: str, kind: str, mode: str):
    target, col = TYPES.get(kind, kind), F.col(c)
    if target == "boolean" and df.schema[c].dataType.simpleString() == "string":
        low = F.lower(F.trim(col))
        good = F.when(low.isin("true", "t", "yes", "y", "1", "on"), True).when(low.isin("false", "f", "no", "n", "0", "off"), False)
        return good if mode == "safe" else good.otherwise(F.when(col.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), col))))
    return col.cast(target) if mode == "strict" else col.try_cast(target)
