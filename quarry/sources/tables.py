"""Table resolution, inline VALUES, table functions and option lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, ValidationError

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")


class Tables:
    """Finds a table by name: in a mapping of DataFrames, a folder of Parquet files, or the catalog."""

    def __init__(self, spark: SparkSession, where: str | Mapping[str, DataFrame] | Callable[[str], DataFrame] | None = None):
        self.spark, self.where = spark, where
        self.read: dict[str, DataFrame] = {}  # files whose schema is known

    def __call__(self, name: str) -> DataFrame:
        if isinstance(self.where, str):
            if name not in self.read:
                self.read[name] = self.spark.read.parquet(f"{self.where}/{name}.parquet")
            return self.read[name]
        if isinstance(self.where, Mapping):
            if name not in self.where:
                raise ConfigurationError(f"no table {name!r}")
            return self.where[name]
        return self.where(name) if self.where else self.spark.table(name)


def values(spark: SparkSession, rows: list, columns: list[str] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """An inline table from lists or dicts. Names come from the keys (sorted) or are column1, column2, ..."""
    if not rows:
        if schema is None:
            raise ValidationError("VALUES without rows needs a schema")
        return spark.createDataFrame([], schema)
    if isinstance(rows[0], Mapping):
        names = columns or sorted({k for r in rows for k in r})
        rows = [[r.get(c) for c in names] for r in rows]
    else:
        names = columns or [f"column{i + 1}" for i in range(len(rows[0]))]
    if any(len(r) != len(names) for r in rows):
        raise ValidationError("all rows of VALUES must have one value for each column")
    for n in names:
        if not IDENTIFIER.match(n):
            raise ValidationError(f"bad column name {n!r}")
    if schema is None:
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        fields = []
        for i, n in enumerate(names):
            have = {type(r[i]) for r in rows if r[i] is not None}
            if have == {int, float}:
                have, rows = {float}, [[float(v) if j == i and v is not None else v for j, v in enumerate(r)] for r in rows]
            if len(have) > 1:
                raise ValidationError(f"column {n} of VALUES mixes types")
            kind = kinds.get(next(iter(have), str))
            if kind is None:
                return spark.createDataFrame([tuple(r) for r in rows], names)
            fields.append(T.StructField(n, kind))
        schema = T.StructType(fields)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "n") -> DataFrame:
    """generate_series, both ends included."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).toDF(name)


def options(provider: dict, tables: Tables, search: str | None = None, limit: int | None = 100) -> DataFrame:
    """(value, label) pairs of a static, enum, table or query provider."""
    kind = provider.get("type")
    if kind in ("static", "enum"):
        pairs = provider["values"]
        pairs = list(pairs.items()) if isinstance(pairs, Mapping) else [p if isinstance(p, (tuple, list)) else (p, p) for p in pairs]
        df = values(tables.spark, [[str(v), str(x)] for v, x in pairs], ["value", "label"], "value string, label string")
    elif kind == "domain":
        df = tables(provider["table"]).select(F.col(provider["value_field"]).alias("value"), F.col(provider.get("display_field", provider["value_field"])).alias("label")).distinct()
    elif kind == "query":
        df = tables.spark.sql(provider["sql"], args=provider.get("args") or {})
        df = df.toDF("value", "label") if len(df.columns) == 2 else df.toDF("value").withColumn("label", F.col("value"))
    else:
        raise ValidationError(f"unknown option provider {kind!r}")
    if search:
        df = df.where(F.col("label").contains(search))
    return df if limit is None else df.orderBy("label", "value").limit(limit)
