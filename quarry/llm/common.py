"""What the operators share: the workspace for intermediate tables and small column helpers.

Row identity. ``doc_id`` may be null or repeat. A null id sorts after every other id (``ord``), and
rows of one id are documents of their own: none of them is smaller than the others. ``keyed_ordinal``
deals null ids out by their texts, so that no group of rows holds all of them; such numbers are from
NULLS on, which no id may reach, and are compared as if all were NULLS.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = 2**63 - 1
NULLS = LAST - 2**32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ordinal(col: str = "doc_id") -> Column:
    """The id to compare by; a null id sorts last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST))


def keyed_ordinal(col: str = "doc_id", text: str = "text") -> Column:
    """The id to group by; see above."""
    own = F.lit(LAST) - F.xxhash64(text_of(text)).bitwiseAND(F.lit(2**32 - 1))
    return F.coalesce(F.col(col).cast("long"), own)


def rank_of(col: str) -> Column:
    """A keyed ordinal as it compares."""
    return F.least(F.col(col), F.lit(NULLS))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


class Workspace:
    """Intermediate tables of one job, written as Parquet to the folder that all machines share.

    A written table cuts the lineage, so that a lost executor costs the running stage only, and lets
    Spark delete the shuffle files of the stages before it. The folder is spark.checkpoint.dir; only a
    local session without that setting gets a temporary folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        self.root = f"{root.rstrip('/')}/quarry/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{self.n:03d}-{label}"
        self.n += 1
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quarry_path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def total_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def text_buffer(array: pa.Array) -> tuple[memoryview | bytes, list[int]]:
    """The UTF-8 bytes of a string column without nulls, end to end, and len + 1 offsets into them."""
    import numpy as np

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    offs = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offs, limit: int):
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offs[hi + 1] - offs[lo] <= limit:
            hi += 1
        yield lo, hi
        lo = hi


def sizes(array: pa.Array):
    """Offsets of a column of strings (by bytes) or lists (by elements), for row_groups."""
    import numpy as np
    import pyarrow.compute as pc

    n = pc.binary_length(array) if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else pc.list_value_length(array)
    return np.append(0, np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))


def append(df: DataFrame, fn, fields, by: str | None = None, limit: int = 0) -> DataFrame:
    """df with the columns that fn(record batch) returns as a list of Arrow arrays.

    With ``by``, batches are cut into groups of rows of about ``limit`` bytes (or elements) of that column.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def run(batches):
        for b in batches:
            cuts = [(0, b.num_rows)] if by is None else row_groups(sizes(column(b, by)), limit)
            for lo, hi in cuts:
                part = b.slice(lo, hi - lo)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, *fn(part)], names=names)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))
