"""Checkpoints in the folder that all machines share."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame

CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
ALONE = threading.Lock()


def checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(root)
    return df.checkpoint()


def bare_checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint that Spark knows no constraints of. A plain one keeps those of its plan, and from each
    step of a recursion to the next they multiply until the driver's memory is full."""
    conf = df.sparkSession.conf
    with ALONE:
        before = conf.get(CONSTRAINTS)
        conf.set(CONSTRAINTS, "false")
        try:
            return checkpoint(df.select("*"))
        finally:
            conf.set(CONSTRAINTS, before)
