"""Checks of size before data is broadcast or dealt, and scratch tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast, by Spark's own estimate of a plan or, where it knows none, by rows.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 100_000
#: Rows that one task sorts or groups where their number is known before.
PART_ROWS = 1 << 18


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width: int = BROADCAST_BYTES // BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``width`` bytes on average; else Spark shuffles it.

    Both are counted, on at most ``rows`` + 1 rows.
    """
    lengths = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(lengths), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= rows * width else df


def parts(rows: int) -> int:
    """In how many parts so many rows are dealt, which Spark then doesn't merge."""
    return max(1, -(-rows // PART_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a local one only where none is configured and Spark runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` with checkpoint()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
