"""Helpers shared by the corpus operators: scratch tables, size checks, ranks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of narrow key columns that may be broadcast (some MB).
BROADCAST_ROWS = 250_000

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows in an Arrow batch to ``rows``: with long texts the usual 10,000 take much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` with checkpoint() in the folder of spark.checkpoint.dir.

    A local folder is used only where no folder is configured and Spark runs in one process (tests).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it isn't yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` materialised, and aggregates of its rows from the same pass; ``n`` is their number."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in metrics.items())))
    return out, seen.get


def cut_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` materialised, with a broadcast hint if it has at most ``rows`` rows."""
    out, seen = observed(df)
    return F.broadcast(out) if seen["n"] <= rows else out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def free(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_bucket(col, n: int):
    """crc32 of the value as text, modulo ``n`` (null: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ordered_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds the 0-based position in the global order without sorting in one task.

    Rows are dealt by range; each partition's count is turned into an offset, so
    only one row a partition is ever gathered.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local).drop("_id", "_part", "_offset")
