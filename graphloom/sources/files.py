"""Sources and sinks."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions.text import is_float


def read_csv_loose(spark: SparkSession, path: str) -> DataFrame:
    """Comma or, if the header has none, semicolon; clean column names; blank cells are null; short rows are padded."""
    head = spark.read.text(path).limit(1).first()
    sep = "," if head is None or "," in head[0] else ";"
    df = spark.read.option("sep", sep).option("mode", "PERMISSIVE").csv(path, header=True)
    df = df.toDF(*(re.sub(r"[^A-Za-z0-9_]", "_", c) for c in df.columns))
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns))


def infer_types(df: DataFrame, sample: int = 1000, most: int = 100) -> DataFrame:
    """(col, type, max_len) by each column's first values that aren't blank, in row order.

    INT or DECIMAL(15,6) if its first ``most`` are; else VARCHAR of twice the longest of the first ``sample`` (255 at
    most), TEXT beyond 255 characters and for columns without values.
    """
    columns = spark_names(df)
    cells = df.select(
        F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`").cast("string").alias(n) for c, n in columns.items())
    ).unpivot(["_row"], list(columns.values()), "col", "value")
    first = cells.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn(
        "r", F.row_number().over(Window.partitionBy("col").orderBy("_row"))
    ).where(F.col("r") <= sample)
    whole, number = F.col("value").rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), is_float(F.col("value"))
    early = F.col("r") <= most
    t = first.groupBy("col").agg(
        F.bool_and(whole | ~early).alias("i"), F.bool_and(number | ~early).alias("d"), F.max(F.length("value")).alias("max_len")
    )
    names = df.sparkSession.createDataFrame([(n, c) for c, n in columns.items()], "col string, name string")  # one row a column
    varchar = F.concat(F.lit("VARCHAR("), F.least(2 * F.col("max_len"), F.lit(255)).cast("string"), F.lit(")"))
    kind = F.when(F.col("i"), "INT").when(F.col("d"), "DECIMAL(15,6)").when(F.col("max_len") <= 255, varchar).otherwise("TEXT")
    return names.join(t, "col", "left").select(
        F.col("name").alias("col"), kind.alias("type"), F.coalesce("max_len", F.lit(0)).alias("max_len")
    )


def spark_names(df: DataFrame) -> dict[str, str]:
    """A plain name for each column."""
    return {c: f"c{i}" for i, c in enumerate(df.columns)}


def sample_tables(tables: dict[str, DataFrame], n: int = 100) -> dict[str, DataFrame]:
    """S3: all-string tables of at most n rows."""
    return {k: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).limit(n) for k, df in tables.items()}


def read_runs(
    spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = ("run_id", "question_id"), multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One JSON document a file (or a line, without ``multi_line``); (complete runs, rejects counted by reason)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    df = spark.read.schema(
        StructType(schema.fields).add("_corrupt", "string")
    ).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=multi_line)
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    reason = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(missing, "incomplete")
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason", "_corrupt"), tagged.where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def shrink(df: DataFrame, rows: int = 100_000, seed: int = 0) -> DataFrame:
    """A random sample of at most ``rows`` rows (top-k in each task, then of all)."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(rows).drop("_r")


def to_cells(df: DataFrame, result_id: str, row_id: str) -> DataFrame:
    """Rows as cells (result_id, row_id, col, value); null cells are left out."""
    cols = [c for c in df.columns if c not in (result_id, row_id)]
    texts = df.select(F.col(result_id).alias("result_id"), F.col(row_id).alias("row_id"), *(F.col(c).cast("string").alias(c) for c in cols))
    return texts.unpivot(["result_id", "row_id"], cols, "col", "value").where("value is not null")


def write_triples(df: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """A table of triples under ``path``, partitioned by predicate, bucketed and sorted by subject; returns it.

    A predicate's triples are dealt over ``buckets`` files by subject (as many as Spark's shuffle partitions, unless given),
    so that a frequent one is no single file. Patterns of predicates prune to their folders, and joins of patterns on their
    subject read equal buckets together, without a shuffle. The session's catalog knows the table by a name made from the path.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    own = df.select("s", "o", "o_kind", "o_datatype", "o_lang", "p")
    own.repartition(n, "s").sortWithinPartitions("p", "s").write.mode("overwrite").option("path", path).partitionBy("p").bucketBy(n, "s").sortBy("s").saveAsTable(name)
    return read_triples(spark, path)


def _table_name(path: str) -> str:
    return f"triples_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_triples`` wrote: with its buckets if this session's catalog knows it, else as files."""
    name = _table_name(path)
    df = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)
    return df.select("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def write_eval(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def build_snapshot(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs, tagged with their source; missing columns are null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source_run", F.lit(k)) for k, df in runs.items())
    )


def read_jdbc(spark: SparkSession, url: str, tbl: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column."""
    if column is None:
        return spark.read.jdbc(url, tbl)
    return spark.read.jdbc(url, tbl, column=column, lowerBound=low, upperBound=high, numPartitions=parts)
