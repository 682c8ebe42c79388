"""Admission of delivered events (T11): each event once, and events that come too late to a table of their own.

A delivery is late if its time is before the floor: the latest time of all *earlier* deliveries, less the allowed
lateness. Of the deliveries of one event that aren't late, the first counts; the others are dropped. A late one goes
to the rejects, whether its event was admitted before or not. Events without an id are never the same. A delivery
without a time is late. The batch form reads a log that numbers its deliveries; the stream form's are micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.sizes import small


def _late(ts: Column, floor: Column) -> Column:
    return ts.isNull() | F.coalesce(ts < floor, F.lit(False))


def _first_of_each(events: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id, added up in every task before the shuffle; all rows without an id."""
    whole = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    first = events.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(whole, F.struct(*order)).alias("_first"))
    return first.select("_first.*").unionByName(events.where(F.col(id_col).isNull()))


def admit(
    log: DataFrame, lateness: str = "10 minutes", batch_col: str = "batch", id_col: str = "event_id", ts_col: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected) of a log whose deliveries are numbered by ``batch_col``.

    The floors are a window over one row a batch number; everything else is grouped or joined by key.
    """
    tops = log.groupBy(batch_col).agg(F.max(ts_col).alias("_top"))
    before = Window.orderBy(batch_col).rowsBetween(Window.unboundedPreceding, -1)
    floors = tops.select(batch_col, (F.max("_top").over(before) - F.expr(f"INTERVAL {lateness}")).alias("_floor"))
    judged = log.join(small(floors), batch_col).withColumn("_late", _late(F.col(ts_col), F.col("_floor"))).select(*log.columns, "_late")
    admitted = _first_of_each(judged.where("NOT _late").drop("_late"), id_col, [batch_col, ts_col])
    return admitted, judged.where("_late").drop("_late")


class Admission:
    """The stream form: ``foreachBatch`` writes admitted and rejected events to two tables under ``folder``.

    State is kept in tables of the same folder, one version an epoch: the latest time seen, and the ids admitted since the
    floor (an event's redelivery has the event's time, so that older ids need not be kept). An epoch reads the version
    before it and overwrites its own parts, so that one that is run again after a failure gives the same tables.
    """

    def __init__(self, folder: str, schema: StructType, lateness: str = "10 minutes", id_col: str = "event_id", ts_col: str = "ts"):
        self.folder, self.schema, self.lateness, self.id_col, self.ts_col = folder, schema, lateness, id_col, ts_col
        epoch = StructField("epoch", LongType())
        self.narrow = StructType([schema[id_col], schema[ts_col]])
        self.kinds = {
            "admitted": StructType([*schema.fields, epoch]),
            "rejected": StructType([*schema.fields, epoch]),
            "open": StructType([*self.narrow.fields, epoch]),
            "state": StructType([StructField("top", schema[ts_col].dataType), epoch]),
        }

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """``admitted`` or ``rejected`` so far, with the epoch that each row came in."""
        self._ready(spark)
        return spark.read.schema(self.kinds[table]).parquet(f"{self.folder}/{table}")

    def _ready(self, spark: SparkSession) -> None:
        for name, schema in self.kinds.items():
            empty = spark.createDataFrame([], StructType(schema.fields[:-1]))
            empty.write.mode("ignore").parquet(f"{self.folder}/{name}/epoch=-1")

    def _write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/epoch={epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark, ts = batch.sparkSession, F.col(self.ts_col)
        self._ready(spark)
        batch = batch.select(*self.schema.fieldNames()).persist()
        earlier = self.read(spark, "state").where(F.col("epoch") < epoch)
        top = earlier.agg(F.max("top").alias("top"), F.max("epoch").alias("epoch"))
        floor = F.expr(f"top - INTERVAL {self.lateness}")
        judged = batch.join(
            F.broadcast(top.select(floor.alias("_floor"))), how="cross"
        ).withColumn("_late", _late(ts, F.col("_floor"))).drop("_floor")
        known = self.read(spark, "open").where(
            F.col("epoch") == (top.first()["epoch"] if top.first()["epoch"] is not None else -1)
        ).select(self.id_col, self.ts_col)
        fresh = _first_of_each(judged.where("NOT _late").drop("_late"), self.id_col, [self.ts_col])
        fresh = fresh.join(known.select(self.id_col).distinct(), self.id_col, "left_anti").select(*self.schema.fieldNames())
        self._write(judged.where("_late").drop("_late"), "rejected", epoch)
        self._write(fresh, "admitted", epoch)
        written = spark.read.schema(self.schema).parquet(f"{self.folder}/admitted/epoch={epoch}").select(self.id_col, self.ts_col)
        self._write(
            top.select("top").unionByName(batch.agg(F.max(self.ts_col).alias("top"))).agg(F.max("top").alias("top")), "state", epoch
        )
        now = self.read(spark, "state").where(F.col("epoch") == epoch).select(floor.alias("_floor"))
        still = known.unionByName(written).where(F.col(self.id_col).isNotNull()).join(F.broadcast(now), how="cross").where(
            F.coalesce(ts >= F.col("_floor"), F.lit(True))
        ).drop("_floor")
        self._write(still, "open", epoch)
        batch.unpersist()
        self._forget(spark, epoch - 2)

    def _forget(self, spark: SparkSession, epoch: int) -> None:
        """Removes ids of versions that no epoch reads any more."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/open/epoch={epoch}")
        if epoch >= 0:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, events: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
