"""Agents and admission: streams in several micro-batches against the batch forms and hand-made answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import admission, agents

SCHEMA = "event_id long, run_id string, ts timestamp, event_type string, agent string, duration_ms double"
T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def event(i, seconds, kind, agent, duration=None, run="r"):
    return (i, run, T0 + dt.timedelta(seconds=seconds), kind, agent, duration)


HAND = [
    event(1, 0, "agent_start", "m"), event(2, 1, "agent_message", "m"), event(3, 2, "delegate", "x"), event(4, 3, "agent_start", "x"),
    event(5, 4, "tool_call", "x"), event(6, 6, "agent_end", "x", 0.0), event(7, 7, "agent_message", "m"), event(8, 8, "agent_message", "m"),
    event(9, 9, "agent_start", "x"), event(10, 10, "agent_start", "x"), event(11, 12, "agent_end", "x", 1500.0),
    event(12, 13, "agent_end", "y"),
    event(13, 14, "agent_message", None), event(14, 15, "agent_message", "x"),
]


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_intervals_and_markers_by_hand(spark):
    e = spark.createDataFrame(HAND, SCHEMA)
    assert rows(agents.agent_intervals(e).select("agent", "start_ts", "end_ts", "duration_ms")) == sorted(
        [("m", at(0), None, None), ("x", at(3), at(6), 3000.0), ("x", at(9), None, None), ("x", at(10), at(12), 1500.0)], key=str
    )
    assert rows(agents.agent_markers(e).select("agent", "ts", "marker")) == sorted(
        [("m", at(1), "active"), ("m", at(2), "waiting"), ("x", at(4), "active"), ("m", at(7), "active"), ("m", at(9), "waiting")], key=str
    )
    assert rows(
        agents.agent_totals(agents.agent_intervals(e)).select("agent", "n", "total", "low")
    ) == [("m", 1, 0.0, 0.0), ("x", 3, 4500.0, 1500.0)]


def many(seed, n=250):
    draw = random.Random(seed)
    kinds = ["agent_start", "agent_end", "agent_message", "tool_call", "delegate", "other"]
    return [
        event(
            i, 20 * i + draw.randint(0, 15), draw.choice(kinds), draw.choice(["a", "b", "c", None]), draw.choice([None, 0.0, 5.0]),
            draw.choice("rs")
        ) for i in range(n)
    ]


def as_rows(intervals, markers, closed_only=False):
    i = intervals.select("run_id", F.lit("interval").alias("kind"), "agent", "start_ts", "end_ts", "duration_ms")
    m = markers.select(
        "run_id", F.col("marker").alias("kind"), "agent", F.col("ts").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"),
        F.lit(None).cast("double").alias("duration_ms")
    )
    return rows(i.unionByName(m))


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_equals_batch(spark, tmp_path, rocksdb):
    """Micro-batches of shuffled events within the lateness; a last event far later lets the watermark pass all, and ends the runs."""
    es = many(3)
    random.Random(1).shuffle(chunk := es[:])
    chunk.sort(key=lambda e: e[0] // 25)
    source = tmp_path / "in"
    for i in range(0, len(chunk), 50):
        spark.createDataFrame(chunk[i : i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"{i:04d}"))
    spark.createDataFrame([event(9999, 10_000_000, "other", None, run="end")], SCHEMA).coalesce(1).write.parquet(str(source / "9998"))
    spark.createDataFrame([event(10000, 10_000_001, "other", None, run="end")], SCHEMA).coalesce(1).write.parquet(str(source / "9999"))
    stream = spark.readStream.schema(
        spark.createDataFrame([], SCHEMA).schema
    ).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = agents.agents_stream(stream, "20 minutes", 3_600_000).writeStream.format("memory").queryName("agents").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    e = spark.createDataFrame(es, SCHEMA)
    assert rows(spark.table("agents")) == as_rows(agents.agent_intervals(e), agents.agent_markers(e))


DELIVERIES = [
    [(1, 0), (2, 60), (2, 60), (None, 5)],
    [(3, 1000), (1, 0), (None, 5)],
    [(2, 60), (4, 500), (3, 1000), (5, None), (6, 300)],
    [(6, 390), (7, 400), (7, 400)],
    [(7, 400), (8, 5000)],
    [(7, 400), (9, 4400), (9, 4399)],
]
ADMITTED = [(1, 0), (2, 0), (3, 1), (4, 2), (7, 3), (8, 4), (9, 5), (None, 0), (None, 1)]
REJECTED = [(2, 2), (5, 2), (6, 2), (6, 3), (7, 5), (9, 5)]


def delivered(spark, rows_):
    return spark.createDataFrame([(i, None if s is None else at(s), "x") for i, s in rows_], "event_id long, ts timestamp, body string")


def test_admission_in_batch(spark):
    log = None
    for b, r in enumerate(DELIVERIES):
        one = delivered(spark, r).withColumn("batch", F.lit(b))
        log = one if log is None else log.unionByName(one)
    admitted, rejected = admission.admit(log, "10 minutes")
    assert rows(admitted.select("event_id", "batch")) == sorted(ADMITTED, key=str)
    assert rows(rejected.select("event_id", "batch")) == sorted(REJECTED, key=str)
    none, late = admission.admit(log.where("batch > 9"))
    assert none.count() == late.count() == 0


def test_admission_of_a_stream_equals_batch_and_survives_a_repeated_epoch(spark, tmp_path):
    schema = delivered(spark, []).schema
    for i, r in enumerate(DELIVERIES):
        delivered(spark, r).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    gate = admission.Admission(str(tmp_path / "out"), schema, "10 minutes")
    stream = spark.readStream.schema(schema).option(
        "recursiveFileLookup", True
    ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gate.start(stream, str(tmp_path / "c"), availableNow=True)
    q.awaitTermination(300)
    assert q.exception() is None

    def both():
        return rows(
            gate.read(spark, "admitted").select("event_id", "epoch")
        ), rows(gate.read(spark, "rejected").select("event_id", "epoch"))

    assert both() == (sorted(ADMITTED, key=str), sorted(REJECTED, key=str))
    gate(delivered(spark, DELIVERIES[5]), 5)
    assert both() == (sorted(ADMITTED, key=str), sorted(REJECTED, key=str))
