"""Agents of a run (T4, T9): their intervals, and when each is active or waiting, from events in batch and on streams.

An event has event_id, run_id, ts, event_type, agent and duration_ms. ``agent_start`` and ``agent_end`` open and close an
interval; ``agent_start`` and ``delegate`` give control to their agent; messages, tool calls and tool results are an agent's
content. Events without an agent are nothing. Order is by ts, then event_id.

The batch forms are windows; the stream form is a state machine for each run, which holds back events until the watermark
passes them, so that both give the same rows for all events that aren't late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CONTENT = ("agent_message", "tool_call", "tool_result")
CONTROL = ("agent_start", "delegate")
OUTPUT = "kind string, agent string, start_ts timestamp, end_ts timestamp, duration_ms double"


def _ms(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1000


def agent_intervals(events: DataFrame) -> DataFrame:
    """T4: (run_id, agent, start_ts, end_ts, duration_ms), one row for each agent_start.

    An interval ends with its agent's next agent_end; a given duration above 0 wins over the time between. One that is
    started again before it ends, or that never ends, has no end and no duration. An end without a start is nothing.
    """
    w = Window.partitionBy("run_id", "agent").orderBy("ts", "event_id")
    t = events.where(F.col("event_type").isin("agent_start", "agent_end") & F.col("agent").isNotNull())
    t = t.select(
        "run_id", "agent", "event_type", F.col("ts").alias("start_ts"),
        *(F.lead(c).over(w).alias(f"next_{c}") for c in ("event_type", "ts", "duration_ms"))
    )
    ended = F.col("next_event_type") == "agent_end"
    given = F.when(F.col("next_duration_ms") > 0, F.col("next_duration_ms").cast("double"))
    return t.where("event_type = 'agent_start'").select(
        "run_id", "agent", "start_ts", F.when(ended, F.col("next_ts")).alias("end_ts"),
        F.when(ended, F.coalesce(given, _ms("start_ts", "next_ts"))).alias("duration_ms")
    )


def agent_totals(intervals: DataFrame) -> DataFrame:
    """T4: for each run and agent its invocations, and total, mean, least and greatest duration of those above 0 (0 if none is)."""
    d = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    none = F.lit(0.0)
    return intervals.groupBy("run_id", "agent").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(d), none).alias("total"),
        F.coalesce(F.avg(d), none).alias("mean"),
        F.coalesce(F.min(d), none).alias("low"),
        F.coalesce(F.max(d), none).alias("high"),
    )


def agent_markers(events: DataFrame) -> DataFrame:
    """(run_id, agent, ts, marker): where an agent becomes active, by content of its own, and where it begins to wait.

    An agent that has shown content waits from the moment control goes to another one, until its next content.
    """
    own = events.where(F.col("agent").isNotNull() & F.col("event_type").isin(*CONTENT, *CONTROL))
    run = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    after, from_here = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("ts", "event_id", "agent")
    control = F.col("event_type").isin(*CONTROL)
    # in falling order, the last one before a row is the next one after it
    t = own.withColumn("next", F.last(F.when(control, place), True).over(after))
    t = t.withColumn(
        "change",
        F.last(
            F.when(control & (F.col("next.agent") != F.col("agent")), F.struct("agent", F.col("next").alias("to"))), True
        ).over(from_here)
    )
    t = t.withColumn("later", F.last(F.when(control, F.struct("agent", "change")), True).over(after))
    # the next control of another agent: the next one at all, or the one that takes control from it
    other = F.when(F.col("next.agent") != F.col("agent"), F.col("next")).otherwise(F.col("later.change.to"))
    content = t.where(F.col("event_type").isin(*CONTENT)).select("run_id", "agent", "ts", "event_id", other.alias("other"))
    agent = Window.partitionBy("run_id", "agent").orderBy("ts", "event_id")
    here, there = F.struct("ts", "event_id"), F.struct(F.col("other.ts"), F.col("other.event_id"))
    waits = F.col("other").isNotNull() & (F.lead(here).over(agent).isNull() | (there < F.lead(here).over(agent)))
    marked = content.withColumn("waits", waits).withColumn("waited", F.lag(waits).over(agent))
    active = marked.where("waited IS NULL OR waited").select("run_id", "agent", "ts", F.lit("active").alias("marker"))
    return active.unionByName(
        marked.where("waits").select("run_id", "agent", F.col("other.ts").alias("ts"), F.lit("waiting").alias("marker"))
    )


class RunAgents(StatefulProcessor):
    """The open agents of one run as a stack, and who is active; events wait in the state until the watermark passes them.

    A timer at the latest time of each arrival handles all events up to that time in order. A second timer, ``idle_ms``
    after the run's last handled event, ends the run: agents still open come out without an end, and the state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id long, ts long, event_type string, agent string, duration_ms double")
        self.run = handle.getValueState("run", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["agent"].notna() & frame["event_type"].isin([*CONTENT, *CONTROL, "agent_end"])]
            if len(frame):
                micros = frame["ts"].astype("datetime64[us]").astype("int64")
                duration = frame["duration_ms"].astype(float)
                self.held.appendList(
                    [(int(i), int(t), k, a, None if pd.isna(d) else float(d)) for i, t, k, a, d in zip(frame["event_id"], micros, frame["event_type"], frame["agent"], duration, strict=True)]
                )
                self.handle.registerTimer(-(-int(micros.max()) // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        state = json.loads(self.run.get()[0]) if self.run.exists() else {"open": [], "shows": {}, "last": None}
        held = sorted((tuple(e) for e in self.held.get()), key=lambda e: (e[1], e[0])) if self.held.exists() else []
        due = [e for e in held if e[1] <= now]
        out = [row for e in due for row in stepped(state, *e)]
        rest = held[len(due) :]
        if due:
            state["last"] = due[-1][1]
            self.handle.registerTimer(state["last"] // 1000 + self.idle_ms)
        if not rest and not due and state["last"] is not None and now >= state["last"] + self.idle_ms * 1000 - 1000:
            out += [("interval", a, start, None, None) for a, start in state["open"]]
            self.held.clear()
            self.run.clear()
        else:
            self.held.put(rest) if rest else self.held.clear()
            self.run.update((json.dumps(state),))
        if out:
            frame = pd.DataFrame(out, columns=["kind", "agent", "start_ts", "end_ts", "duration_ms"])
            for c in ("start_ts", "end_ts"):
                frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us")
            frame.insert(0, "run_id", key[0])
            frame["duration_ms"] = frame["duration_ms"].astype(float)
            yield frame
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def stepped(state: dict, event_id: int, ts: int, event_type: str, agent: str, duration_ms: float | None) -> list[tuple]:
    """Moves a run's state on by one event; the rows that it gives (kind, agent, start, end, duration)."""
    out: list[tuple] = []
    started = dict(map(tuple, state["open"]))
    if event_type in ("agent_start", "agent_end") and agent in started:
        state["open"] = [x for x in state["open"] if x[0] != agent]
        ended = event_type == "agent_end"
        given = duration_ms if duration_ms is not None and duration_ms > 0 else (ts - started[agent]) / 1000
        out.append(("interval", agent, started[agent], ts if ended else None, given if ended else None))
    if event_type == "agent_start":
        state["open"].append([agent, ts])
    if event_type in CONTROL:
        for other, active in state["shows"].items():
            if other != agent and active:
                out.append(("waiting", other, ts, None, None))
                state["shows"][other] = False
    elif event_type in CONTENT and not state["shows"].get(agent):
        out.append(("active", agent, ts, None, None))
        state["shows"][agent] = True
    return out


def agents_stream(events: DataFrame, lateness: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """T4 and T9 on a stream: (run_id, kind, agent, start_ts, end_ts, duration_ms), kind being interval, active or waiting.

    Rows come out once the watermark, ``lateness`` behind the latest event, has passed them; a run without events for
    ``idle_ms`` ends. The session needs Spark's RocksDB state store provider. ``ts`` must be a timestamp.
    """
    kind = events.schema["run_id"].dataType.simpleString()
    own = events.select("event_id", "run_id", "ts", "event_type", "agent", F.col("duration_ms").cast("double").alias("duration_ms"))
    return own.withWatermark("ts", lateness).groupBy("run_id").transformWithStateInPandas(
        RunAgents(idle_ms), f"run_id {kind}, {OUTPUT}", "append", "EventTime"
    )
