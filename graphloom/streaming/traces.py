"""Trace events (T1-T12): batch forms, and streaming forms of those that run continuously.

An event has run_id, ts, event_type, phase, agent, duration_ms, call_id. Streams are bounded by
watermarks; what is later goes to no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _by_run() -> object:
    return Window.partitionBy("run_id").orderBy("ts", "event_id")


def phase_intervals(events: DataFrame) -> DataFrame:
    """Each phase_start to its end, the next start, or the run's last event; a given duration wins."""
    marks = events.where(F.col("event_type").isin("phase_start", "phase_end", "run_end"))
    t = marks.withColumn("end_ts", F.lead("ts").over(_by_run())).withColumn("given", F.lead("duration_ms").over(_by_run())).withColumn(
        "next_type", F.lead("event_type").over(_by_run())
    )
    span = (F.col("end_ts").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) * 1000
    given = F.when(F.col("next_type") == "phase_end", F.col("given"))
    return t.where("event_type = 'phase_start'").select(
        "run_id", "phase", F.col("ts").alias("start_ts"), "end_ts", F.coalesce(given, span).alias("duration_ms")
    )


def phase_intervals_stream(events: DataFrame, lateness: str | None = "10 minutes") -> DataFrame:
    """T1 on a stream: the open phase of a run is its state; it is emitted at its end or when the watermark passes. lateness None: ``events`` has a watermark."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            if open_[0] is not None:
                yield pd.DataFrame({"run_id": [key[0]], "phase": [open_[0]], "duration_ms": [None]})
            return
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if open_[0] is not None:
                out.append((key[0], open_[0], row.ts.timestamp() * 1000 - open_[1]))
                open_ = (None, None)
            if row.event_type == "phase_start":
                open_ = (row.phase, row.ts.timestamp() * 1000)
        if open_[0] is None:
            if state.exists:
                state.remove()
        else:
            state.update(open_)
            state.setTimeoutTimestamp(int(open_[1]) + 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "phase", "duration_ms"])

    marks = events.where(F.col("event_type").isin("phase_start", "phase_end", "run_end"))
    marks = marks.withWatermark("ts", lateness) if lateness else marks
    kind = events.schema["run_id"].dataType.simpleString()
    return marks.groupBy("run_id").applyInPandasWithState(
        step, f"run_id {kind}, phase string, duration_ms double", "phase string, start_ms double", "append",
        GroupStateTimeout.EventTimeTimeout
    )


def pair_calls(events: DataFrame, within: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Tool calls with their results by call id. On streams ``watermark`` is needed, and ``within`` bounds the state: later results are not paired."""
    one = events.where("event_type = 'tool_call'").select("run_id", "call_id", "agent", F.col("ts").alias("call_ts"))
    two = events.where("event_type = 'tool_result'").select(
        F.col("run_id").alias("r"), F.col("call_id").alias("c"), F.col("ts").alias("result_ts"), "duration_ms"
    )
    if watermark:
        one, two = one.withWatermark("call_ts", watermark), two.withWatermark("result_ts", watermark)
    bound = f" and result_ts <= call_ts + interval {within}" if watermark else ""
    met = one.join(two, F.expr("run_id = r and call_id = c and result_ts >= call_ts" + bound))
    return met.select("run_id", "call_id", "agent", "call_ts", "result_ts", "duration_ms")


def call_results(events: DataFrame) -> DataFrame:
    """T2 with what the result's ``content`` tells: its length, success, and the number of results it names or lists.

    A result whose first 100 characters hold "error" is a failure. "found", "returned" or "retrieved" before a number gives
    that number; else a JSON list gives its length; else 0. A null content is empty.
    """
    one = events.where("event_type = 'tool_call'").select("run_id", "call_id", "agent", F.col("ts").alias("call_ts"))
    content = F.coalesce("content", F.lit("")).alias("content")
    two = events.where("event_type = 'tool_result'").select(
        F.col("run_id").alias("r"), F.col("call_id").alias("c"), F.col("ts").alias("result_ts"), content
    )
    met = one.join(two, F.expr("run_id = r and call_id = c and result_ts >= call_ts"))
    span = (F.unix_micros(F.col("result_ts").cast("timestamp")) - F.unix_micros(F.col("call_ts").cast("timestamp"))) / 1000
    low = F.lower("content")
    named = F.try_to_number(
        F.nullif(F.regexp_extract(low, r"(?:found|returned|retrieved)\s+(\d+)", 1), F.lit("")), F.lit("9" * 18)
    ).cast("long")
    listed = F.when(F.startswith("content", F.lit("[")) & F.endswith("content", F.lit("]")), F.json_array_length("content"))
    success = ~F.contains(F.substring(low, 1, 100), F.lit("error"))
    return met.select(
        "run_id", "call_id", "agent", "call_ts", "result_ts", span.alias("duration_ms"), F.length("content").alias("output_size"),
        success.alias("success"), F.coalesce(named, listed.cast("long"), F.lit(0).cast("long")).alias("results")
    )


def llm_calls(events: DataFrame, *values: str) -> DataFrame:
    """An LLM call takes the next result's ``values``: tokens unless named otherwise, such as cost."""
    values = values or ("tokens",)
    t = events.where(F.col("event_type").isin("llm_call", "llm_result")).select(
        "*", F.lead(F.struct("event_type", *values)).over(_by_run()).alias("next")
    )
    return t.where("event_type = 'llm_call'").select(
        "run_id", "event_id", "ts", *(F.when(F.col("next.event_type") == "llm_result", F.col(f"next.{v}")).alias(v) for v in values)
    )


def agent_times(intervals: DataFrame) -> DataFrame:
    """T4: intervals (run_id, agent, duration_ms): n, total, mean, min, max of those above 0."""
    d = F.col("duration_ms")
    return intervals.where(d > 0).groupBy("agent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high")
    )


def delegations(events: DataFrame) -> DataFrame:
    """T5: each delegation (from_agent to agent, with a reason) at its end: how long it took, and whether the end's reason names success.

    A second start to the same agent replaces an open one; an end without a start is nothing.
    """
    w = Window.partitionBy("run_id", "agent").orderBy("ts", "event_id")
    t = events.where(F.col("event_type").isin("delegate", "delegate_end"))
    t = t.select("*", *(F.lag(c).over(w).alias(f"start_{c}") for c in ("event_type", "ts", "from_agent", "reason")))
    span = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1000
    ended = t.where("event_type = 'delegate_end' and start_event_type = 'delegate'")
    return ended.select(
        "run_id", F.col("start_from_agent").alias("from_agent"), F.col("agent").alias("to_agent"), F.col("start_reason").alias("reason"),
        span.alias("duration_ms"), F.coalesce(F.contains(F.lower("reason"), F.lit("success")), F.lit(False)).alias("success")
    )


def delegations_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """T5 on a stream: the open delegation to an agent is the state; it is dropped a day after its start."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = state.get if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if row.event_type == "delegate":
                open_ = (row.from_agent, row.reason, row.ts.timestamp() * 1000)
            elif open_ is not None:
                out.append(
                    (key[0], open_[0], key[1], open_[1], row.ts.timestamp() * 1000 - open_[2], "success" in (row.reason or "").lower())
                )
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update(open_)
            state.setTimeoutTimestamp(max(int(open_[2]) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "from_agent", "to_agent", "reason", "duration_ms", "success"])

    own = events.where(F.col("event_type").isin("delegate", "delegate_end")).withWatermark("ts", lateness)
    kind = events.schema["run_id"].dataType.simpleString()
    return own.groupBy("run_id", "agent").applyInPandasWithState(
        step, f"run_id {kind}, from_agent string, to_agent string, reason string, duration_ms double, success boolean",
        "from_agent string, reason string, start_ms double", "append", GroupStateTimeout.EventTimeTimeout
    )


def tool_usage_by_agent(calls: DataFrame) -> DataFrame:
    """Calls (run_id, agent, tool, duration_ms, success, results, useful): counts, times, success rate, results, useful ones and the tool's category; on a stream in update mode."""
    from graphloom.functions.text import tool_category

    d, n = F.col("duration_ms"), F.count(F.lit(1))
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    times = [F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.min(d).alias("low_ms"), F.max(d).alias("high_ms")]
    t = calls.groupBy("run_id", "agent", "tool").agg(
        n.alias("calls"), *times, ok.alias("ok"), (n - ok).alias("errors"), (ok / n).alias("success_rate"),
        F.sum("results").alias("results"), F.avg("results").alias("mean_results"),
        F.count_if(F.coalesce("useful", F.lit(False))).alias("useful")
    )
    return t.withColumn("category", tool_category(F.col("tool")))


def run_totals(calls: DataFrame, phases: list[str]) -> DataFrame:
    """Tokens of each phase; what no phase accounts for is the orchestrator's, at least 0. calls (run_id, phase, tokens, total)."""
    by = [F.sum(F.when(F.col("phase") == p, F.col("tokens")).otherwise(0)).alias(p) for p in phases]
    t = calls.groupBy("run_id").agg(F.max("total").alias("total"), *by)
    return t.withColumn("orchestrator", F.greatest(F.lit(0), F.col("total") - sum((F.col(p) for p in phases), F.lit(0))))


def run_times(events: DataFrame, durations: DataFrame, kinds: list[str]) -> DataFrame:
    """A run's time from its first event to its last, and the summed durations of each kind (0 without any).

    durations (run_id, kind, duration_ms) are those of phases, model calls and tools.
    """
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000
    runs = events.groupBy("run_id").agg(span.alias("total_ms"))
    sums = durations.groupBy("run_id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("duration_ms"))).alias(f"{k}_ms") for k in kinds))
    return runs.join(sums, "run_id", "left").select(
        "run_id", "total_ms", *(F.coalesce(f"{k}_ms", F.lit(0.0)).alias(f"{k}_ms") for k in kinds)
    )


def run_summary(events: DataFrame) -> DataFrame:
    """One row a run."""
    return events.groupBy("run_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("agent").alias("n_agents"), F.count_if(F.col("event_type") == "tool_call").alias("n_calls")
    )


def timeline(events: DataFrame) -> DataFrame:
    """The events at which control goes to another agent."""
    prev = F.lag("agent").over(_by_run())
    return events.where("agent is not null").withColumn("from_agent", prev).where("from_agent is null or from_agent <> agent").select(
        "run_id", "ts", "from_agent", F.col("agent").alias("to_agent")
    )


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is planned and not finished."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def dedupe_events(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Re-delivered events once; on a stream the state is bounded by the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def event_rates(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    t = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("window.start").alias("window_start"), "event_type", "n")


def session_rates(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Events by run and session."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    t = e.groupBy(F.session_window("ts", gap), "run_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("run_id", F.col("session_window.start").alias("session_start"), "n")
