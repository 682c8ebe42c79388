"""Queries of trace events: agents, admission, calls and times of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import _events
from graphloom.registry import register, table
from graphloom.streaming import admission, agents, traces

KINDS = ["agent_start", "agent_message", "agent_end", "tool_call", "tool_result", "delegate", "agent_message"]
KIND = f"[{', '.join(map(repr, KINDS))}][event_id % {len(KINDS)} + 1]"
#: Agents by number of the event, some without one; given durations on some ends.
STEPS = f"""steps AS (SELECT user_id AS run_id, event_id, ts, CASE WHEN event_id % 13 > 0 THEN 'a' || event_id * 7 % 4 END AS agent, {KIND} AS event_type,
 CASE WHEN event_id % 3 = 0 THEN value - 20 END AS duration_ms FROM events)"""


def _steps(spark, d) -> DataFrame:
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    agent = F.when(k % 13 > 0, F.concat(F.lit("a"), (k * 7 % 4).cast("string")))
    return _events(spark, d).select(
        "run_id", "event_id", "ts", agent.alias("agent"), kind.alias("event_type"),
        F.when(k % 3 == 0, F.col("value") - 20).alias("duration_ms")
    )


INTERVALS = f"""{STEPS}, marks AS (SELECT * FROM steps WHERE agent IS NOT NULL AND event_type IN ('agent_start', 'agent_end')),
spans AS (SELECT s.run_id, s.agent, s.ts AS start_ts, e.ts AS end_ts, CASE WHEN e.duration_ms > 0 THEN e.duration_ms ELSE (epoch_us(e.ts) - epoch_us(s.ts)) / 1000.0 END AS duration_ms
 FROM marks s LEFT JOIN marks e ON e.event_type = 'agent_end' AND e.event_id = (SELECT min(x.event_id) FROM marks x WHERE x.run_id = s.run_id AND x.agent = s.agent AND x.event_id > s.event_id)
 WHERE s.event_type = 'agent_start')"""


@register(f"WITH {INTERVALS} SELECT * FROM spans")
def t4_agent_intervals(spark, d):
    return agents.agent_intervals(_steps(spark, d))


@register(f"""WITH {INTERVALS} SELECT run_id, agent, count(*) AS n, round(coalesce(sum(duration_ms) FILTER (duration_ms > 0), 0), 4) AS total, round(coalesce(avg(duration_ms) FILTER (duration_ms > 0), 0), 4) AS mean,
 coalesce(min(duration_ms) FILTER (duration_ms > 0), 0) AS low, coalesce(max(duration_ms) FILTER (duration_ms > 0), 0) AS high FROM spans GROUP BY 1, 2""")
def t4_agent_totals(spark, d):
    t = agents.agent_totals(agents.agent_intervals(_steps(spark, d)))
    return t.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4))


@register(f"""WITH {STEPS}, c AS (SELECT *, lead(event_id) OVER (PARTITION BY run_id, agent ORDER BY event_id) AS following FROM steps WHERE agent IS NOT NULL AND event_type IN ('agent_message', 'tool_call', 'tool_result')),
w AS (SELECT c.run_id, c.agent, c.event_id, any_value(c.ts) AS ts, any_value(c.following) AS following, min(o.event_id) AS other FROM c LEFT JOIN steps o ON o.run_id = c.run_id AND o.event_type IN ('agent_start', 'delegate') AND o.agent <> c.agent AND o.event_id > c.event_id GROUP BY ALL),
x AS (SELECT *, other IS NOT NULL AND (following IS NULL OR other < following) AS waits FROM w),
y AS (SELECT *, lag(waits) OVER (PARTITION BY run_id, agent ORDER BY event_id) AS waited FROM x)
SELECT run_id, agent, ts, 'active' AS marker FROM y WHERE waited IS NULL OR waited UNION ALL
SELECT y.run_id, y.agent, steps.ts, 'waiting' FROM y JOIN steps ON steps.event_id = other WHERE waits""")
def t9_agent_markers(spark, d):
    return agents.agent_markers(_steps(spark, d))


#: Deliveries of 500 events; every eleventh event comes four deliveries later, every fifth comes again one later.
LOG = """log AS (SELECT event_id, ts, value, event_id // 500 + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS batch FROM events
 UNION ALL SELECT event_id, ts, value, event_id // 500 + 1 FROM events WHERE event_id % 5 = 0),
floors AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 day AS floor FROM (SELECT batch, max(ts) AS top FROM log GROUP BY 1)),
judged AS (SELECT log.*, coalesce(ts < floor, false) AS late FROM log JOIN floors USING (batch))"""


def _log(spark, d) -> DataFrame:
    e, b = table(spark, d, "events").select("event_id", "ts", "value"), F.floor(F.col("event_id") / 500)
    once = e.withColumn("batch", b + F.when(F.col("event_id") % 11 == 0, 4).otherwise(0))
    return once.unionByName(e.where("event_id % 5 = 0").withColumn("batch", b + 1))


@register(f"WITH {LOG} SELECT event_id, any_value(ts) AS ts, min(batch) AS batch FROM judged WHERE NOT late GROUP BY event_id")
def t11_admitted(spark, d):
    return admission.admit(_log(spark, d), "1 day")[0].select("event_id", "ts", "batch")


@register(f"WITH {LOG} SELECT event_id, ts, value, batch FROM judged WHERE late")
def t11_rejected(spark, d):
    return admission.admit(_log(spark, d), "1 day")[1]


RESULTS = ["found 12 rows", "[1, 2, 3]", "Error: no such class", "returned 7", "nothing", None]


@register(f"""SELECT a.event_id // 2 AS call_id, a.ts AS call_ts, b.ts AS result_ts, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000.0 AS duration_ms, length(r) AS output_size, NOT contains(lower(r)[:100], 'error') AS success,
 CASE WHEN regexp_matches(lower(r), '(found|returned|retrieved)\\s+\\d+') THEN regexp_extract(lower(r), '(found|returned|retrieved)\\s+(\\d+)', 2)::BIGINT WHEN r LIKE '[%]' THEN 3 ELSE 0 END AS results
 FROM (SELECT *, coalesce([{', '.join('NULL' if x is None else repr(x) for x in RESULTS)}][event_id // 2 % {len(RESULTS)} + 1], '') AS r FROM events) b JOIN events a ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0 WHERE a.ts <= b.ts""")
def t2_call_results(spark, d):
    call = F.floor(F.col("event_id") / 2)
    content = F.element_at(F.array(*(F.lit(x) for x in RESULTS)), (call % len(RESULTS) + 1).cast("int"))
    e = table(spark, d, "events").select(
        (call % 50).alias("run_id"), call.alias("call_id"), F.col("event_type").alias("agent"), "ts", content.alias("content"),
        F.when(F.col("event_id") % 2 == 0, "tool_call").otherwise("tool_result").alias("event_type")
    )
    return traces.call_results(e).select("call_id", "call_ts", "result_ts", "duration_ms", "output_size", "success", "results")


@register("""WITH e AS (SELECT user_id AS run_id, ts, ['retrieval', 'generation', 'llm', 'tool', 'other'][event_id % 5 + 1] AS kind, value FROM events)
SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS total_ms, round(coalesce(sum(value) FILTER (kind = 'retrieval'), 0), 4) AS retrieval_ms, round(coalesce(sum(value) FILTER (kind = 'generation'), 0), 4) AS generation_ms,
 round(coalesce(sum(value) FILTER (kind = 'llm'), 0), 4) AS llm_ms, round(coalesce(sum(value) FILTER (kind = 'tool'), 0), 4) AS tool_ms FROM e GROUP BY run_id""")
def t7_run_times(spark, d):
    e = _events(spark, d)
    kinds = ["retrieval", "generation", "llm", "tool"]
    kind = F.element_at(F.array(*map(F.lit, [*kinds, "other"])), (F.col("event_id") % 5 + 1).cast("int"))
    t = traces.run_times(e, e.select("run_id", kind.alias("kind"), F.col("value").alias("duration_ms")), kinds)
    return t.select("run_id", "total_ms", *(F.round(f"{k}_ms", 4).alias(f"{k}_ms") for k in kinds))


@register(
    "SELECT event_id, CASE WHEN k = 1 THEN n END AS tokens, CASE WHEN k = 1 THEN c END AS cost FROM (SELECT event_id, lead(value * 2) OVER w AS n, lead(value) OVER w AS c, lead(event_id % 2) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_id % 2 = 0"
)
def t3_llm_costs(spark, d):
    e = _events(spark, d).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "llm_call").otherwise("llm_result"))
    return traces.llm_calls(
        e.withColumn("tokens", F.col("value") * 2).withColumn("cost", F.col("value")), "tokens", "cost"
    ).select("event_id", "tokens", "cost")
