"""Order statistics by selection against sorting."""

import math
import random

import pytest

from graphloom.operators import analytics
from graphloom.operators.quantiles import exact_quantiles


def plain(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return v[lo] if lo == hi else (hi - pos) * v[lo] + (pos - lo) * v[hi]


def data(seed, n=400):
    draw = random.Random(seed)
    rows = [(draw.choice(["a", "b", None]), draw.choice([7.0, 7.0, 7.0, draw.gauss(0, 50), float(draw.randint(-3, 3))])) for _ in range(n)]
    return [*rows, ("few", 1.5), ("few", 2.5), ("one", -0.0), ("none", None), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 1.0)]


@pytest.mark.parametrize("limit,ways", [(100_000, 64), (5, 4), (1, 2), (50, 8)])
def test_equals_sorting_with_cells_of_any_size(spark, limit, ways):
    rows = data(limit)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares, limit, ways).collect()
    want = {}
    for k, x in rows:
        if x is not None:
            want.setdefault(k, []).append(x)
    assert {r.k: r.n for r in found} == {k: len(v) for k, v in want.items()}
    for r in found:
        for name, p in shares.items():
            assert r[name] == plain(want[r.k], p), (r.k, name)


def test_no_rows_and_no_keys(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert exact_quantiles(none, ["k"], "x", {"m": 0.5}).count() == 0
    some = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    assert [tuple(r) for r in exact_quantiles(some, [], "x", {"m": 0.5}).collect()] == [(2, 1.5)]


def test_no_aggregate_holds_a_groups_values(spark):
    df = spark.createDataFrame([("r", "q", 1, [(3,)], 1.0)], "run_id string, c string, n int, calls array<struct<k int>>, score double")
    for stats in (analytics.search_size(df, 2, ["c"]), analytics.runtime_stats(df, ["score"], [[], ["c"]])):
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
