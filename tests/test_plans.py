"""Star patterns with alternatives, joins with unbound variables, and the triple store's plan."""

import os
import random
from itertools import product

import pytest

from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import patterns
from graphloom.plans import mapping as m
from graphloom.plans.stars import MappedGraph
from graphloom.sources import files

NS = "http://n/"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "a": spark.createDataFrame(
            [(1, "x", "y", "K"), (2, "z", "z", "L"), (3, None, "w", None)], "id int, one string, two string, kind string"
        ),
        "b": spark.createDataFrame([(7, "x")], "id int, one string"),
    }
    a = m.TriplesMap(
        "a", NS + "a/{id}", (NS + "A", NS + "Thing"),
        (m.obj_col(NS + "p", "one"), m.obj_col(NS + "p", "two"), m.obj_tpl(terms.RDF_TYPE, NS + "{kind}"), m.obj_col(NS + "only", "two"))
    )
    b = m.TriplesMap("b", NS + "b/{id}", (NS + "B",), (m.obj_col(NS + "p", "one"),))
    return [a, b], tables


@pytest.mark.parametrize(
    "asked",
    [
        [("?x", NS + "p", "?v")],
        [("?x", terms.RDF_TYPE, "?c")],
        [("?x", terms.RDF_TYPE, NS + "K")],
        [("?x", terms.RDF_TYPE, NS + "Thing"), ("?x", NS + "p", "?v")],
        [("?x", NS + "p", "?v"), ("?x", NS + "p", "?w")],
        [("?x", NS + "p", "?v"), ("?y", NS + "p", "?v")],
        [("?x", NS + "p", "x")],
        [("?x", NS + "none", "?v")],
        [("?x", NS + "p", "?v"), ("?x", NS + "none", "?w")],
        [("?x", NS + "p", "?v"), ("?y", NS + "none", "?v")],
        [("?x", terms.RDF_TYPE, "?c"), ("?x", NS + "only", "?v")],
    ],
)
def test_stars_equal_patterns_on_triples(spark, shop, asked):
    mapping, tables = shop
    found = MappedGraph(mapping, tables).solve(asked).bindings()
    g = m.materialize(mapping, tables)
    want = patterns.bgp(g, asked)
    assert rows(found.select(*sorted(found.columns))) == rows(want.select(*sorted(want.columns)).distinct())


def compatible(a, b, on):
    return all(a[v] is None or b[v] is None or a[v] == b[v] for v in on)


def sides(seed, n=25):
    draw = random.Random(seed)
    value = lambda: draw.choice([None, 1, 2, 3])
    left = [{"k": i, "x": value(), "y": value(), "z": draw.randint(1, 2)} for i in range(n)]
    return left, [{"x": value(), "y": value(), "z": draw.randint(1, 2), "w": i} for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_optional_and_minus_with_unbound_variables(spark, seed):
    left, right = sides(seed)
    a, b = spark.createDataFrame(left, "k int, x int, y int, z int"), spark.createDataFrame(right, "x int, y int, z int, w int")
    on, want, kept = ("x", "y", "z"), [], []
    for r in left:
        met = [s for s in right if compatible(r, s, on)]
        want += [
            (r["k"], *(r[v] if r[v] is not None else s[v] for v in on), s["w"]) for s in met
        ] or [(r["k"], r["x"], r["y"], r["z"], None)]
        if not any(any(r[v] is not None and s[v] is not None for v in on) for s in met):
            kept.append(tuple(r.values()))
    found = patterns.optional(a, b, ("x", "y"), ("x", "y"))
    assert rows(found) == sorted(want, key=str)
    left_only = patterns.minus(a, b, ("x", "y"), ("x", "y"))
    assert rows(left_only) == sorted(kept, key=str)
    for df in (found, left_only):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert rows(patterns.minus(a, b.select("w"))) == rows(a)


def test_minus_without_a_common_bound_variable_keeps_rows(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k int, x int")
    b = spark.createDataFrame([(None, 0), (5, 1)], "x int, w int")
    assert rows(patterns.minus(a, b, ("x",), ("x",))) == [(1, None)]
    assert rows(patterns.optional(a, b.where("w > 5"), ("x",), ("x",))) == [(1, None, None), (2, 5, None)]


def test_triples_of_one_subject_join_without_a_shuffle(spark, tmp_path):
    triples = [
        (f"s{i}", p, f"{p}{i}", "literal", None, None) for i, p in product(range(200), ("p", "q"))
    ] + [(f"s{i}", "hot", str(j), "literal", None, None) for i, j in product(range(200), range(10))]
    g = spark.createDataFrame(triples, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    stored = files.write_triples(g, str(tmp_path / "g"), buckets=4)
    assert rows(stored) == rows(g)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = patterns.natural(patterns.scan(stored, "?x", "p", "?a"), patterns.scan(stored, "?x", "hot", "?b"))
        assert "Exchange" not in plan(met)
        assert met.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [f.stat().st_size for f in os.scandir(tmp_path / "g" / "p=hot") if f.name.endswith(".parquet")]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    files.write_triples(g.where("p = 'q'"), str(tmp_path / "g"), buckets=2)
    assert files.read_triples(spark, str(tmp_path / "g")).count() == 200


def test_optional_deals_rows_that_meet_many(spark, monkeypatch):
    """One task's rows, or rows of few keys, don't make all pairs in one task."""
    monkeypatch.setattr(patterns, "PAIRS", 500)
    data = [(k, None if k % 2 else k, k % 2) for k in range(100)]
    left = spark.createDataFrame(data, "k long, c long, x long").coalesce(1)
    right = spark.createDataFrame([(c, None if c % 3 else c % 2, f"v{c}") for c in range(60)], "c long, x long, v string").coalesce(1)
    got = patterns.optional(left, right, ("c",), ("x",))
    want = [
        (k, rc if c is None else c, x, v)
        for k, c, x in data for rc, rx, v in ((c, None if c % 3 else c % 2, f"v{c}") for c in range(60)) if c in (None, rc) and rx in (None, x)
    ]
    held = {k for k, *_ in want}
    want += [(k, c, x, None) for k, c, x in data if k not in held]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_optional_in_bundles(spark, monkeypatch, seed):
    """Bundles of several sizes, with and without keys, several parts of either side, equal rows among them."""
    for name, n in (("PAIRS", 20), ("MANY", 0), ("BUNDLE", 4), ("BLOCK", 3), ("OTHERS", 10)):
        monkeypatch.setattr(patterns, name, n)
    left, right = sides(seed, 40)
    left, right = [r | {"k": i % 30} for i, r in enumerate(left)], [s | {"w": i % 30} for i, s in enumerate(right)]
    a, b = spark.createDataFrame(left, "k int, x int, y int, z int"), spark.createDataFrame(right, "x int, y int, z int, w int")
    for on in (("x",), ("x", "y")):
        want = []
        for r in left:
            own = tuple(r[v] for v in ("k", "z") if v not in on)
            met = [s for s in right if compatible(r, s, on)]
            want += [(*own, *(r[v] if r[v] is not None else s[v] for v in on), s["w"]) for s in met] or [(*own, *(r[v] for v in on), None)]
        found = patterns.optional(a.select("k", "z", *on), b.select(*on, "w"), on, on)
        assert "Cartesian" in plan(found)
        assert rows(found) == sorted(want, key=str)


@pytest.mark.parametrize("bound", [False, True])
def test_pairs_of_rows_that_meet_many_take_little_room(spark, monkeypatch, tmp_path, bound):
    """A result that grows with the product of its sides is made in runs of equal values: 4 bytes a row else."""
    monkeypatch.setattr(patterns, "PAIRS", 1 << 21)
    k = F.col("id")
    left = spark.range(400).select(k.alias("k"), F.lit(None).cast("long").alias("c"), (k % 2).alias("x"))
    right = spark.range(40_000 if bound else 20_000).select((k * 1_000_003 % 1_000_000_007).alias("c"), (k % 2).alias("x"))
    if not bound:
        left, right = left.drop("x"), right.withColumnRenamed("x", "v")
    patterns.optional(left, right, ("c",)).write.parquet(str(tmp_path / "met"))
    met = spark.read.parquet(str(tmp_path / "met"))
    assert met.count() == met.select("k", "c").distinct().count() == 8_000_000
    if bound:
        assert met.join(right.withColumnRenamed("x", "own"), "c").where("x = own AND k % 2 = x").count() == 8_000_000
    assert sum(f.stat().st_size for f in os.scandir(tmp_path / "met") if f.name.endswith(".parquet")) < 0.6 * 8_000_000
