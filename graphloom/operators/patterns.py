"""Graph-pattern operators over triples (P1-P32): bindings are DataFrames, a variable is a column."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import sizes
from graphloom.functions.terms import RDF_TYPE, namespace
from graphloom.sizes import small

#: Pairs of rows that one task may make, where every row may fit every row.
PAIRS = 1 << 24
#: Rows meet in bundles if each row, and each test of two bundles, finds so many on average.
MANY = 64
#: Rows of a bundle, of a bundle of the others, and of a part of the others.
BUNDLE, BLOCK, OTHERS = 128, 64, 1 << 16


def is_var(term: str) -> bool:
    return term.startswith("?")


def scan(g: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Constants filter, variables are projected, a repeated variable means equality."""
    seen: dict[str, str] = {}
    for column, term in zip(("s", "p", "o"), (s, p, o), strict=True):
        if not is_var(term):
            g = g.where(F.col(column) == term)
        elif term[1:] in seen:
            g = g.where(F.col(column) == F.col(seen[term[1:]]))
        else:
            seen[term[1:]] = column
    return g.select(*(F.col(c).alias(v) for v, c in seen.items()))


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural(a: DataFrame, b: DataFrame) -> DataFrame:
    on = shared(a, b)
    if not on:
        raise ValueError("patterns share no variable")
    return a.join(b, on)


def bgp(g: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Inner natural join of all patterns."""
    return reduce(natural, (scan(g, *p) for p in patterns))


def typed(g: DataFrame, var: str, cls: str) -> DataFrame:
    """?var a cls."""
    return scan(g, var, RDF_TYPE, cls)


def _masks(df: DataFrame, loose: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
    """The rows that leave each set of ``loose`` variables unbound."""
    out = []
    for n in range(len(loose) + 1):
        for unbound in combinations(loose, n):
            tests = [F.col(v).isNull() if v in unbound else F.col(v).isNotNull() for v in loose]
            out.append((frozenset(unbound), df.where(reduce(Column.__and__, tests)) if tests else df))
    return out


def _equal(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(v) == F.col(f"_{v}") for v in keys))


def _counted(rows: DataFrame, others: DataFrame, keys: list[str]) -> tuple[int, int, float, int]:
    """Rows of both sides, the pairs that agree in ``keys``, and the different keys of ``others``."""
    if not keys:
        n, m = rows.count(), others.count()
        return n, m, n * m, 1
    a = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = others.groupBy(*(f"_{v}" for v in keys)).agg(F.count(F.lit(1)).alias("_m"))
    pairs = a.join(b, _equal(keys)).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    return rows.count(), *b.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.lit(pairs), F.count(F.lit(1))).first()


def _bundles(df: DataFrame, keys: list[str], parts: int, size: int, name: str) -> DataFrame:
    """Rows of equal ``keys`` in arrays of up to ``size``, the rows dealt over so many parts."""
    dealt = df.repartition(parts).withColumn("_part", F.spark_partition_id())
    arrays = dealt.groupBy("_part", *keys).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    # by the part's number: nothing depends on the order in which rows are collected
    slices = F.expr(f"transform(sequence(1, size({name}), {size}), i -> slice({name}, i, {size}))")
    return arrays.repartitionByRange(parts, "_part").select(*(F.col(v).alias(f"{name}{v}") for v in keys), F.explode(slices).alias(name))


def _meeting(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs that agree in ``keys``, of two sides of which many rows may meet.

    Few keys or none would make few tasks, so rows are dealt and a task makes a bounded number of pairs. Where a row meets many, both sides
    travel in bundles of equal keys: each task has a part of either side, and two bundles that meet are opened so that the pairs of one of
    ``others`` stand together and the same few rows return at short distance. Written to columns, such pairs take a small part of the room
    that they take row by row. Others are sent to all tasks if they are small and rows meet few of them, else such a join is left to Spark.
    """
    join = lambda a, b: a.join(b, _equal(keys)) if keys else a.crossJoin(b)
    sent = small(others)
    n, m, pairs, kinds = _counted(rows, others, keys)
    if pairs <= PAIRS:
        return join(rows, sent)
    tasks = max(math.ceil(pairs / PAIRS), rows.sparkSession.sparkContext.defaultParallelism)
    their_parts = math.ceil(m / OTHERS)
    our_parts = max(math.ceil(tasks / their_parts), sizes.parts(n))
    tests = (n / BUNDLE + our_parts * kinds) * (m / BLOCK + their_parts * kinds)
    if pairs < MANY * max(n, tests):
        return join(rows if sent is others else rows.repartition(tasks), sent)
    ours = _bundles(rows, keys, our_parts, BUNDLE, "_rows")
    theirs = _bundles(others, [f"_{v}" for v in keys], their_parts, BLOCK, "_others").hint("shuffle_replicate_nl")
    equal = [F.col(f"_rows{v}") == F.col(f"_others_{v}") for v in keys]
    met = theirs.join(ours, reduce(Column.__and__, equal)) if keys else theirs.crossJoin(ours)
    return met.select(F.inline("_others"), "_rows").select(F.inline("_rows"), *others.columns)


def optional(left: DataFrame, right: DataFrame, nullable: tuple[str, ...] = (), nullable_right: tuple[str, ...] = ()) -> DataFrame:
    """Left join. Variables in ``nullable`` may be unbound on the left, in ``nullable_right`` on the right; unbound fits anything.

    Rows are parted by the variables that they leave unbound, and each pair of parts is an equi-join on what both bind.
    Only where no shared variable is bound on both sides does every row fit every row.
    """
    on = shared(left, right)
    ln, rn = [v for v in on if v in nullable], [v for v in on if v in nullable_right]
    if not ln and not rn:
        return left.join(right, on, "left")
    own = [c for c in right.columns if c not in on]
    rights = [
        (free, part.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns))) for free, part in _masks(right, rn)
    ]
    parts = []
    for unbound, rows in _masks(left, ln):
        alone = rows
        for free, others in rights:
            keys = [v for v in on if v not in unbound and v not in free]
            # rows that bind all that is shared meet few others
            met = _meeting(rows, others, keys) if unbound or free else rows.join(others, _equal(keys))
            parts.append(met.select(*(F.col(f"_{c}").alias(c) if c in unbound else F.col(c) for c in left.columns), *own))
            if keys:
                alone = alone.join(others, _equal(keys), "left_anti")
            elif not others.isEmpty():
                alone = alone.where(F.lit(False))
        kinds = {f.name: f.dataType for f in right.schema}
        parts.append(alone.select(*left.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in own)))
    return reduce(DataFrame.unionByName, parts)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variables of either side; missing ones are unbound."""
    return a.unionByName(b, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame, nullable: tuple[str, ...] = (), nullable_right: tuple[str, ...] = ()) -> DataFrame:
    """Without rows that have a compatible right row with which they bind a variable in common.

    Variables in ``nullable`` may be unbound on the left, in ``nullable_right`` on the right. Nothing goes if no variable is shared.
    """
    on = shared(a, b)
    ln, rn = [v for v in on if v in nullable], [v for v in on if v in nullable_right]
    parts = []
    for unbound, rows in _masks(a, ln):
        for free, others in _masks(b, rn):
            keys = [v for v in on if v not in unbound and v not in free]
            rows = rows.join(others, keys, "left_anti") if keys else rows
        parts.append(rows.select(*a.columns))
    return reduce(DataFrame.unionByName, parts)


def where_num(df: DataFrame, col: str, op: str, x: float) -> DataFrame:
    """Numeric comparison; values that are no numbers drop out."""
    return df.where(F.expr(f"try_cast(`{col}` as double) {op} {float(x)!r}"))


def where_lexical(df: DataFrame, col: str, low: str, high: str) -> DataFrame:
    """Low <= value < high as texts."""
    return df.where((F.col(col) >= low) & (F.col(col) < high))


def where_in(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """P10."""
    return df.where(F.col(col).isin(values))


def where_regex(df: DataFrame, col: str, pattern: str, flags: str = "") -> DataFrame:
    """P11."""
    return df.where(F.col(col).rlike(f"(?{flags}){pattern}" if flags else pattern))


def where_ucase(df: DataFrame, col: str, value: str) -> DataFrame:
    """UCASE(STR(?col)) = value."""
    return df.where(F.upper(col) == value)


def datatype_of(g: DataFrame, p: str) -> DataFrame:
    """Subject, object and its datatype."""
    return g.where(F.col("p") == p).select("s", "o", F.col("o_datatype").alias("datatype"))


def bind(df: DataFrame, name: str, value) -> DataFrame:
    """P14."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def project(df: DataFrame, variables: list[str], distinct: bool = False) -> DataFrame:
    """P15."""
    return df.select(*variables).distinct() if distinct else df.select(*variables)


def group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Groups with named aggregates; HAVING is a where() after it."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))


def number(col: str) -> Column:
    return F.expr(f"try_cast(`{col}` as double)")


def sample(col: str) -> Column:
    """Any value; the smallest, so that reruns agree."""
    return F.min(col)


def group_concat(col: str, sep: str = " ", distinct: bool = False) -> Column:
    """P20: values in ascending order."""
    return F.expr(f"listagg({'distinct ' if distinct else ''}`{col}`, '{sep}') within group (order by `{col}`)")


def order(df: DataFrame, *keys) -> DataFrame:
    """P23."""
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys) -> DataFrame:
    """The first n; give a last key that breaks ties."""
    return df.orderBy(*keys).limit(n)


def preview(df: DataFrame, n: int = 10, width: int = 200) -> DataFrame:
    """At most ten rows, values cut."""
    return df.limit(max(1, min(n, 10))).select(*(F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns))


def ask(df: DataFrame) -> DataFrame:
    """One row: is there a solution?"""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def federate(query: Callable[[DataFrame], DataFrame], graphs: dict[str, DataFrame]) -> DataFrame:
    """One query on several graphs, tagged, without duplicates and rows that are all unbound."""
    parts = [query(g).withColumn("dataset", F.lit(name)) for name, g in graphs.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.dropna("all", subset=[c for c in out.columns if c != "dataset"]).distinct()


def datasets_for(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """(dataset, prefix) whose namespace a term (column term) has."""
    owned = terms.select("term", namespace(F.col("term")).alias("prefix")).join(small(registry), "prefix")
    return owned.groupBy("dataset").agg(F.count_distinct("term").alias("n_terms"))


def predicate_counts(g: DataFrame) -> DataFrame:
    """P30."""
    return g.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def class_counts(g: DataFrame) -> DataFrame:
    """P31."""
    return g.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("n"))


class Steps:
    """Named intermediate results, joins with a check of their keys, and functions of all results."""

    def __init__(self) -> None:
        self.results: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> Steps:
        self.results[name] = df
        return self

    def join(self, name: str, a: str, b: str, key: str, how: str = "inner") -> Steps:
        for side in (a, b):
            if key not in self.results[side].columns:
                raise ValueError(f"{side} has no column {key}")
        return self.add(name, self.results[a].join(self.results[b], key, how))

    def apply(self, name: str, fn: Callable[[dict[str, DataFrame]], DataFrame]) -> Steps:
        return self.add(name, fn(self.results))
