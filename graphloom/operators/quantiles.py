"""Exact quantiles of groups without an aggregate that holds a group's values.

A quantile is one or two order statistics. While the cell that holds one has more than ``limit`` rows, it is parted by
borders from a sketch of bounded size. A border value is a cell of its own, so that a value of very many rows is found
by counting; between borders a cell has a small share of the rows. Counts of the parts tell which one holds the wanted
rank. Only the last, small cells are sorted. All of it is joins and sums by group, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sizes import cut, small

#: Rows of a cell that one task may sort, and the parts of a larger one.
LIMIT, WAYS = 100_000, 64


def expanded(rows: DataFrame, sets: list[list[str]], others: list[str]) -> DataFrame:
    """``rows`` once for each grouping set, with ``_set`` (its number) and null for the keys that it leaves out."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = {f.name: f.dataType for f in rows.schema}
    each = [
        F.struct(F.lit(i).alias("_set"), *(F.col(k) if k in s else F.lit(None).cast(kinds[k]).alias(k) for k in keys)) for i,
        s in enumerate(sets)
    ]
    return rows.select(F.explode(F.array(*each)).alias("_keys"), *others).select("_keys.*", *others)


def _inside(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of each cell (g, lo, hi): those of its group strictly between its borders; a null border is none."""
    c = cells.select(F.col("g").alias("_g"), "lo", "hi")
    within = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    return rows.join(small(c), rows["g"].eqNullSafe(c["_g"]) & within).select(F.struct("g", "lo", "hi").alias("cell"), "v")


def order_statistics(rows: DataFrame, wanted: DataFrame, limit: int = LIMIT, ways: int = WAYS) -> DataFrame:
    """(g, rank, v): the value of each 0-based rank; rows are (g, v) without null values, wanted is (g, n, rank), n being the group's rows."""
    targets = wanted.select(
        "g", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("rank").alias("at"), "rank",
        F.col("n").alias("m")
    )
    found = []
    while True:
        targets = cut(targets)
        large = targets.where(F.col("m") > limit)
        if large.isEmpty():
            break
        inside = _inside(rows, large.select("g", "lo", "hi").distinct())
        grid = F.array(*(F.lit((i + 1) / ways) for i in range(ways - 1)))
        borders = cut(
            inside.groupBy("cell").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", grid, F.lit(ways * 50)))).alias("b"))
        )
        known = small(borders.withColumnRenamed("cell", "_cell"))
        below = F.size(F.filter("b", lambda x: x < F.col("v")))
        placed = inside.join(known, inside["cell"].eqNullSafe(known["_cell"])).select(
            "cell", (2 * below + F.array_contains("b", F.col("v")).cast("int")).alias("place")
        )
        counts = placed.groupBy("cell", "place").agg(F.count(F.lit(1)).alias("k"))
        up_to = F.sum("k").over(Window.partitionBy("cell").orderBy("place"))
        counts = counts.withColumn("before", up_to - F.col("k")).withColumnRenamed("cell", "_cell")
        parts = counts.join(borders, counts["_cell"].eqNullSafe(borders["cell"])).select("_cell", "place", "k", "before", "b")
        own = large.withColumn("cell", F.struct("g", "lo", "hi"))
        met = own.join(
            parts, own["cell"].eqNullSafe(parts["_cell"]) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("k"))
        )
        met = cut(met.select("g", "lo", "hi", "rank", "at", "place", "k", "before", "b"))
        found.append(met.where("place % 2 = 1").select("g", "rank", F.get("b", F.expr("place div 2").cast("int")).alias("v")))
        half = F.expr("place div 2").cast("int")
        lo, hi = F.coalesce(F.get("b", half - 1), "lo"), F.coalesce(F.get("b", half), "hi")
        open_ = met.where("place % 2 = 0").select(
            "g", lo.alias("lo"), hi.alias("hi"), (F.col("at") - F.col("before")).alias("at"), "rank", F.col("k").alias("m")
        )
        targets = targets.where(F.col("m") <= limit).unionByName(open_)
    last = _inside(rows, targets.select("g", "lo", "hi").distinct())
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("v")) - 1).withColumnRenamed("cell", "_cell")
    own = targets.withColumn("cell", F.struct("g", "lo", "hi"))
    found.append(own.join(ranked, own["cell"].eqNullSafe(ranked["_cell"]) & (F.col("at") == F.col("r"))).select("g", "rank", "v"))
    return reduce(DataFrame.unionByName, found)


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("n") - 1)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, named: dict[str, float], limit: int = LIMIT, ways: int = WAYS) -> DataFrame:
    """``by``, n and each quantile of ``named`` {name: share}, interpolated linearly between the two ranks beside it.

    Null values are left out, a group of nulls only has no row; null keys are a group. Not-a-number is the largest.
    """
    r = rows.select(F.struct(*by, F.lit(0).alias("_")).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    sizes = cut(r.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    both = [f(_position(p)).cast("long") for p in named.values() for f in (F.floor, F.ceil)]
    wanted = sizes.select("g", "n", F.explode(F.array_distinct(F.array(*both))).alias("rank"))
    stats = order_statistics(r, wanted, limit, ways).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    met = sizes.withColumnRenamed("g", "_g").join(stats, F.col("_g").eqNullSafe(F.col("g")))

    def quantile(p: float) -> Column:
        pos = _position(p)
        low, high = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        of = lambda rank: F.element_at("at", rank)
        return F.when(low == high, of(low)).otherwise((high - pos) * of(low) + (pos - low) * of(high))

    return met.select(*(F.col(f"g.{k}").alias(k) for k in by), "n", *(quantile(p).alias(name) for name, p in named.items()))
