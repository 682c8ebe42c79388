"""Joins of names by edit distance, on shared segments.

A name is cut into one segment more than the edits allowed. Whatever the edits, one segment stays whole in the other name, at
a place that is off by few letters, so pairs meet by (length, number and text of the segment). Names too short to be cut
meet by length; between those, almost any pair is within the distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segment(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """0-based start and size of segment ``i`` of edits + 1, the longer ones last."""
    m = edits + 1
    base = F.floor(length / m).cast("int")
    short = m - F.pmod(length, m)
    return i * base + F.greatest(F.lit(0), i - short), base + (i >= short).cast("int")


def _segments(y: Column, edits: Column) -> Column:
    def one(i: Column) -> Column:
        start, size = _segment(F.length(y), edits, i)
        return F.struct(F.length(y).cast("int").alias("length"), i.cast("int").alias("i"), F.substring(y, start + 1, size).alias("part"))

    return F.transform(F.sequence(F.lit(0), edits), one)


def _probes(x: Column, length: Column, edits: Column) -> Column:
    """The parts of ``x`` that a segment of a name of ``length`` can be, by number of edits before and after it."""

    def of(i: Column) -> Column:
        start, size = _segment(length, edits, i)
        off, after = F.length(x) - length, edits - i
        low = F.greatest(F.lit(0), start - i, start + off - after)
        high = F.least(F.length(x) - size, start + i, start + off + after)
        places = F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda s: F.struct(length.cast("int").alias("length"), i.cast("int").alias("i"), F.substring(x, s + 1, size).alias("part"))
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), edits), of))


def candidates(
    a: DataFrame, b: DataFrame, x: str, y: str, edits: Callable[[Column], Column], longest: Callable[[Column], Column]
) -> DataFrame:
    """Distinct pairs of rows of ``a`` (with text ``x``) and ``b`` (with text ``y``) that may be within so many edits of each other.

    ``edits`` gives the edits for the length of y, and must not fall as it grows; ``longest`` is the greatest length of y that
    a length of x can meet. Null texts meet nothing. Column names of both sides must differ.
    """
    n = F.length(x)
    lengths = F.sequence(F.greatest(F.lit(0), n - edits(n).cast("int")).cast("int"), longest(n).cast("int"))
    key = lambda length, i, part: F.struct(length.cast("int").alias("length"), i.cast("int").alias("i"), part.alias("part"))
    short = lambda length: F.array(key(length, F.lit(-1), F.lit("")))

    def of(length: Column) -> Column:
        e = edits(length).cast("int")
        none = F.array().cast("array<struct<length: int, i: int, part: string>>")
        return F.when(F.abs(n - length) > e, none).when(length <= e, short(length)).otherwise(_probes(F.col(x), length, e))

    asked = a.where(F.col(x).isNotNull()).withColumn("_key", F.explode(F.array_distinct(F.flatten(F.transform(lengths, of)))))
    m, e = F.length(y), edits(F.length(y)).cast("int")
    known = b.where(F.col(y).isNotNull()).withColumn("_key", F.explode(F.when(m <= e, short(m)).otherwise(_segments(F.col(y), e))))
    return asked.join(known, "_key").drop("_key").distinct()


def within(a: DataFrame, b: DataFrame, x: str, y: str, most: int) -> DataFrame:
    """Pairs whose texts are within ``most`` edits, with their ``distance``."""
    met = candidates(a, b, x, y, lambda _: F.lit(most), lambda n: n + most)
    return met.where(F.levenshtein(x, y, most) >= 0).withColumn("distance", F.levenshtein(x, y))
