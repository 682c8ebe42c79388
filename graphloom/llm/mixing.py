"""Mixing of sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, free, ordered_rank, small

#: What ``repetition`` adds.
ADDED = ("size", "source_size", "target", "copies")


def source_targets(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` times
    all sizes; no target exceeds ``most`` times its source's size, and what is cut off is
    shared anew by weight among the others until none is above. Each round is one aggregate.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    ranked = ordered_rank(sizes, [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while total:
        above = F.col("most") <= F.lit(unit) * F.col("weight")
        held, free, n = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if free is None or n == capped:
            break
        unit, capped = (share * total - held) / free, n
    target = F.least(F.col("most"), F.lit(unit) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def repetition(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", added: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` with size, source_size, target and copies: floor(rate) plus one by a seeded coin.

    The coin depends on the seed, the id and the text, so reruns and other partitionings agree;
    equal rows get equal copies. A null text has size 0; a null source is a source of its own.
    Columns of ``docs`` named like ``added`` are replaced, all others stay.
    """
    size, source_size, target, copied = added
    sized = docs.drop(*added).withColumn(size, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    targets = source_targets(sized.select(F.col(source_col).alias("source"), F.col(size).alias("size")), weights=weights, share=share, most=most)
    source = free([*docs.columns, *added], "_source")
    keyed = small(targets).select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    coin = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = (F.floor(rate) + (coin < rate - F.floor(rate)).cast("int")).cast("long")
    return sized.join(keyed, F.col(source_col).eqNullSafe(F.col(source)), "left").drop(source).withColumn(copied, copies)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Every document as often as it is to be repeated, with the columns of ``docs``."""
    added = tuple(free(docs.columns, c) for c in ADDED)
    repeated = repetition(docs, **settings, added=added).where(F.col(added[-1]) > 0)
    copy = free(repeated.columns, "_copy")
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(added[-1])))).select(*(F.col(f"`{c}`") for c in docs.columns))
