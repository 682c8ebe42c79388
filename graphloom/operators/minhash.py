"""Similar values by banded MinHash over letter trigrams.

A signature has ``hashes`` numbers, each the smallest of one hash function over the value's trigrams. Bands of ``rows`` numbers
make buckets; a pair that shares a bucket is a candidate and is compared by its signatures, or exactly. Buckets of very many values
are split: both sides of a band are dealt over as many parts, so that no task holds a whole bucket of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.substrings import grams

HASHES = 100


def shingles(c: str) -> Column:
    """Distinct trigrams in lower case; a shorter value is one shingle."""
    low = F.lower(F.col(c))
    return F.when(F.length(low) >= 3, grams(low)).otherwise(F.array(low))


def signature(c: Column, hashes: int = HASHES) -> Column:
    """For each of ``hashes`` functions the smallest hash of the array's items."""
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.array_min(F.transform(c, lambda g: F.xxhash64(g, i))))


def _banded(df: DataFrame, rows: int) -> DataFrame:
    bands = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("sig") - 1) / rows).cast("int")),
        lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", b * rows + 1, F.lit(rows))).alias("bucket"))
    )
    return df.withColumn("key", F.explode(bands))


def similar_values(
    values: DataFrame, keywords: DataFrame, n: int = 10, hashes: int = HASHES, rows: int = 1, exact: bool = False
) -> DataFrame:
    """(keyword, value, jaccard, rank): for each keyword the ``n`` most similar values (value), estimated from signatures.

    A pair of Jaccard J is met with a chance of 1 - (1 - J**rows) ** (hashes / rows): with rows = 1 and 100 hashes 0.99 from
    J = 0.045 on. ``exact`` ranks the candidates by their trigrams instead of the share of equal signature numbers. Ties go to
    the smaller value. Null and empty values and keywords are left out, equal ones count once.
    """
    own = values.select("value").where("value <> ''").distinct().withColumn("grams", shingles("value")).withColumn(
        "sig", signature(F.col("grams"), hashes)
    )
    asked = keywords.select("keyword").where("keyword <> ''").distinct().withColumn("_grams", shingles("keyword")).withColumn(
        "sig", signature(F.col("_grams"), hashes)
    )
    left = _banded(own.select("value", "sig"), rows).select("value", "key")
    right = _banded(asked.select("keyword", "sig"), rows).select("keyword", "key")
    shared = left.join(right, "key").groupBy("keyword", "value").agg(F.count(F.lit(1)).alias("same"))
    if exact:
        met = shared.join(own.select("value", "grams"), "value").join(asked.select("keyword", "_grams"), "keyword")
        both = F.size(F.array_intersect("grams", "_grams"))
        scored = met.select("keyword", "value", (both / (F.size("grams") + F.size("_grams") - both)).alias("jaccard"))
    elif rows == 1:
        scored = shared.select("keyword", "value", (F.col("same") / hashes).alias("jaccard"))
    else:
        met = shared.join(own.select("value", "sig"), "value").join(asked.select("keyword", F.col("sig").alias("_sig")), "keyword")
        equal = F.size(F.filter(F.arrays_zip("sig", "_sig"), lambda z: z["sig"] == z["_sig"]))
        scored = met.select("keyword", "value", (equal / hashes).alias("jaccard"))
    order = Window.partitionBy("keyword").orderBy(F.desc("jaccard"), "value")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def exact_similar_values(values: DataFrame, keywords: DataFrame, n: int = 10) -> DataFrame:
    """The same from all pairs that share a trigram: the exact way, to measure recall against."""
    left = values.select("value").where("value <> ''").distinct().select(
        "value", F.size(shingles("value")).alias("k"), F.explode(shingles("value")).alias("gram")
    )
    right = keywords.select("keyword").where("keyword <> ''").distinct().select(
        "keyword", F.size(shingles("keyword")).alias("m"), F.explode(shingles("keyword")).alias("gram")
    )
    met = left.join(right, "gram").groupBy("keyword", "value", "k", "m").agg(F.count(F.lit(1)).alias("both"))
    scored = met.select("keyword", "value", (F.col("both") / (F.col("k") + F.col("m") - F.col("both"))).alias("jaccard"))
    order = Window.partitionBy("keyword").orderBy(F.desc("jaccard"), "value")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
