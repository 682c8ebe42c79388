"""Substring search for many terms at once, by an inverted index of grams of four letters.

An index is three tables: texts with numbers, postings (gram, text_id) dealt by ranges of gram and text and sorted, and the
grams' counts. The postings of a term's rarest gram are the texts that may hold it; the text decides. Texts are indexed with
three end marks, so that a term of one to three letters is the beginning of some gram and needs no scan either. Letters are
compared in lower case. What is sorted or told apart in one task has PART_ROWS rows or so, as parts grow in number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sizes import cut, parts, small

#: Letters of a gram.
SIZE = 4
END = "\x00" * (SIZE - 1)


def grams(text: Column, size: int = 3) -> Column:
    """The distinct grams of a text; none if it is shorter."""
    last = F.length(text) - (size - 1)
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))
    ).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SubstringIndex:
    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def build_index(texts: DataFrame, path: str, text_col: str = "text") -> SubstringIndex:
    """Writes the index of all distinct non-null texts under ``path``. A text is one row a gram, never gathered."""
    spark = texts.sparkSession
    own = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    own.withColumn("text_id", F.monotonically_increasing_id()).write.parquet(f"{path}/texts")
    numbered = spark.read.parquet(f"{path}/texts")
    # a text has as many grams as letters, at most; texts are dealt first, as a task holds the grams that it deals
    n = parts(numbered.agg(F.sum(F.length("text"))).first()[0] or 0)
    each = numbered.repartition(n, "text_id").select(F.explode(grams(F.concat(F.lower("text"), F.lit(END)), SIZE)).alias("gram"), "text_id")
    each.repartitionByRange(n, "gram", "text_id").sortWithinPartitions("gram", "text_id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SubstringIndex:
    return SubstringIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("texts", "postings", "counts")))


def search(index: SubstringIndex, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, text): the indexed texts that contain each distinct term, in any case. Null and empty terms have none.

    Columns that ``index.texts`` has besides follow.
    """
    own = terms.select(F.col(f"`{term_col}`").cast("string").alias("term")).where("term <> ''").distinct()
    own = own.withColumn("low", F.lower("term"))
    all_grams = grams(F.col("low"), SIZE)
    long = own.where(F.length("low") >= SIZE).select("term", F.explode(all_grams).alias("gram"), F.size(all_grams).alias("all"))
    by_term = Window.partitionBy("term")
    known = long.join(index.counts, "gram").withColumn("found", F.count(F.lit(1)).over(by_term)).withColumn(
        "r", F.row_number().over(by_term.orderBy("n", "gram"))
    )
    # a term with a gram that no text has is in none
    rarest = known.where((F.col("found") == F.col("all")) & (F.col("r") == 1)).select("term", "gram", "n", F.lit(False).alias("several"))
    beginnings = [
        own.where(F.length("low") == k).select("term", F.col("low").alias("_begins")).join(
            index.counts.select("gram", "n", F.substring("gram", 1, k).alias("_begins")), "_begins"
        ).select("term", "gram", "n", F.lit(True).alias("several"))
        for k in range(1, SIZE)
    ]
    asked = cut(reduce(DataFrame.unionByName, beginnings, rarest))
    sizes = dict(asked.groupBy("several").agg(F.sum("n")).collect())
    texts = index.texts.withColumn("_low", F.lower("text")).hint("merge")
    columns = [c for c in index.texts.columns if c != "text_id"]

    def found(several: bool) -> DataFrame:
        own = small(asked.where(F.col("several") == several).select("term", "gram"))
        met = own.join(index.postings, "gram").select("term", "text_id").repartition(parts(sizes.get(several, 0)), "text_id")
        # a text may have several of the grams that a short term begins
        met = met.distinct() if several else met
        return met.join(texts, "text_id").where(F.contains("_low", F.lower("term"))).select("term", *columns)

    return found(False).unionByName(found(True)) if True in sizes else found(False)
