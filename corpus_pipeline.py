"""A corpus pipeline: classify, join near duplicates, redact secrets, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Null texts count as empty, repeated rows are rows of their
own except that near-duplicate stages keep one, and empty tables give empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, mixing, packing, quality, secrets
from graphloom.llm.common import cut, free, shared_folder, small, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own text. All labels whose crc32(id) mod 3 is not 1 are learnt."""
    weights, threshold = quality.fit(quality.training_labels(docs), quality.training_labels(table(spark, sf_dir, "labels")))
    predicted = free(docs.columns, "predicted")
    kept = quality.judged(docs, weights, threshold, predicted_col=predicted).where(F.col(predicted) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (five words, 0.8); equal rows of one id and text, or of a text without an id, once."""
    groups = jaccard.join_components(docs, shingle=5, percent=80)
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(small(gone), "doc_id", "left_anti")
    again = small(cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")))
    repeated = named.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    kept = named.join(again, "doc_id", "left_anti").unionByName(repeated).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Fitting, hashing and tokenizing are not expressible in SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written beside the checkpoints and read again.

    A stage's folder is removed when the next one's is written; the last one stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                _remove(spark, before)
            before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
