"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

A document of label 1 is preferred to one of label 0. The score is linear in
features of the text; it is fitted by logistic loss on feature differences, and the
threshold is the quantile of the fitting documents' scores at label 0's share. All labelled
documents are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from graphloom.llm.common import crc_bucket, cut, free, ordered_rank, small, text_batches
from graphloom.llm.words import distinct_per_row, shingle_hashes, text_slices, word_hashes

#: Classes of bytes; each gives the root of its share of a text's bytes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" ", "line": b"\n",
    "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "bar": b"|", "symbol": b"#$%&*@^~", "markup": b"<>=/\\{}[]", "quote": b"\"'`", "dash": b"-_", "other_mark": b":;()+",
}
NAMES = (*CLASSES, "other", "log_words", "word_length", "distinct_words", "top_word", "distinct_triples")
#: Rows of features that may be broadcast (170 bytes each): with fewer of a label there are few buckets, so its rows are sent to the others.
BROADCAST_FEATURES = 20_000
#: Pairs in a partition while the weights are fitted (180 bytes each).
PAIRS = 16_384
_class_of = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _class_of[list(_bytes)] = _k


def slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text of a slice; an empty text's are all 0."""
    n, k = len(offsets) - 1, len(CLASSES) + 1
    size = np.diff(offsets)
    at = np.repeat(np.arange(n), size)
    share = np.bincount(at * k + _class_of[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    row, words = word_hashes(data, offsets)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    order = np.lexsort((words, row))
    r, w = row[order], words[order]
    edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])))) if len(r) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, r[edge], np.diff(np.append(edge, len(r))))
    t_row, triples = shingle_hashes(row, words, 3)
    t_some = np.maximum(np.bincount(t_row, minlength=n), 1)
    t_own = np.bincount(distinct_per_row(t_row, triples)[0], minlength=n)
    letters = size - np.bincount(at[(data == 32) | (data == 10)], minlength=n)
    own = np.bincount(r[edge], minlength=n)
    more = np.stack([np.log1p(count) / 5, np.minimum(letters / some, 40) / 10, own / some, np.sqrt(top / some), t_own / t_some], 1)
    return np.concatenate([np.sqrt(share), more], 1)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every row, computed by the text alone."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                x = slice_features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), lists], ["id", "features"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, reg: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[float], float]:
    """(weights, threshold) from all labelled rows, held-out ones already left out by the caller.

    Without both labels the weights are 0, so every document scores 0.5 and is accepted.
    """
    text_batches(docs.sparkSession)
    return fit_features(with_features(docs, id_col, text_col), labels, reg=reg, id_col=id_col, label_col=label_col)


def fit_features(features: DataFrame, labels: DataFrame, *, reg: float = 1e-4, id_col: str = "doc_id", label_col: str = "quality") -> tuple[list[float], float]:
    """What ``fit`` does, from the rows (id, features) of ``with_features``; of an id's rows the one of smallest features counts.

    Only narrow rows are shuffled. A document meets documents of the other label, about as many as there are on the larger side for
    each on the smaller one, so there are about as many pairs as documents.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    learnt = cut(features.join(small(known), "id").groupBy("id", "label").agg(F.min("features").alias("features")))
    counts = {r["label"]: r["n"] for r in learnt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [0.0] * len(NAMES), 0.0
    # a bucket has about two documents of the rarer label, each of the other label is in one bucket
    buckets = max(1, min(counts.values()) // 2)
    rarer = F.broadcast if min(counts.values()) <= BROADCAST_FEATURES else lambda df: df
    side = learnt.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(buckets)))
    good = side.where("label = 1").select("bucket", F.col("id").alias("good"), F.col("features").alias("x"))
    bad = side.where("label = 0").select("bucket", F.col("id").alias("bad"), F.col("features").alias("y"))
    sign = F.when(F.pmod(F.xxhash64("good", "bad"), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    met = rarer(good).join(bad, "bucket") if counts[1.0] <= counts[0.0] else good.join(rarer(bad), "bucket")
    pairs = met.withColumn("sign", sign)
    difference = F.transform(F.arrays_zip("x", "y"), lambda z: (z["x"] - z["y"]) * F.col("sign"))
    pairs = pairs.select(array_to_vector(difference).alias("features"), F.greatest("sign", F.lit(0.0)).alias("label"))
    # each iteration is a job over all pairs, so their partitions follow their number and not that of the documents' files or shuffles
    pairs = pairs.coalesce(1 + max(counts.values()) // PAIRS)
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=60).fit(pairs)
    weights = [float(w) for w in model.coefficients]
    share = counts[0.0] / (counts[0.0] + counts[1.0])
    return weights, _quantile(learnt.select(linear("features", weights).alias("s")), share, sum(counts.values()))


def _quantile(scores: DataFrame, share: float, n: int) -> float:
    """The exact quantile of n scores (s), linear between the two ranks beside it; no task holds them all."""
    at = share * (n - 1)
    low = int(at)
    found = ordered_rank(scores, ["s"]).where(F.col("rank").isin(low, min(low + 1, n - 1))).collect()  # one or two rows
    value = {r["rank"]: r["s"] for r in found}
    return value[low] + (at - low) * (value[min(low + 1, n - 1)] - value[low])


def linear(features: str, weights: list[float]):
    terms = [F.col(features)[i] * F.lit(w) for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def score(docs: DataFrame, weights: list[float], threshold: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: the chance to beat a document at the threshold, and whether it is 0.5 or more.

    Null and empty texts get the score of zero features; repeated rows and null ids stay.
    """
    return score_features(with_features(docs, id_col, text_col), weights, threshold, id_col=id_col)


def score_features(features: DataFrame, weights: list[float], threshold: float, *, id_col: str = "doc_id") -> DataFrame:
    """What ``score`` does, from the rows (id, features) of ``with_features``."""
    s = 1 / (1 + F.exp(-(linear("features", weights) - F.lit(threshold))))
    rows = features.select(F.col("id").alias(id_col), s.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def judged(docs: DataFrame, weights: list[float], threshold: float, *, text_col: str = "text", predicted_col: str = "predicted") -> DataFrame:
    """``docs``, each row with ``predicted_col``: 1 if its own text is accepted, else 0. Rows keep their partition; nothing is shuffled."""
    text_batches(docs.sparkSession)
    name = free(docs.columns, "features")
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(text_at)):
                x = slice_features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(x)).columns, lists], [*batch.schema.names, name])

    accepted = linear(f"`{name}`", weights) >= F.lit(threshold)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != predicted_col.lower()]
    return docs.mapInArrow(run, schema).select(*kept, accepted.cast("int").alias(predicted_col))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learnt, of labels or documents: those whose crc32(id as text) mod 3 is not 1."""
    return labels.where(crc_bucket(F.col(id_col), 3) != 1)
