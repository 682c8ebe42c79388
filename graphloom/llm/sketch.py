"""Bottom-k sketches of shingle hashes: mergeable, for resemblance, containment and distinct counts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm.words import distinct_per_row, shingle_hashes, text_slices, word_hashes

K = 128
SHINGLE = 5
SPACE = float(1 << 64)


def sketch_texts(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        row, h = distinct_per_row(*shingle_hashes(*word_hashes(data, offsets), shingle))
        edges = np.searchsorted(row, np.arange(len(offsets)))
        out += [h[a : min(b, a + k)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard estimate: the share of the union's bottom k that both have. Equal sketches: 1."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8").astype(np.uint64)


def merge_sketches(sketches: DataFrame, key: str, sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint): one sketch a key from those of its parts. Merged within partitions first, so a hot key sends one row a task."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for value, group in frame.groupby("key", dropna=False):
            total = np.zeros(0, np.uint64)
            for s in group["sketch"]:
                total = merged(total, from_text(s), k)
            rows.append((value, to_text(total)))
        return pd.DataFrame(rows, columns=["key", "sketch"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            kept = fold(frame if kept is None else pd.concat([kept, frame]))
        if kept is not None:
            yield kept

    rows = sketches.select(F.col(key).alias("key"), F.col(sketch_col).alias("sketch"))
    parts = rows.mapInPandas(partial, rows.schema)
    return parts.groupBy("key").applyInPandas(fold, rows.schema).toDF(key, sketch_col)


def fingerprints(docs: DataFrame, *, k: int = K, shingle: int = SHINGLE, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or
    all) of the next document by ascending id (then text; null ids first), the last by those of
    the first. Texts are dealt once by ranges of the id; a range's first document is also sent to
    the range before it, so no task needs more than its own rows. Null texts are empty; an empty
    sketch is like an empty one (1) and unlike any other (0). Ids are integers. A table of one row
    is its own next. ``parts`` ranges (default: spark.sql.shuffle.partitions) are the only thing collected.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))))
    bounds = rows.agg(F.percentile_approx("k", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(max(10_000, 10 * parts)))).first()[0] if parts > 1 else []
    edges = np.unique(np.array(bounds or [], np.int64))

    @pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="left").astype(np.int32))

    firsts = sorted((r["part"], r["k"]) for r in rows.select("k").withColumn("part", part_of("k")).groupBy("part").agg(F.min("k").alias("k")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}

    @pandas_udf("array<int>")
    def deals(key: pd.Series) -> pd.Series:
        # part * 2, or part * 2 + 1 for the copy that only ends a range
        own = np.searchsorted(edges, key.to_numpy(), side="left")
        return pd.Series([[2 * p, 2 * before[x] + 1] if x in before else [2 * p] for p, x in zip(own.tolist(), key.tolist(), strict=True)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document, which waits for its next
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                piece = batch.slice(first, 128)
                deal, ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist()
                done, now = [], list(zip(deal, ids, texts, sketch_texts(texts, k, shingle), strict=True))
                for row in now:
                    if held is not None and held[0] // 2 == row[0] // 2 and not held[0] % 2:
                        done.append((held, row))
                        held = row
                    elif held is None or held[0] // 2 != row[0] // 2:
                        held = row
                if done:
                    yield finish(done)

    def finish(done: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        edited = [a[2][: len(a[2]) - len(a[2]) // 4] + b[2][: len(a[2]) // 4] for a, b in done]
        marks = sketch_texts(edited, k, shingle)
        return pa.RecordBatch.from_pydict({
            "id": pa.array([a[1] for a, _ in done], pa.int64()),
            "n_chars": pa.array([len(a[2]) for a, _ in done], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [to_text(a[3]) for a, _ in done],
            "edited_fingerprint": [to_text(m) for m in marks],
            "near_edited": [resemblance(a[3], m, k) for (a, _), m in zip(done, marks, strict=True)],
            "near_next": [resemblance(a[3], b[3], k) for a, b in done],
            "distinct_shingles": [distinct_shingles(a[3], k) for a, _ in done],
            "edited_containment": [containment(a[3], m, k) for (a, _), m in zip(done, marks, strict=True)],
        })

    dealt = rows.select(F.explode(deals("k")).alias("deal"), F.col("id").cast("long").alias("id"), "text", "k")
    placed = dealt.repartitionById(parts, F.shiftright("deal", 1)).sortWithinPartitions(F.shiftright("deal", 1), "deal", "k", "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_containment double"
    return placed.select("deal", "id", "text").mapInArrow(walk, schema).withColumnRenamed("id", id_col)
