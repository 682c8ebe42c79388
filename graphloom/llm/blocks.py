"""Texts in compressed blocks that stay where they are while questions and answers about them travel.

An operator that must look up something for every word of a corpus packs the documents into blocks once,
dealt by block number and checkpointed. A later join on the number shuffles only the answers, as the
checkpoint keeps its partitioning. A block's questions are sorted 64-bit keys; each key's bucket is a range
of the key space, so a bucket sees every block's share of its range, once for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, observed, shared_folder
from graphloom.llm.words import U, text_slices

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stable(df: DataFrame) -> DataFrame:
    """``df``, cut first if it stands behind a shuffle: its rows could come in another order when a task is repeated."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def packed(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict]:
    """((block, body), {n: blocks, bytes: of text}): all rows of ``docs``, whose other columns come along."""
    at = docs.columns.index(text_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(at), BLOCK_BYTES):
                body = _to_bytes(batch.slice(first, len(offsets) - 1))
                yield pa.RecordBatch.from_pydict({"block": [number], "bytes": [len(data)], "body": pa.array([body], pa.binary())})
                number += 1

    rows = stable(docs).mapInArrow(pack, "block long, bytes long, body binary")
    dealt = rows.repartition(partitions(docs), "block").sortWithinPartitions("block")
    return observed(dealt, bytes=F.coalesce(F.sum("bytes"), F.lit(0)))


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes, text_at: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """A block's rows, and its texts as bytes and offsets."""
    batch = pa.ipc.open_stream(body).read_next_batch()
    _, data, offsets = next(text_slices(batch.column(text_at), 1 << 62))
    return batch, data, offsets


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit integers compressed, as differences if they ascend."""
    v = values.astype(U)
    if ascending and len(v):
        v[1:] = v[1:] - v[:-1].copy()
    return _zip.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(body: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(_unzip.decompress(body), np.uint8).reshape(8, -1)
    v = np.ascontiguousarray(planes.T).view(U).ravel()
    return np.cumsum(v, dtype=U) if ascending else v


def bits(*masks: np.ndarray) -> bytes:
    return _zip.compress(np.concatenate([np.packbits(m) for m in masks]).tobytes())


def unbits(body: bytes, n: int, masks: int) -> list[np.ndarray]:
    raw = np.frombuffer(_unzip.decompress(body), np.uint8).reshape(masks, -1)
    return [np.unpackbits(r, count=n).astype(bool) for r in raw]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table beside the checkpoints: narrow rows in columns take less than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted ``keys`` that fall into each bucket; a key's bucket depends on its top 32 bits."""
    starts = np.array([(-(-(b << 32) // buckets)) << 32 for b in range(buckets)], U)
    edges = np.append(np.searchsorted(keys, starts), len(keys))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """(value, rows) for each run of equal values of the first column; the rows' other columns as tuples."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names if c != key]
        for value, *row in zip(batch.column(key).to_pylist(), *columns, strict=True):
            if value != now and rows:
                yield now, rows
                rows = []
            now = value
            rows.append(tuple(row))
    if rows:
        yield now, rows


def together(df: DataFrame, key: str, *then: str) -> DataFrame:
    """Rows of one value of ``key`` behind each other in one partition; values, which are numbers from 0, are dealt in turn."""
    return df.repartitionById(partitions(df), key).sortWithinPartitions(key, *then)


def with_answers(blocks: DataFrame, answers: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Blocks with an array of their answers' ``columns``, sorted; the blocks aren't shuffled.

    A block's answers are at most about as many as its words and the buckets.
    """
    got = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("answers"))
    return blocks.drop("bytes").join(got.hint("merge"), "block", how)
