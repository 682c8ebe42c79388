"""Removal of long repeated word sequences, by compacting a de Bruijn graph of the corpus.

Nodes are runs of k - 1 words, edges are windows of k words. Only edges that may be repeated enter the graph: each
window's seed, the run of fewer words in it that has the smallest hash, must be in two documents. A node is repeated if two documents have it and it
branches if its neighbours (the word before and the word after, or a document's border) are not everywhere the
same. Between branching nodes, repeated edges form paths that every document either has from end to end or not at
all. So documents are cut into paths at branching nodes, and a path is known by its first edge. Spark joins each
occurrence to the path's source, its place in the document of the smallest id; the words at both places are
compared by length and an independent hash, and only what agrees is a repeat.

Nodes travel as hashes, with fewer bits for the neighbours. If two different nodes share a hash, a path is cut once
more everywhere, which changes nothing. If different neighbours share theirs, a branch is missed: paths of different
words then begin or end with the same edge. Those are found, and their windows are compared one by one. A repeat
is lost only where two branches are missed at once, at both ends of a shared path: with b node bits about one path in
2**(126 - 2 * b), which is 2**48 on a gigabyte and 2**30 on 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import blocks as B
from graphloom.llm.common import cut, observed
from graphloom.llm.words import U, mix, sequence_hash, sequence_sums, span_hashes, word_spans

BEFORE, AFTER, OTHER = U(0x2545F4914F6CDD1D), U(0x8BB84B93962EACC9), U(0x5851F42D4C957F2D)
#: A bucket's nodes, about.
BUCKET_NODES = 1 << 20
#: Shorter runs in a window; the one of the smallest hash is its seed.
SEED_PLACES = 6


class BlockWords:
    """A block's words, their hashes, and its edges: the windows of k words."""

    def __init__(self, body: bytes, k: int):
        self.batch, self.data, offsets = B.unpacked(body, 1)
        self.k = k
        self.s, self.e, self.row = word_spans(self.data, offsets)
        self.first = np.searchsorted(self.row, np.arange(self.batch.num_rows + 1))
        self.words = span_hashes(self.data, self.s, self.e)
        self.sums = sequence_sums(self.words)
        n = len(self.words)
        self.edges = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :]) if n >= k else np.zeros(0, np.int64)

    def seeds(self, shift: int) -> np.ndarray:
        """For each edge the smallest hash of its shorter runs, hashed again; neighbouring edges mostly have the same one."""
        run = max(1, self.k - SEED_PLACES + 1)
        at = np.arange(max(len(self.words) - run + 1, 0))
        h = sequence_hash(self.sums, at, at + run)
        least = h[self.edges]
        for j in range(1, self.k - run + 1):
            np.minimum(least, h[self.edges + j], out=least)
        return mix(least) >> U(shift) << U(shift)

    def nodes(self, at: np.ndarray, shift: int) -> np.ndarray:
        """The hash of the k - 1 words from each place in the upper bits, its neighbours' in the lower ones; the lowest bit is 0."""
        m, n, s = self.k - 1, len(self.words), U(shift)
        before = np.where((at > 0) & (self.row[np.maximum(at - 1, 0)] == self.row[at]), self.words[np.maximum(at - 1, 0)], BEFORE)
        end = np.minimum(at + m, n - 1)
        after = np.where((at + m < n) & (self.row[end] == self.row[at]), self.words[end], AFTER)
        return sequence_hash(self.sums, at, at + m) >> s << s | (mix(before * OTHER + after) >> (U(64) - s) & ~U(1))

    def ends(self, got: list[dict], seed_shift: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(edges whose seed is repeated, the places where their nodes begin)."""
        v, first, place = distinct(self.seeds(seed_shift), self.row[self.edges], seed_shift)
        (repeated,) = _masks(v, first, got, buckets, 1)
        edges = self.edges[repeated[place]]
        return edges, np.union1d(edges, edges + 1)


def distinct(v: np.ndarray, row: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sorted; the first of each key's among them; each place's key number). A key is what ``shift`` leaves.

    The lowest bit is set where two rows of the block have the key.
    """
    order = np.argsort(v, kind="stable")
    v, row = v[order], row[order]
    key = v >> U(shift)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(v)]
    starts, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    place = np.empty(len(v), np.int64)
    place[order] = number
    if len(v):
        several = np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts)
        v = v | several[number].astype(U)
    keep = np.concatenate(([True], v[1:] != v[:-1]))[: len(v)]
    return v[keep], np.flatnonzero(fresh[keep]), place


def _masks(v: np.ndarray, first: np.ndarray, got: list[dict], buckets: int, n: int) -> list[np.ndarray]:
    """The answers for each key of a block, from those of its buckets."""
    of = {b: int(np.subtract(*np.searchsorted(first, [z, a]))) for b, a, z in B.by_bucket(v, buckets)}
    found = [B.unbits(g["answer"], of[g["bucket"]], n) for g in got]
    return [np.concatenate([m[i] for m in found]) if found else np.zeros(0, bool) for i in range(n)]


def _each_block(batches: Iterator[pa.RecordBatch], k: int, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        got = [batch.column(c).to_pylist() for c in columns]
        for block, body, *answers in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), *got, strict=True):
            yield block, BlockWords(body, k), *answers


def _question(block: int, v: np.ndarray, buckets: int, unused: int) -> pa.RecordBatch:
    runs = list(B.by_bucket(v, buckets))
    bodies = [B.squeeze(v[a:z] >> U(unused) | v[a:z] & U(1), True) for _, a, z in runs]
    return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in runs], pa.int32()), "block": pa.array([block] * len(runs), pa.int64()), "keys": pa.array(bodies, pa.binary())})


def _answered(asked: DataFrame, shift: int, masks: int) -> DataFrame:
    """(block, bucket, answer): which of a block's keys two documents have and, for nodes, which branch."""
    s = U(shift)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in B.gathered(batches, "bucket"):
            values = [B.expand(keys, True) for _, keys in rows]
            each = [np.unique(v >> s) for v in values]
            keys, n = np.unique(np.concatenate(each), return_counts=True)
            flagged = np.unique(np.concatenate([v[(v & U(1)) == 1] >> s for v in values]))
            found = [n > 1]
            found[0][np.searchsorted(keys, flagged)] = True
            if masks > 1:
                ways = np.unique(np.concatenate([v >> U(1) for v in values]))
                found.append(np.unique(ways >> (s - U(1)), return_counts=True)[1] > 1)
            at = [np.searchsorted(keys, e) for e in each]
            yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "answer": pa.array([B.bits(*(f[a] for f in found)) for a in at], pa.binary())})

    return B.together(asked, "bucket").mapInArrow(answer, "block long, bucket int, answer binary")


def _seed_answers(blocks: DataFrame, k: int, shift: int, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, w in _each_block(batches, k):
            yield _question(block, distinct(w.seeds(shift), w.row[w.edges], shift)[0], buckets, shift - 1)

    return _answered(blocks.select("block", "body").mapInArrow(ask, "bucket int, block long, keys binary"), 1, 1)


def _node_answers(seeded: DataFrame, k: int, seed_shift: int, shift: int, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, w, got in _each_block(batches, k, "answers"):
            _, at = w.ends(got, seed_shift, buckets)
            yield _question(block, distinct(w.nodes(at, shift), w.row[at], shift)[0], buckets, 0)

    return _answered(seeded.mapInArrow(ask, "bucket int, block long, keys binary"), shift, 2)


def _pieces(seeded: DataFrame, node_answers: DataFrame, k: int, seed_shift: int, shift: int, buckets: int, kind: str) -> DataFrame:
    """Each document's paths: hashes of the first and last edge, edges, hash of all words, and place."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, w, seeds, got in _each_block(batches, k, "seeds", "answers"):
            p, at = w.ends(seeds, seed_shift, buckets)
            v, first, place = distinct(w.nodes(at, shift), w.row[at], shift)
            repeated, branching = (m[place] for m in _masks(v, first, got, buckets, 2))
            node = np.searchsorted(at, p)
            ok = repeated[node] & repeated[np.minimum(node + 1, len(at) - 1)] if len(at) else np.zeros(0, bool)
            p, node = p[ok], node[ok]
            start = np.append(True, (p[1:] != p[:-1] + 1) | branching[node[1:]])[: len(p)]
            begins = np.flatnonzero(start)
            n = np.diff(np.append(begins, len(p)))
            a = p[begins]
            row = w.row[a]
            other = sequence_sums(mix(w.words ^ OTHER))
            columns = {
                "first": pa.array(sequence_hash(w.sums, a, a + k).view(np.int64)),
                "last": pa.array(sequence_hash(w.sums, a + n - 1, a + n - 1 + k).view(np.int64)),
                "edges": pa.array(n, pa.int32()),
                "words": pa.array(sequence_hash(other, a, a + n - 1 + k).view(np.int64)),
                "id": w.batch.column(0).take(pa.array(row)),
                "block": pa.array(np.full(len(a), block), pa.int64()),
                "row": pa.array(row, pa.int32()),
                "start": pa.array(a - w.first[row], pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"first long, last long, edges int, words long, id {kind}, block long, row int, start int"
    both = B.with_answers(seeded.withColumnRenamed("answers", "seeds"), node_answers, "bucket", "answer")
    return both.select("block", "body", "seeds", "answers").mapInArrow(cut_up, schema)


def _windows(blocks: DataFrame, pieces: DataFrame, k: int, kind: str) -> DataFrame:
    """(a, b, id, block, row, start): two hashes of every window of ``pieces``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, w, got in _each_block(batches, k, "answers"):
            other = sequence_sums(mix(w.words ^ OTHER))
            row = np.concatenate([np.full(g["edges"], g["row"]) for g in got])
            start = np.concatenate([np.arange(g["start"], g["start"] + g["edges"]) for g in got])
            at = w.first[row] + start
            columns = {
                "a": pa.array(sequence_hash(w.sums, at, at + k).view(np.int64)),
                "b": pa.array(sequence_hash(other, at, at + k).view(np.int64)),
                "id": w.batch.column(0).take(pa.array(row)),
                "block": pa.array(np.full(len(at), block), pa.int64()),
                "row": pa.array(row, pa.int32()),
                "start": pa.array(start, pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    found = B.with_answers(blocks, pieces, "row", "start", "edges").select("block", "body", "answers")
    return found.mapInArrow(each, f"a long, b long, id {kind}, block long, row int, start int")


def _after(source_id) -> object:
    """Whether ``id`` comes after the source's; rows without an id come last and are nobody's source."""
    return source_id.isNotNull() & (F.col("id").isNull() | (F.col("id") > source_id))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, node_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((block, row, start, edges, source_id), blocks): places whose ``edges`` windows of k words also start in a document of smaller id.

    Words are runs of anything but ASCII white space, unchanged. Null texts are empty. Rows of one id are documents
    that don't remove from each other; rows without an id come after all others and are never a source.
    ``node_bits`` (32 to 62) are a node hash's bits, by default so many that few of the corpus's nodes share one.
    """
    if not 2 <= k:
        raise ValueError("k must be 2 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks, seen = B.packed(rows, "text")
    if node_bits is None:
        node_bits = min(max(int(seen["bytes"]).bit_length() + 10, 36), 48)
    shift = 64 - node_bits
    buckets = max(2 * B.partitions(docs), int(seen["bytes"]) // 24 // BUCKET_NODES)
    seed_shift = max(24, shift)
    seeded = B.with_answers(blocks, cut(_seed_answers(blocks, k, seed_shift, buckets)), "bucket", "answer")
    nodes = cut(_node_answers(seeded, k, seed_shift, shift, buckets))
    pieces = B.stored(_pieces(seeded, nodes, k, seed_shift, shift, buckets, kind))

    source = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "edges", "words")).alias("source")
    # paths of different length have different hashes of their words, too
    mixed = F.min("words") != F.max("words")
    paths = pieces.groupBy("first").agg(source, F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).where("n > 1")
    paths, of_paths = observed(paths, mixed=F.count_if("mixed"))
    same = (F.col("edges") == F.col("source.edges")) & (F.col("words") == F.col("source.words"))
    spans = pieces.join(paths.hint("merge"), "first").where(_after(F.col("source.id")) & same).select("block", "row", "start", "edges", F.col("source.id").alias("source_id"))

    ends, of_ends = observed(pieces.groupBy("last").agg(mixed.alias("mixed")).where("mixed"))
    if of_paths["mixed"] or of_ends["n"]:
        of_mixed = pieces.join(paths.where("mixed").select("first"), "first", "left_semi")
        doubtful = of_mixed.unionByName(pieces.join(ends, "last", "left_semi")).select("block", "row", "start", "edges").distinct()
        windows = cut(_windows(blocks, doubtful, k, kind))
        lowest = windows.where("id is not null").groupBy("a", "b").agg(F.min("id").alias("source_id"))
        exact = windows.join(lowest, ["a", "b"]).where(_after(F.col("source_id")))
        spans = spans.unionByName(exact.select("block", "row", "start", F.lit(1).alias("edges"), "source_id"))
    return spans, blocks


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, node_bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words that no repeated window covers, joined by one space.

    A window of k words is repeated if its words also start in a document of smaller id, all judged on the input.
    Null and empty texts give 0 words and an empty text; see ``repeated_spans`` for equal and null ids. Only the two
    named columns are read.
    """
    spans, blocks = repeated_spans(docs, id_col, text_col, k, node_bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, got in zip(batch.column("body").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                rows, data, offsets = B.unpacked(body, 1)
                s, e, row = word_spans(data, offsets)
                first = np.searchsorted(row, np.arange(rows.num_rows + 1))
                depth = np.zeros(len(s) + 1, np.int64)
                if got:
                    a = first[[g["row"] for g in got]] + [g["start"] for g in got]
                    np.add.at(depth, a, 1)
                    np.add.at(depth, a + [g["edges"] + k - 1 for g in got], -1)
                kept = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                n_words = np.diff(first)
                left = np.bincount(row[kept], minlength=rows.num_rows)
                arrays = [rows.column(0), pa.array(n_words, pa.int64()), pa.array(n_words - left, pa.int64()), _joined(data, s[kept], e[kept], row[kept], rows.num_rows)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept"])

    found = B.with_answers(blocks, spans, "row", "start", "edges", how="left").select("body", "answers")
    return found.mapInArrow(keep, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its words, with one space between them."""
    n = e - s + 1  # with the space before each word
    ends = np.cumsum(n)
    source = np.repeat(s - 1 - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    out = data[np.maximum(source, 0)] if len(source) else np.zeros(0, np.uint8)
    out[ends - n] = 32
    opening = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    out = np.delete(out, (ends - n)[opening])
    sizes = np.bincount(row, weights=n, minlength=rows).astype(np.int64) - (np.bincount(row, minlength=rows) > 0)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
