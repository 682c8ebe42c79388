"""Packing of token sequences by exact complements, then best fit.

The plan is made from the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus holds); pieces find their place by their rank among
the pieces of their length. The histogram, ranks and places are Spark jobs.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, text_batches

#: Entries of a worker's memory of word -> ids; it is emptied when full.
MEMORY = 400_000
#: A word that Unicode versions and libraries see alike: Latin-1 letters, then at most one mark.
SIMPLE, MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?"


class _Formats(dict):
    """struct's format of n ids, made once."""

    def __missing__(self, n: int) -> str:
        self[n] = f"<{n}I"
        return self[n]


FORMATS = _Formats()


class WordIds:
    """Token ids, as little-endian 32-bit bytes, of a word-wise tokenizer file that drops white space.

    Words are independent there, so each distinct one is encoded once. Simple words go through
    ``tiktoken`` with the file's own vocabulary (a word's end is the byte 0xFF, which UTF-8 never
    has); all others, and files of another kind, through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_padding()
        self.inner.no_truncation()
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = model.get("end_of_word_suffix") == "</w>" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True and spec.get("post_processor") is None
        self.memory: dict[str, bytes] = {}
        self.single = self._ranks(model) if self.by_word else None
        self.marks = {m: np.array(self.single(m.encode() + b"\xff"), "<u4").tobytes() for m in MARKS} if self.single else {}

    def _ranks(self, model: dict):
        """encode_single_piece over this vocabulary, or None if its ids are not in merge order."""
        import tiktoken

        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if merged != sorted(merged) or min(merged) < 512:
            return None
        ranks = {}
        for token, i in vocab.items():
            word_end = token.endswith("</w>") and token != "</w>"
            chars = token[:-4] if word_end else token
            if all(c in byte_of for c in chars):
                ranks[bytes(byte_of[c] for c in chars) + b"\xff" * word_end] = i
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode(self, words: set[str]) -> None:
        others, memory, marks, single = [], self.memory, self.marks, self.single
        for w in words:
            mark = marks.get(w[-1])
            core = w if mark is None else w[:-1]
            if single and (core.isalpha() if core.isascii() else SIMPLE.fullmatch(core)):
                ids = single(core.lower().encode() + b"\xff")
                memory[w] = struct.pack(FORMATS[len(ids)], *ids) if mark is None else struct.pack(FORMATS[len(ids)], *ids) + mark
            else:
                others.append(w)
        for w, e in zip(others, self.inner.encode_batch_fast(others, add_special_tokens=False), strict=True):
            memory[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word or re.search(r"[\x1c-\x1f]", text):
            return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        got = list(map(self.memory.get, words))
        if None in got:
            new = {w for w, i in zip(words, got, strict=True) if i is None}
            if len(self.memory) + len(new) > MEMORY:
                self.memory.clear()
                new = set(words)
            self._encode(new)
            got = map(self.memory.__getitem__, words)
        return b"".join(got)


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32. Each text ends with ``end_id``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = enc.ids(batch.column(1)[i].as_py() or "") + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            made = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(made, ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) for a histogram: exact fillings first, best fit for the rest.

    ``counts[l]`` is the number of pieces of length ``l``. For each length, longest first, the
    gap is looked up in the index of available single lengths, of pairs and of triples; each
    combination found is consumed as often as the counts allow.
    """
    left, patterns = counts.astype(np.int64).copy(), []

    def consume(*lengths: int) -> None:
        times = min(left[x] // k for x, k in Counter(lengths).items())
        if times > 0:
            for x in lengths:
                left[x] -= times
            patterns.append((lengths, int(times)))

    def pairs(gap: int, most: int) -> np.ndarray:
        """Larger halves b, largest first, for which b and gap - b are both available."""
        b = np.arange(min(gap - 1, most), (gap + 1) // 2 - 1, -1)
        return b[(left[b] > 0) & (left[gap - b] > 0)] if len(b) else b

    if left[capacity]:
        consume(capacity)
    for size in range(capacity - 1, 0, -1):
        gap = capacity - size
        if left[size] and left[gap]:
            consume(size, gap)
        if left[size]:
            for b in pairs(gap, size):
                consume(size, int(b), int(gap - b))
                if not left[size]:
                    break
        if left[size]:
            for a in range(min(gap - 2, size), (gap + 2) // 3 - 1, -1):
                if left[a]:
                    for b in pairs(gap - a, a):
                        consume(size, a, int(b), int(gap - a - b))
                        if not left[size] or not left[a]:
                            break
                if not left[size]:
                    break
    # best fit, longest first, over groups of equal sequences
    open_by_gap: dict[int, list[list]] = {}
    available = np.zeros(capacity + 1, np.int64)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        open_by_gap.setdefault(gap, []).append([pattern, times])
        available[gap] += times

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            fits = np.flatnonzero(available[size:])
            if not len(fits):
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each)
                if n % each:
                    put((size,) * (n % each), 1)
                break
            gap = size + int(fits[0])
            pattern, times = open_by_gap[gap].pop()
            used = min(n, times)
            available[gap] -= times
            if times > used:
                put(pattern, times - used)
            put((*pattern, size), used)
            n -= used
    patterns += [(p, t) for groups in open_by_gap.values() for p, t in groups]
    return patterns


def plan_runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks, by length: (length, first rank, first sequence, offset)."""
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            runs.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each; null ids stay;
    other columns are ignored; an empty table gives no rows. Pieces of one length are
    interchangeable: which of them stands where depends on the order of the input partitions,
    the set of sequences' fillings does not. Broadcast: the runs, whose number depends on
    ``capacity`` alone. A length that many pieces share is ranked within input partitions.
    """
    text_batches(docs.sparkSession)
    pieces = cut(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("part", F.spark_partition_id()))
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    runs = plan_runs(plan_patterns(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(first, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        # ranks of one length stay apart from those of the next
        base = np.searchsorted(r["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.empty(len(length), np.int64)
            order = np.lexsort((rank, length))
            edges = np.searchsorted(length[order], np.arange(capacity + 2))
            for size in np.unique(length):
                own = order[edges[size] : edges[size + 1]]
                at[own] = base[size] + np.searchsorted(r["rank"][base[size] : base[size + 1]], rank[own], side="right") - 1
            sequence = r["sequence"][at] + rank - r["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(r["offset"][at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = ranked.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
