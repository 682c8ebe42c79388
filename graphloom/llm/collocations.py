"""Collocations: phrases whose parts meet more often than their counts let expect, from weighted acyclic automata.

1. Words are counted over all blocks; words seen often enough get numbers, frequent ones small ones. No phrase that
   holds another word can be frequent, so texts become runs of numbers.
2. Every position opens a context of up to ``longest`` words. A shard's contexts are sorted, and automata are built
   from them, one for each prefix range: paths are phrases, weights their counts.
3. A range's automata from all shards are united, weights summed and infrequent prefixes left. Ranges part the
   contexts, not the phrases, so that a very frequent word's contexts lie in many ranges; the few phrases that begin
   a border are summed over ranges afterwards.
4. The frequent phrases make one automaton a range; the parts of all candidates are composed with it.

Everything is per language: a word's number stands for the word in one language.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import automata
from graphloom.llm import blocks as B
from graphloom.llm.common import cut, observed
from graphloom.llm.words import U, lower, mix, span_hashes, word_spans

#: What ends a piece: . , ; : ! ? and the bytes 0x0A to 0x0D.
BREAKS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
#: Contexts from which a task builds automata at once, and contexts of a range, about.
SHARD, RANGE = 1 << 19, 1 << 20
#: Blocks that are sampled to part the ranges, and contexts from each at least (32 a range from all).
SAMPLE_BLOCKS, SAMPLE_CONTEXTS = 64, 64
#: Ranges at most, as each task holds their borders (5 MB).
MOST_RANGES = 1 << 17
UNKNOWN = "und"


class BlockWords:
    """A block's words: bytes, pieces, and keys of word and language."""

    def __init__(self, body: bytes):
        batch, data, offsets = B.unpacked(body, 1)
        self.data = lower(data)
        breaks = np.isin(self.data, BREAKS)
        self.data[breaks] = 32
        self.s, self.e, self.row = word_spans(self.data, offsets)
        self.piece = np.cumsum(breaks)[self.s] if len(self.s) else self.s
        self.langs = [UNKNOWN if x is None else x for x in batch.column(0).to_pylist()]
        of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        lang = np.array([of[x] for x in self.langs], U)
        self.keys = mix(span_hashes(self.data, self.s, self.e) + mix(lang)[self.row])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, a place of each, each word's number among them, counts)."""
        return np.unique(self.keys, return_index=True, return_inverse=True, return_counts=True)

    def numbered(self, got: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct key's place, whether this block spells it, its id (0: infrequent), and each word's number among the keys."""
        _, at, number, _ = self.distinct()
        answer = np.concatenate([B.expand(g["answer"]) for g in got]) if got else np.zeros(0, U)
        ids = (answer >> U(1)).astype(np.int64)
        return at, (answer & U(1)).astype(bool), ids, number

    def contexts(self, got: list[dict], longest: int) -> np.ndarray:
        """A row for each frequent word: it and up to ``longest`` - 1 followers of its piece, up to an infrequent one; padded with zeros."""
        _, _, ids, number = self.numbered(got)
        ids, n = ids[number], len(number)
        out = np.zeros((n, longest), np.int64)
        going = np.ones(n, bool)
        for j in range(min(longest, n)):
            k = n - j
            going[k:] = False
            going[:k] &= (self.row[j:] == self.row[:k]) & (self.piece[j:] == self.piece[:k]) & (ids[j:] != 0)
            out[:k, j] = np.where(going[:k], ids[j:], 0)
        return out[out[:, 0] != 0] if n else out


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each is there."""
    rows = rows[np.lexsort(rows.T[::-1])]
    fresh = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)])
    return rows[fresh], np.diff(np.append(fresh, len(rows)))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, BlockWords, list[dict]]]:
    for batch in batches:
        answers = batch.column("answers").to_pylist() if "answers" in batch.schema.names else [[]] * len(batch)
        for block, body, got in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), answers, strict=True):
            yield block, BlockWords(body), got


def _word_numbers(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """(block, bucket, answer): the number of each of the block's words, with a low bit where this block is to spell it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, w, _ in _each_block(batches):
            keys, _, _, n = w.distinct()
            runs = list(B.by_bucket(keys, buckets))
            columns = [pa.array([r[0] for r in runs], pa.int32()), pa.array([block] * len(runs), pa.int64())]
            columns += [pa.array([B.squeeze(keys[a:z], True) for _, a, z in runs], pa.binary()), pa.array([B.squeeze(n[a:z]) for _, a, z in runs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in B.gathered(batches, "bucket"):
            each = [B.expand(k, True) for _, k, _ in rows]
            keys, first, number = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, number, np.concatenate([B.expand(n) for _, _, n in rows]).astype(np.int64))
            frequent = np.flatnonzero(total >= least)
            ids = np.zeros(len(keys), np.int64)
            ids[frequent[np.lexsort((keys[frequent], -total[frequent]))]] = np.arange(len(frequent)) * buckets + bucket + 1
            spells = np.zeros(len(number), np.int64)
            spells[first] = 1
            packed = ids[number] << 1 | np.where(ids[number] > 0, spells, 0)
            ends = np.cumsum([0, *map(len, each)])
            bodies = [B.squeeze(packed[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "answer": pa.array(bodies, pa.binary())})

    asked = blocks.select("block", "body").mapInArrow(ask, "bucket int, block long, keys binary, n binary")
    return B.together(asked, "bucket", "block").mapInArrow(answer, "block long, bucket int, answer binary")


def _spelled(numbered: DataFrame) -> DataFrame:
    """(id, lang, word, n): one row for each numbered word, and rows of words in each language without an id."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, got in _each_block(batches):
            at, spells, ids, _ = w.numbered(got)
            mine = np.flatnonzero(spells)
            rows = [(int(ids[i]), w.langs[w.row[at[i]]], w.data[w.s[at[i]] : w.e[at[i]]].tobytes().decode(), None) for i in mine]
            per_row = np.bincount(w.row, minlength=len(w.langs))
            totals: dict[str, int] = {}
            for lang, n in zip(w.langs, per_row.tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            rows += [(None, lang, None, n) for lang, n in totals.items()]
            ids_, langs, words, ns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["id", "lang", "word", "n"])

    return numbered.mapInArrow(spell, "id long, lang string, word string, n long")


def _borders(numbered: DataFrame, n_blocks: int, ranges: int, longest: int) -> list[tuple[int, ...]]:
    """At most ``ranges`` - 1 contexts that part all contexts about evenly, from a bounded sample; results don't depend on them."""

    each = max(SAMPLE_CONTEXTS, 32 * ranges // SAMPLE_BLOCKS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, got in _each_block(batches):
            rows = w.contexts(got, longest)
            rows = rows[np.lexsort(rows.T[::-1])]
            some = rows[np.linspace(0, len(rows) - 1, min(len(rows), each)).astype(np.int64)] if len(rows) else rows
            yield pa.RecordBatch.from_pydict({"ids": pa.array(some.tolist(), pa.list_(pa.int64()))})

    part = numbered.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // SAMPLE_BLOCKS))) == 0)
    found = sorted(tuple(r["ids"]) for r in part.mapInArrow(sample, "ids array<long>").collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _shards(numbered: DataFrame, borders: list[tuple[int, ...]], longest: int) -> DataFrame:
    """(range, automaton): counts of a shard's contexts in each prefix range."""

    def made(rows: np.ndarray) -> pa.RecordBatch:
        rows, n = _counted(rows)
        edges = np.array([0, *(_place(rows, b) for b in borders), len(rows)])
        used = np.flatnonzero(np.diff(edges))
        bodies = [automata.build(rows[edges[r] : edges[r + 1]], n[edges[r] : edges[r + 1]]).to_bytes() for r in used]
        return pa.RecordBatch.from_pydict({"range": pa.array(used, pa.int32()), "body": pa.array(bodies, pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, w, got in _each_block(batches):
            held.append(w.contexts(got, longest))
            if sum(map(len, held)) >= SHARD:
                yield made(np.concatenate(held))
                held = []
        if held:
            yield made(np.concatenate(held))

    return numbered.mapInArrow(build, "range int, body binary")


def _place(rows: np.ndarray, border: tuple[int, ...]) -> int:
    """How many of the sorted rows are before ``border``."""
    low, high = 0, len(rows)
    for d, b in enumerate(border):
        column = rows[low:high, d]
        low, high = low + int(np.searchsorted(column, b, "left")), low + int(np.searchsorted(column, b, "right"))
    return low


def _united(shards: DataFrame, borders: list[tuple[int, ...]], least: int) -> DataFrame:
    """(ids, f): every phrase seen at least ``least`` times, of one word or more."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in B.gathered(batches, "range"):
            beside = np.array(borders[max(number - 1, 0) : number + 1] if number else borders[:1], np.int64)
            for paths, weights, partial in zip(*automata.union([automata.Automaton.from_bytes(b) for (b,) in rows], least, beside), strict=True):
                yield pa.RecordBatch.from_pydict({"ids": pa.array(paths.tolist(), pa.list_(pa.int64())), "f": pa.array(weights, pa.int64()), "part": pa.array(partial)})

    found = cut(B.together(shards, "range").mapInArrow(unite, "ids array<long>, f long, part boolean"))
    parts = found.where("part").groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.where("not part").select("ids", "f").unionByName(parts)


def _composed(grams: DataFrame, parts: DataFrame, borders: list[tuple[int, ...]], longest: int) -> DataFrame:
    """(part, f): the count of each row of ``parts``, from one automaton a range."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [bisect_right(borders, (*ids, *[0] * (longest - len(ids)))) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("ids"), b.column("f")], ["range", "ids", "f"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in B.gathered(batches, "range"):
            known = sorted((*ids, *[0] * (longest - len(ids)), f) for ids, f in rows if f is not None)
            asked = [ids for ids, f in rows if f is None]
            if not asked:
                continue
            table = np.array(known, np.int64).reshape(-1, longest + 1)
            counts = _counts_of(table[:, :-1], table[:, -1])
            wanted = np.array([[*ids, *[0] * (longest - len(ids))] for ids in asked], np.int64).reshape(-1, longest)
            yield pa.RecordBatch.from_pydict({"part": pa.array(asked, pa.list_(pa.int64())), "f": pa.array(counts.compose(wanted), pa.int64())})

    schema = "range int, ids array<long>, f long"
    both = grams.select("ids", "f").unionByName(parts.select(F.col("part").alias("ids"), F.lit(None).cast("long").alias("f")))
    return B.together(both.mapInArrow(dealt, schema), "range").mapInArrow(answer, "part array<long>, f long")


def _counts_of(paths: np.ndarray, counts: np.ndarray) -> automata.Automaton:
    """An automaton that gives each of the sorted ``paths`` its count.

    Built from sequences, a path weighs as much as all that begin with it; so each path is given what its
    extensions by one word leave of its count.
    """
    length = (paths != 0).sum(1)
    own = counts.copy()
    above = {tuple(p[:n]): i for i, (p, n) in enumerate(zip(paths.tolist(), length.tolist(), strict=True))}
    for i, (p, n) in enumerate(zip(paths.tolist(), length.tolist(), strict=True)):
        if n > 1 and (j := above.get(tuple(p[: n - 1]))) is not None:
            own[j] -= counts[i]
    return automata.build(paths, own)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((ids, f), (part, f), (id, lang, word, n)): phrases of up to ``longest`` words seen ``least`` times, the counts of their parts, and words.

    Texts are lower-cased from A to Z; pieces end at . , ; : ! ? and the bytes 0x0A to 0x0D, words at spaces and tabs.
    Null texts are empty, a null language is "und". A word's row has its number, a language's row its words.
    """
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks, seen = B.packed(rows, "text")
    buckets = 2 * B.partitions(docs)
    numbered = B.with_answers(blocks, cut(_word_numbers(blocks, least, buckets)), "bucket", "answer", how="left")
    words = cut(_spelled(numbered))
    positions = (words.agg(F.sum("n")).first()[0] or 0) if seen["n"] else 0
    borders = _borders(numbered, seen["n"], min(max(2 * B.partitions(docs), positions // RANGE), MOST_RANGES), longest)
    grams = cut(_united(_shards(numbered, borders, longest), borders, least))
    long = grams.where(F.size("ids") > 1)
    cuts = F.sequence(F.lit(1), F.size("ids") - 1)
    left = F.transform(cuts, lambda k: F.slice("ids", F.lit(1), k))
    right = F.transform(cuts, lambda k: F.slice("ids", k + 1, F.size("ids") - k))
    parts = long.select(F.explode(F.concat(left, right)).alias("part")).distinct()
    return grams, cut(_composed(grams, parts, borders, longest)), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, inside: int = 100, top: int = 2000, scale: int = 1000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r are how often the phrase and the two parts at its weakest cut occur, n is the language's number of
    words; score is floor(scale * a * n / (l * r)), the lowest over all cuts (then the first). Phrases inside a longer one
    that has ``inside`` percent of their occurrences or more are left out. Ranks are by score and a, both falling,
    then by phrase. Products have up to 38 digits. Without frequent phrases the result is empty.
    """
    grams, counts, words = phrases(docs, text_col, lang_col, longest, least)
    long = grams.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    size = F.size("ids")
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    within = long.where(size > 2).select(F.explode(shorter).alias("ids"), F.col("a").alias("more")).groupBy("ids").agg(F.max("more").alias("more"))
    kept = long.join(within, "ids", "left").where("more IS NULL OR 100 * more < %d * a" % inside).drop("more")

    spelling = words.where("id IS NOT NULL").select("id", "lang", "word")
    spelled = kept.select("ids", "a", F.posexplode("ids").alias("at", "id")).join(spelling, "id")
    spelled = spelled.groupBy("ids", "a").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.where("id IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = spelled.join(totals, "lang")

    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = spelled.select("*", k).withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    both = cuts.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"(CAST({scale} * a AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))").cast("long")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("_some", some).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_some").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
