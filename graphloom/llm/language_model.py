"""N-gram scores from tries in Elias-Fano levels.

A trigram model with absolute discounting, interpolated down to the unigram share
(c + 0.1) / (N + 0.1 * (V + 1)). Trigrams (u, v, w) are dealt by their middle word v; a
very frequent v is dealt by classes of u as well; the pairs (v, w) of such a v are added up
over all classes and sent whole to each class's part, so the bigram level covers all its
occurrences. A part counts its training trigrams, writes its trie to memory-mapped files
and answers all texts' trigrams from it.

Every word is a word of its own. Frequent words have ids by rank that are broadcast; the others
travel as hashes beside each block and get ids within a part. A probability is a + b * share(w):
for a rare w the parts send a and b on to where its count is, and the sums go back to the texts' block.

Levels of a part: contexts v; their successors w with the bigram's log10
probability; their left words u with the weight of backing off; and under each (u, v) its
successors as positions among v's successors. All are monotone sequences in
Elias-Fano form; probabilities are 16-bit codes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, cut, small
from graphloom.llm.words import mix, text_slices, word_hashes

#: Words with broadcast ids below RARE; all others are hashes from RARE on, and ids from RARE on within a block or part.
TOP_WORDS = 1 << 19
RARE = 1 << 20
END, OTHER, BEGIN = RARE - 3, RARE - 2, RARE - 1
#: Bits of an id in the keys of blocks and parts, and ids of rare words that a part may have.
ID_BITS = 21
ID_MASK = np.uint64((1 << ID_BITS) - 1)
RARE_IDS = (1 << ID_BITS) - RARE
#: Codes are log10 probabilities in steps of 1/4096.
STEP = 4096
DISCOUNT = 0.75
#: Tokens gathered before rows are sent, tokens that a part has on average, and fewer for the sake of parallel tasks.
BLOCK_TOKENS, PART_TOKENS, LEAST_TOKENS = 1 << 20, 1 << 20, 1 << 17
#: Spark partitions that parts are dealt to at most; a task takes its parts one after the other.
PARTITIONS = 1 << 14
#: Rare words that meet their counts in one task.
PLACE_WORDS = 1 << 17
#: Trigrams looked up at once.
ASKED = 1 << 16
#: Compressed blocks that a part's task keeps in memory.
KEPT_BYTES = 48 << 20


#: The place of the k-th one (column k - 1) of each byte.
PLACES = np.array([[*(i for i in range(8) if byte >> i & 1), *[0] * 8][:8] for byte in range(256)], np.int8)


def place_of_one(bits: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of the want-th one (from 1) of each 64-bit word: its half, quarter and byte, then a table."""
    place = np.zeros(len(bits), np.uint64)
    for half in (32, 16, 8):
        count = np.bitwise_count((bits >> place) & np.uint64((1 << half) - 1))
        skip = count < want
        want = want - np.where(skip, count, 0)
        place += np.where(skip, np.uint64(half), np.uint64(0))
    byte = ((bits >> place) & np.uint64(255)).astype(np.int64)
    return place.astype(np.int64) + PLACES[byte, np.minimum(want, 8) - 1]


def mapped(path: Path) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with a count of ones a word."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, bits: int, n: int):
        self.low, self.high, self.ones, self.bits, self.n = low, high, ones, bits, n

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        high_at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(high_at[-1]) if n else 0) // 64 + 2) * 64, np.uint8)
        flags[high_at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high)))).astype(np.uint32)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            value = values & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, value << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        return cls(low, high, ones, bits, n)

    def save(self, folder: Path, name: str) -> EliasFano:
        """The same sequence on memory-mapped files."""
        parts = []
        for part in ("low", "high", "ones"):
            np.save(folder / f"{name}.{part}.npy", getattr(self, part))
            parts.append(mapped(folder / f"{name}.{part}.npy"))
        return EliasFano(*parts, self.bits, self.n)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.bits) - 1)

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many elements have high parts below ``high``: the ones before the high-th zero."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        k = np.minimum(high.astype(np.int64), int(zeros[-1]))
        # the word that holds the k-th zero (k >= 1), then its place in it
        word = np.maximum(np.searchsorted(zeros, k, side="left") - 1, 0)
        place = place_of_one(~self.high[np.minimum(word, len(self.high) - 1)], np.maximum(k - zeros[word], 1))
        return np.where(k > 0, word * 64 + place + 1 - k, 0)

    def value(self, i: np.ndarray) -> np.ndarray:
        """The i-th element: the place of the i-th one, and its low bits."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = place_of_one(self.high[word], i - self.ones[word].astype(np.int64) + 1)
        return (((word * 64 + place - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first element >= x, and whether it is x: the successors that share its high part are walked."""
        top = np.uint64(max(0, len(self.high) * 64 - self.n - 1))
        high = np.minimum(x >> np.uint64(self.bits), top)
        low = x & np.uint64((1 << self.bits) - 1)
        begin = self.before(high)
        hit, open_ = np.zeros(len(x), bool), np.arange(len(x))
        at, shift, want = begin, high.astype(np.int64), low
        while len(open_):
            bit = at + shift
            inside = (self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            value = self.lows(np.minimum(at, max(0, self.n - 1)))
            less = inside & (value < want)
            hit[open_] = inside & (value == want)
            begin[open_] = at
            open_, at, shift, want = open_[less], at[less] + 1, shift[less], want[less]
        return begin, hit & (x >> np.uint64(self.bits) <= top)


def code(p: np.ndarray) -> np.ndarray:
    """-log10 p in steps; 16 bits."""
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-15)) * STEP), 65535).astype(np.uint16)


class Trie:
    """One part's model: ``keys`` are u, v, w packed as v << 2 * bits | u << bits | w, with counts.

    ``pairs`` has bigrams v << bits | w, ascending, with counts over all parts, of the v whose trigrams are in
    several parts, and ``contexts`` those v, ascending, with the counts of their tokens and successors. Words beyond
    ``share`` have the share 0 here, so that their probabilities lack the share's term.
    """

    #: Ids are by rank; multiplied by this they lie evenly, as Elias-Fano levels and their searches like it.
    SPREAD = 0x9E3779B1

    def __init__(self, keys: np.ndarray, counts: np.ndarray, share: np.ndarray, folder: Path, pairs: tuple[np.ndarray, np.ndarray] | None = None, contexts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, bits: int = 20):
        self.bits, self.low = (BITS, LOW) = np.uint64(bits), np.uint64((1 << bits) - 1)
        self.share_codes = code(share).astype(np.int64)
        keys = (keys & ~((np.uint64(1) << (BITS + BITS)) - np.uint64(1))) | (self.spread((keys >> BITS) & LOW) << BITS) | self.spread(keys & LOW)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        bigram = ((keys >> (BITS + BITS)) << BITS) | (keys & LOW)
        two, at = np.unique(bigram, return_inverse=True)
        c2 = np.bincount(at, counts, len(two))
        if contexts is not None and len(contexts[0]):
            known = (pairs[0] & ~LOW) | self.spread(pairs[0] & LOW)
            own = ~np.isin(two >> BITS, contexts[0])
            two, c2 = np.concatenate((two[own], known)), np.concatenate((c2[own], pairs[1]))
            order = np.argsort(two)
            two, c2 = two[order], c2[order]
            at = np.searchsorted(two, bigram)
        one, ctx2 = np.unique(two >> BITS, return_inverse=True)
        c1, n1 = np.bincount(ctx2, c2, len(one)), np.bincount(ctx2, minlength=len(one))
        kinds = n1.copy()
        if contexts is not None and len(contexts[0]):
            place = np.minimum(np.searchsorted(contexts[0], one), len(contexts[0]) - 1)
            several = contexts[0][place] == one
            c1, kinds = np.where(several, contexts[1][place], c1), np.where(several, contexts[2][place], kinds)
        node, under = np.unique(keys >> BITS, return_inverse=True)
        cn, nn = np.bincount(under, counts, len(node)), np.bincount(under, minlength=len(node))
        ctx_n = np.searchsorted(one, node >> BITS)
        last = self.gathered(two & LOW).astype(np.int64)
        p2 = (np.maximum(c2 - DISCOUNT, 0) + DISCOUNT * kinds[ctx2] * np.where(last < len(share), share[np.minimum(last, len(share) - 1)], 0)) / c1[ctx2]
        p3 = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * nn[under] * p2[at]) / cn[under]
        # each context's successors lie evenly between its pointers: as many in a unit of any level's high parts
        sums = {"two": n1, "node": np.bincount(ctx_n, minlength=len(one)), "three": nn}
        pointer = {k: np.concatenate(([0], np.cumsum(v))).astype(np.uint64) for k, v in sums.items()}
        self.width = np.uint64(max(1, int(n1.max(initial=1))))
        position = at.astype(np.uint64) - pointer["two"][ctx2[at]]
        levels = {
            "one": one, "two": self.placed(pointer["two"][ctx2], two & LOW, n1[ctx2]), "node": self.placed(pointer["node"][ctx_n], node & LOW, sums["node"][ctx_n]),
            "three": pointer["three"][under] * self.width + position * nn[under].astype(np.uint64), **{f"{k}s": v for k, v in pointer.items()},
        }
        self.levels = {k: EliasFano.build(v).save(folder, k) for k, v in levels.items()}
        self.codes = {}
        for name, p in (("one", DISCOUNT * kinds / np.maximum(c1, 1)), ("two", p2), ("node", DISCOUNT * nn / np.maximum(cn, 1)), ("three", p3)):
            np.save(folder / f"{name}.code.npy", code(p))
            self.codes[name] = mapped(folder / f"{name}.code.npy")

    def placed(self, first: np.ndarray, id_: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A successor's number: as far between its context's first pointer and the next as its id is among all ids."""
        return (first.astype(np.uint64) << self.bits) + id_ * n.astype(np.uint64)

    def spread(self, ids: np.ndarray) -> np.ndarray:
        return (ids * np.uint64(self.SPREAD)) & self.low

    def gathered(self, ids: np.ndarray) -> np.ndarray:
        """The inverse of ``spread``."""
        return (ids * np.uint64(pow(self.SPREAD, -1, 1 << int(self.bits)))) & self.low

    def value(self, name: str, i: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The codes at ``i``, 0 where not ``known``."""
        c = self.codes[name]
        return np.where(known, c[np.where(known, i, 0)], 0).astype(np.int64) if len(c) else np.zeros(len(i), np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Codes of the keys' probabilities."""
        return self.terms(keys)[0]

    def terms(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, whether the pair (v, w) is known, and the codes of backing off to w's share.

        For a w beyond the shares, the code of a known pair lacks w's share times the backing off; that of another is the
        latter alone. Keys with one v, or one v and u, are best beside each other: a run is looked up once.
        """
        BITS, LOW = self.bits, self.low
        level = self.levels
        w = keys & LOW
        last, most = w.astype(np.int64), len(self.share_codes)
        share = np.where(last < most, self.share_codes[np.minimum(last, most - 1)], 0)
        if not level["one"].n:
            return share, np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        runs, of_run = starts_of(keys >> BITS)
        ctx, of_ctx = starts_of(keys[runs] >> (BITS + BITS))
        r1, has1 = level["one"].find(keys[runs[ctx]] >> (BITS + BITS))
        r1 = np.where(has1, r1, 0)
        first, n1, off = *self.range("twos", r1), self.value("one", r1, has1)
        node_first, n_nodes = self.range("nodes", r1)
        first, n1, off, has1, node_first, n_nodes = (x[of_ctx] for x in (first, n1, off, has1, node_first, n_nodes))
        rn, has_n = level["node"].find(self.placed(node_first, self.spread((keys[runs] >> BITS) & LOW), n_nodes))
        has_n &= has1 & (n_nodes > 0)
        rn = np.where(has_n, rn, 0)
        third, n3, node = *self.range("threes", rn), self.value("node", rn, has_n)
        first, n1, off, has1, third, n3, has_n, node = (x[of_run] for x in (first, n1, off, has1, third, n3, has_n, node))
        r2, has2 = level["two"].find(self.placed(first, self.spread(w), n1))
        has2 &= has1
        # w as a position among v's successors, and that among those of u, v
        place = np.where(has2, r2 - first, 0).astype(np.uint64)
        r3, has3 = level["three"].find(third.astype(np.uint64) * self.width + place * n3.astype(np.uint64))
        has3 &= has2 & has_n
        lower = np.where(has2, self.value("two", r2, has2), off + share)
        return np.where(has3, self.value("three", r3, has3), node + lower), has2, node + off

    def range(self, name: str, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The r-th pointer, and how far it is to the next."""
        level = self.levels[name]
        if level.n < 2:
            return np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        first = level.value(r)
        return first, level.value(r + 1) - first


def starts_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and each value's run."""
    fresh = np.append(True, x[1:] != x[:-1])[: len(x)]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes (of small numbers the upper ones are 0), compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(x) for x in arrays], "<u4").tobytes(), *planes]))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(np.frombuffer(data, "<u4", len(kinds)), kinds, strict=True):
        size = int(n) * np.dtype(kind).itemsize
        rows = np.frombuffer(data, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(rows.T).view(kind).ravel())
        at += size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def columns_of(keys: np.ndarray, places: int) -> list[np.ndarray]:
    """The ids of ascending keys, each as the difference to the one before under the same ids."""
    out, fresh = [], np.zeros(len(keys), bool)
    fresh[:1] = True
    for shift in range((places - 1) * ID_BITS, -1, -ID_BITS):
        x = ((keys >> np.uint64(shift)) & ID_MASK).astype(np.int64)
        step = np.where(fresh, x, gaps(x))
        out.append(step.astype("<u4"))
        fresh = fresh | (gaps(x) != 0)
    return out


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    keys, fresh = np.zeros(len(columns[0]), np.uint64), np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for step in columns:
        total = np.cumsum(step, dtype=np.int64)
        start = np.flatnonzero(fresh)
        x = total - np.repeat((total - step)[start], np.diff(np.append(start, len(step))))
        keys = (keys << np.uint64(ID_BITS)) | x.astype(np.uint64)
        fresh = fresh | (gaps(x) != 0)
    return keys


def localized(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with ids from RARE on in place of hashes, and the hashes, ascending."""
    rare = tokens >= RARE
    own, at = np.unique(tokens[rare], return_inverse=True)
    out = tokens.copy()
    out[rare] = at.astype(np.uint64) + np.uint64(RARE)
    return out, own


def renamed(keys: np.ndarray, ids: np.ndarray, places: int) -> np.ndarray:
    """Keys of ``places`` ids with ``ids[i]`` in place of RARE + i."""
    if not len(ids):
        return keys
    out = np.zeros(len(keys), np.uint64)
    for shift in range(0, places * ID_BITS, ID_BITS):
        x = (keys >> np.uint64(shift)) & ID_MASK
        rare = x >= RARE
        x[rare] = ids[(x[rare] - np.uint64(RARE)).astype(np.int64)]
        out |= x << np.uint64(shift)
    return out


def tightened(keys: np.ndarray, own: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys with only the hashes that they use; they stay ascending."""
    rare = np.concatenate([x[x >= RARE] for x in ((keys >> np.uint64(shift)) & ID_MASK for shift in range(0, places * ID_BITS, ID_BITS))])
    used = np.unique((rare - np.uint64(RARE)).astype(np.int64))
    if not len(used):
        return keys, own[:0]
    ids = np.zeros(int(used[-1]) + 1, np.uint64)
    ids[used] = np.arange(len(used), dtype=np.uint64) + np.uint64(RARE)
    return renamed(keys, ids, places), own[used]


class RareWords:
    """A part's ids of hashes, from RARE on, in the order of their coming."""

    def __init__(self):
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, own: np.ndarray) -> np.ndarray:
        """Ids of ascending distinct hashes; unknown ones are added."""
        at = np.searchsorted(self.hashes, own)
        fresh = self.hashes[np.minimum(at, len(self.hashes) - 1)] != own if len(self.hashes) else np.ones(len(own), bool)
        if fresh.any():
            n = len(self.hashes) + int(fresh.sum())
            if n > RARE_IDS:
                raise ValueError(f"more than {RARE_IDS} rare words in one part: lower part_tokens")
            self.ids = np.insert(self.ids, at[fresh], np.arange(len(self.hashes), n).astype(np.uint64) + np.uint64(RARE))
            self.hashes = np.insert(self.hashes, at[fresh], own[fresh])
            at = np.searchsorted(self.hashes, own)
        return self.ids[at]

    def words(self) -> np.ndarray:
        """The hashes by id."""
        out = np.zeros(len(self.ids), np.uint64)
        out[(self.ids - np.uint64(RARE)).astype(np.int64)] = self.hashes
        return out


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, without the hashes that ids use."""
    row, h = word_hashes(data, offsets)
    return row, np.maximum(h, np.uint64(RARE))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts."""
    keys, counts = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in parts)]), np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start, _ = starts_of(keys)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def by_number(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number with its positions, which keep their order."""
    small = len(numbers) and int(numbers.max()) < 1 << 16
    order = np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")
    own = numbers[order]
    start, _ = starts_of(own)
    for a, b in zip(start, np.append(start, len(own))[1:], strict=True):
        yield int(own[a]), order[a:b]


def score_texts(docs: DataFrame, *, top_words: int = TOP_WORDS, part_tokens: int = PART_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod 10 is not 0 (null id: held out) and scores
    all. Null and empty texts are the end token alone. Repeated rows stay; they count each. Other
    columns are ignored. Without training rows every count is 0; an empty table gives no rows. Broadcast: at most
    ``top_words`` words with their counts and numbers of successors, as an encoding; the scores do not depend on it. Rarer
    words' counts are met in a shuffle. Words are 64-bit hashes. A repeated task must find its rows in the same
    order, as rows read from files are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", crc_bucket(F.col("id"), 10) == 0)
    id_kind = rows.schema["id"].dataType.simpleString()

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate([*gathered, np.zeros(0, np.uint64)]), return_counts=True)
            gathered.clear()
            return pa.RecordBatch.from_pydict({"word": word.view(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                gathered.append(hashes_of(data, offsets)[1])
                if sum(map(len, gathered)) >= 4 * BLOCK_TOKENS:
                    yield flush()
        yield flush()

    train_docs = rows.where(~F.col("held_out"))
    counts = cut(train_docs.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = train_docs.count()
    total, types = n_words + n_docs, n_types + (n_docs > 0)
    levels = sorted((r["l"], r["k"]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("l")).agg(F.count(F.lit(1)).alias("k")).collect())
    least = 0
    while sum(k for level, k in levels if level >= least) > top_words:
        least += 1
    is_top = F.col("n") >= (1 << least)
    table = counts.where(is_top).toArrow()  # at most top_words rows
    words, freq = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    rank = np.lexsort((words, -freq))
    words, freq = words[rank], freq[rank]
    order = np.argsort(words)
    norm = total + 0.1 * (types + 1)
    # a rare word is in up to three trigrams: a quarter of a part's ids on average
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_TOKENS)), -(-total // part_tokens), -(-12 * int(n_words - freq.sum()) // RARE_IDS), 1)
    tasks = min(parts, PARTITIONS)
    places = min(max(1, -(-int(n_types - len(words)) // PLACE_WORDS), min(parts, 2)), PARTITIONS)
    shared = spark.sparkContext.broadcast((words[order], order.astype(np.uint32), freq))

    def shares() -> np.ndarray:
        """The unigram share of every id."""
        p = np.zeros(RARE)
        p[: len(shared.value[2])] = (shared.value[2] + 0.1) / norm
        p[END] = ((n_docs + 0.1) if n_docs else 0.1) / norm
        return p

    def ids_of(h: np.ndarray) -> np.ndarray:
        """Ids of frequent words, the hashes of others."""
        known, ids, _ = shared.value
        if not len(known):
            return h
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, ids[at].astype(np.uint64), h)

    def classes_of() -> np.ndarray:
        """The number of classes that each id's left words are dealt by; the last is for all rare words."""
        freq_all = np.zeros(RARE + 1, np.int64)
        freq_all[: len(shared.value[2])] = shared.value[2]
        return np.maximum(1, -(-2 * parts * freq_all // max(1, total))).astype(np.uint32)

    def part_of(v: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return (mix(v * np.uint64(4099) + kind) % np.uint64(parts)).astype(np.uint32)

    class Flow:
        """Texts as one flow of tokens, each text closed by END: gathered over batches, taken in blocks."""

        def __init__(self):
            self.held, self.size, self.block = [], 0, TaskContext.get().partitionId() << 32

        def add(self, batch: pa.RecordBatch) -> Iterator[tuple]:
            train = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                row, h = hashes_of(data, offsets)
                ends = np.cumsum(np.bincount(row, minlength=n) + 1)
                tokens = np.full(int(ends[-1]), END, np.uint64)
                tokens[np.arange(len(row)) + row] = ids_of(h)
                self.held.append((tokens, np.diff(ends, prepend=0), batch.column(0).slice(first, n), train[first : first + n]))
                self.size += len(tokens)
                if self.size >= BLOCK_TOKENS:
                    yield self.take()

        def take(self) -> tuple:
            """The block's number, tokens, lengths of its texts, their ids, whether they are learnt from."""
            out = self.block, *(np.concatenate([x[i] for x in self.held]) for i in (0, 1)), pa.concat_arrays([x[2] for x in self.held]), np.concatenate([x[3] for x in self.held])
            self.held, self.size, self.block = [], 0, self.block + 1
            return out

        def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                yield from self.add(batch)
            if self.held:
                yield self.take()

    def trigrams_of(tokens: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> Iterator[tuple]:
        """Pieces of (v, u, w as ids, rare words' hashes, part, position in tokens): what ends within a piece. A long text makes several."""
        begins = np.zeros(len(tokens), bool)
        begins[np.cumsum(lengths) - lengths] = True
        for start in range(0, len(tokens), RARE_IDS - 2):
            low = max(0, start - 2)
            piece, begin = tokens[low : start + RARE_IDS - 2], begins[low : start + RARE_IDS - 2]
            own, rare = localized(piece)
            at = np.arange(start - low, len(piece))
            at = at[~begin[at]]
            second = begin[at - 1]
            left = lambda x: np.where(second, np.uint64(BEGIN), x[at - 2])  # noqa: E731, B023
            v, u = piece[at - 1], left(piece)
            part = part_of(v, mix(u) % classes[np.minimum(v, np.uint64(RARE)).astype(np.int64)])
            yield own[at - 1], left(own), own[at], rare, part, at + low

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of words with several classes: the pairs (v, w), how often they are learnt, and which parts ask for them."""
        classes = classes_of()
        for _, tokens, lengths, _, train in Flow().blocks(batches):
            learnt = np.repeat(train, lengths)
            for v, _, w, rare, part, at in trigrams_of(tokens, lengths, classes):
                keep = np.flatnonzero(classes[np.minimum(v, np.uint64(RARE)).astype(np.int64)] > 1)
                asking, part = np.unique(part[keep], return_inverse=True)
                key = (((v[keep] << np.uint64(ID_BITS)) | w[keep]) << np.uint64(ID_BITS)) | part.astype(np.uint64)
                key, times = summed([(key, learnt[at[keep]].astype(np.int64))])
                pair, part = key >> np.uint64(ID_BITS), asking[(key & ID_MASK).astype(np.int64)]
                word = pair & ID_MASK
                far = word >= RARE
                word[far] = mix(rare[(word[far] - np.uint64(RARE)).astype(np.int64)])
                to = (mix((pair >> np.uint64(ID_BITS)) * np.uint64(4099) + word) % np.uint64(tasks)).astype(np.uint32)
                for task, own in by_number(to):
                    k, used = tightened(pair[own], rare, 2)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([task], pa.int32()), "data": [pack(*columns_of(k, 2), part[own].astype("<u4"), times[own].astype("<u4"))], "rare": [pack(gaps(used))]})

    def pair_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the pairs and sends to each part what it asks for; rows without a part have numbers of successors."""
        held, words_seen = [], RareWords()
        for batch in batches:
            for data, rare in zip(batch.column("data").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                *columns, part, times = unpack(data, "<u4", "<u4", "<u4", "<u4")
                held.append((renamed(keys_of(columns), words_seen.of(np.cumsum(unpack(rare, "<u8")[0], dtype=np.uint64)), 2), part, times.astype(np.int64)))
        if not held:
            return
        # ids by ascending hash
        ids = np.argsort(np.argsort(words_seen.words())).astype(np.uint64) + np.uint64(RARE)
        rare = words_seen.hashes
        key, part, times = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        key = renamed(key, ids, 2)
        order = np.lexsort((part, key))
        key, part, times = key[order], part[order], times[order]
        start, of = starts_of(key)
        total_of = np.add.reduceat(times, start)
        # pairs that are only asked for go along, so that each part has all contexts that it meets
        once = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        v, n = np.unique(key[start][total_of > 0] >> np.uint64(ID_BITS), return_counts=True)
        yield pa.RecordBatch.from_pydict({"part": pa.nulls(1, pa.int32()), "data": [pack(v.astype("<u4"), n.astype("<u4"))], "rare": pa.nulls(1, pa.binary())})
        key, part, times = key[once], part[once], total_of[of][once]
        for target, own in by_number(part):
            k, used = tightened(key[own], rare, 2)
            yield pa.RecordBatch.from_pydict({"part": pa.array([target], pa.int32()), "data": [pack(*columns_of(k, 2), times[own].astype("<u8"))], "rare": [pack(gaps(used))]})

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v, n = unpack(data, "<u4", "<u4")
                yield pa.RecordBatch.from_pydict({"v": v.astype(np.int64), "n": n.astype(np.int64)})

    pair_kind = "part int, data binary, rare binary"
    pairs = rows.mapInArrow(pair_counts, pair_kind).repartitionById(tasks, F.col("part")).mapInArrow(pair_totals, pair_kind)
    pairs = cut(pairs)
    kinds = pairs.where("part IS NULL").select("data").mapInArrow(successors, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toArrow()  # at most top_words rows
    order = np.argsort(kinds["v"].to_numpy())
    split_v, split_n = kinds["v"].to_numpy()[order].astype(np.uint64), kinds["n"].to_numpy()[order]
    contexts = spark.sparkContext.broadcast((split_v, freq[split_v.astype(np.int64)], split_n))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of trigrams by part: keys ascending, how often each, and in which text of the block; and a row of the texts' own figures."""
        classes, share = classes_of(), shares()
        log_share, codes = np.log10(np.maximum(share, 1e-300)), code(share).astype(np.int64)
        for block, tokens, lengths, ids, train in Flow().blocks(batches):
            n, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            top = tokens < RARE
            base = np.bincount(owner[top], log_share[tokens[top].astype(np.int64)], n)
            first = tokens[np.cumsum(lengths) - lengths]
            rare_first = first >= RARE
            first_code = np.where(rare_first, 0, codes[np.minimum(first, np.uint64(END)).astype(np.int64)])
            head = pack(~train, lengths.astype("<i8"), (np.bincount(owner[top], minlength=n) - (n_docs == 0)).astype("<i8"), base, first_code.astype("<i8"), np.where(rare_first, first, np.uint64(0)))
            yield row(block % parts, block, head=head, ids=ids)
            learnt = np.packbits(train).tobytes()
            for v, u, w, rare, part, at in trigrams_of(tokens, lengths, classes):
                keys, text = (v << np.uint64(2 * ID_BITS)) | (u << np.uint64(ID_BITS)) | w, owner[at]
                for p, own in by_number(part):
                    own = own[np.argsort(keys[own])]
                    k, t = keys[own], text[own].astype("<u4")
                    start, _ = starts_of(k)
                    k, used = tightened(k[start], rare, 3)
                    times = np.diff(np.append(start, len(t))).astype("<u4")
                    yield row(p, block, pack(*columns_of(k, 3), times, t, np.frombuffer(learnt, np.uint8)), pack(gaps(used)))

    def row(part: int, block: int, data: bytes | None = None, rare: bytes | None = None, head: bytes | None = None, ids: pa.Array | None = None) -> pa.RecordBatch:
        lists = pa.nulls(1, list_kind) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(list_kind)
        columns = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (data, rare, head)), lists]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "data", "rare", "head", "ids"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes one part after the other: gathers its rows, compressed as they are, in memory or, beyond KEPT_BYTES, in a local file."""
        now, part = None, None
        for batch in batches:
            numbers = batch.column("part").to_numpy()
            start, _ = starts_of(numbers)
            for a, b in zip(start, np.append(start, len(numbers))[1:], strict=True):
                if numbers[a] != now:
                    if part is not None:
                        yield from part.answers()
                    now, part = numbers[a], Part()
                yield from part.add(batch.slice(a, b - a))
        if part is not None:
            yield from part.answers()

    class Part:
        """One part's rows: counts their training trigrams, then scores them."""

        def __init__(self):
            self.spool, self.writer = tempfile.SpooledTemporaryFile(KEPT_BYTES), None
            self.gathered, self.most, self.pairs, self.words = [], 4 * BLOCK_TOKENS, [], RareWords()
            #: of each rare word met as the last of a trigram: block, text, word and its terms
            self.rare: list[tuple[np.ndarray, ...]] = []

        def keys(self, data: bytes, rare: bytes, *kinds: str) -> list[np.ndarray]:
            *columns, _ = got = unpack(data, *kinds)
            places = 3 if len(kinds) > 3 else 2
            own = self.words.of(np.cumsum(unpack(rare, "<u8")[0], dtype=np.uint64))
            return [renamed(keys_of(columns[:places]), own, places), *got[places:]]

        def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in range(batch.num_rows):
                block, data, rare, head = (batch.column(c)[r].as_py() for c in ("block", "data", "rare", "head"))
                if head is not None:
                    first = unpack(head, "?", "<i8", "<i8", "<f8", "<i8", "<u8")[-1]
                    at = np.flatnonzero(first)
                    self.rare.append((np.full(len(at), block), at, first[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
                    yield told(block, head=batch.column("head").slice(r, 1), ids=batch.column("ids").slice(r, 1).cast(list_kind))
                elif block is None:
                    self.pairs.append((data, rare))
                else:
                    if self.writer is None:
                        kept = batch.select(["block", "data", "rare"])
                        self.writer = pa.ipc.new_stream(self.spool, kept.schema)
                    self.writer.write_batch(batch.select(["block", "data", "rare"]).slice(r, 1))
                    k, times, text, learnt = self.keys(data, rare, "<u4", "<u4", "<u4", "<u4", "<u4", "u1")
                    times = times.astype(np.int64)
                    seen = np.add.reduceat(np.unpackbits(learnt)[text].astype(np.int64), np.cumsum(times) - times)
                    self.gathered.append((k, seen))
                    if sum(len(x[0]) for x in self.gathered) > self.most:
                        self.gathered = [summed(self.gathered)]
                        self.most = max(self.most, 2 * len(self.gathered[0][0]))

        def answers(self) -> Iterator[pa.RecordBatch]:
            if self.writer is not None:
                self.writer.close()
                with tempfile.TemporaryDirectory() as name:
                    yield from self.scores(Path(name))
            self.spool.close()
            block, text, word, a, b = (np.concatenate([x[i] for x in self.rare]) if self.rare else np.zeros(0, np.int64) for i in range(5))
            for dest, own in by_number((mix(word.astype(np.uint64)) % np.uint64(places)).astype(np.uint32)):
                own = own[np.argsort(word[own], kind="stable")]
                names, at = np.unique(block[own], return_inverse=True)
                data = pack(gaps(word[own].astype(np.uint64)), at.astype("<u4"), text[own].astype("<u4"), a[own].astype("<u4"), b[own].astype("<u4"), names.astype("<i8"))
                yield told(None, pa.array([data], pa.binary()), dest=dest)

        def scores(self, folder: Path) -> Iterator[pa.RecordBatch]:
            pairs = []
            for data, rare in self.pairs:
                k, times = self.keys(data, rare, "<u4", "<u4", "<u8")
                pairs.append((k, times.astype(np.int64)))
            self.pairs.clear()
            keys, counts = summed(self.gathered)
            self.gathered.clear()
            learnt = counts > 0
            trie = Trie(keys[learnt], counts[learnt], shares(), folder, summed(pairs), contexts.value, ID_BITS)
            del counts, learnt
            # each distinct trigram is looked up once
            codes_of, seen_of, off_of = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool), np.zeros(len(keys), np.int32)
            for at in range(0, len(keys), ASKED):
                some = slice(at, at + ASKED)
                codes_of[some], seen_of[some], off_of[some] = trie.terms(keys[some])
            pairs.clear()
            by_id = self.words.words()
            self.spool.seek(0)
            for batch in pa.ipc.open_stream(self.spool):
                block, data, rare = (batch.column(c)[0].as_py() for c in ("block", "data", "rare"))
                k, times, text, _ = self.keys(data, rare, "<u4", "<u4", "<u4", "<u4", "<u4", "u1")
                at = np.searchsorted(keys, k)
                codes, seen, off = codes_of[at].astype(np.int64), seen_of[at], off_of[at].astype(np.int64)
                last = (k & ID_MASK).astype(np.int64)
                far = last >= RARE
                cost = np.bincount(text, np.repeat(np.where(far, 0, codes), times))
                own = np.flatnonzero(cost)
                yield told(block, pa.array([pack(gaps(own).astype("<u4"), cost[own].astype("<i8"))], pa.binary()))
                often = times[far]
                spots = np.repeat(far, times)
                word = np.repeat(by_id[last[far] - RARE], often)
                self.rare.append((np.full(len(word), block), text[spots].astype(np.int64), word, np.repeat(np.where(seen[far], codes[far] + 1, 0), often), np.repeat(off[far], often)))

    def told(block: int | None, data: pa.Array | None = None, head: pa.Array | None = None, ids: pa.Array | None = None, dest: int | None = None) -> pa.RecordBatch:
        if dest is None:
            dest = int(mix(np.array([block], np.uint64))[0] % np.uint64(places))
        empty = pa.nulls(1, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([dest], pa.int32()), pa.array([1], pa.int32()), pa.array([block], pa.int64()), empty if data is None else data, empty if head is None else head, pa.nulls(1, list_kind) if ids is None else ids], ["dest", "kind", "block", "data", "head", "ids"])

    def known_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words and counts, as they are met."""
        for batch in batches:
            word, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for dest, own in by_number((mix(word) % np.uint64(places)).astype(np.uint32)):
                own = own[np.argsort(word[own])]
                yield pa.RecordBatch.from_pydict({"dest": pa.array([dest], pa.int32()), "kind": pa.array([0], pa.int32()), "block": pa.nulls(1, pa.int64()), "data": [pack(gaps(word[own]), n[own].astype("<u4"))], "head": pa.nulls(1, pa.binary()), "ids": pa.nulls(1, list_kind)})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words meet their counts; a block's sums go back to it, other rows pass."""
        known, word, count = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        met: list[tuple[np.ndarray, ...]] = []
        nothing = pa.nulls(1, pa.binary())

        def sums() -> Iterator[pa.RecordBatch]:
            block, text, n, a, b = (np.concatenate([x[i] for x in met]) for i in range(5))
            met.clear()
            share = (n + 0.1) / norm
            score = np.log10(np.where(a > 0, 10.0 ** (-(a.astype(np.float64) - 1) / STEP), 0) + 10.0 ** (-b.astype(np.float64) / STEP) * share)
            names, at = np.unique(block, return_inverse=True)
            for i, own in by_number(at):
                texts, spot = np.unique(text[own], return_inverse=True)
                total_of = lambda x: np.bincount(spot, x[own], len(texts))  # noqa: E731, B023
                data = pack(texts.astype("<u4"), total_of(n > 0).astype("<i8"), total_of(np.log10(share)), total_of(score))
                yield pa.RecordBatch.from_arrays([pa.array([names[i]], pa.int64()), nothing, pa.array([data], pa.binary()), nothing, pa.nulls(1, list_kind)], ["block", "data", "rare", "head", "ids"])

        for batch in batches:
            for r in range(batch.num_rows):
                data = batch.column("data")[r].as_py()
                if batch.column("kind")[r].as_py() == 0:
                    known.append(unpack(data, "<u8", "<u4"))
                    continue
                if batch.column("block")[r].is_valid:
                    yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), batch.column("data").slice(r, 1), nothing, batch.column("head").slice(r, 1), batch.column("ids").slice(r, 1).cast(list_kind)], ["block", "data", "rare", "head", "ids"])
                    continue
                if known:
                    word, count = np.concatenate([word, *(np.cumsum(x[0], dtype=np.uint64) for x in known)]), np.concatenate([count, *(x[1].astype(np.int64) for x in known)])
                    order = np.argsort(word)
                    word, count = word[order], count[order]
                    known = []
                asked, at, text, a, b, names = unpack(data, "<u8", "<u4", "<u4", "<u4", "<u4", "<i8")
                asked = np.cumsum(asked, dtype=np.uint64)
                n = np.zeros(len(asked), np.int64)
                if len(word):
                    place = np.minimum(np.searchsorted(word, asked), len(word) - 1)
                    n = np.where(word[place] == asked, count[place], 0)
                met.append((names[at], text, n, a, b))
                if sum(len(x[0]) for x in met) >= BLOCK_TOKENS:
                    yield from sums()
        if met:
            yield from sums()

    def added(told: pa.Table) -> pa.Table:
        """A block's texts: their own figures and all parts' sums."""
        heads, ids = (told.filter(told["head"].is_valid()).column(c).combine_chunks() for c in ("head", "ids"))
        held_out, n_tokens, n_known, base, cost, _ = unpack(heads[0].as_py(), "?", "<i8", "<i8", "<f8", "<i8", "<u8")
        n_known, base, cost, score = n_known.copy(), base.copy(), cost.copy(), np.zeros(len(cost))
        for data, rare in zip(told["data"].to_pylist(), told["rare"].to_pylist(), strict=True):
            if data is not None:
                text, x = unpack(data, "<u4", "<i8")
                cost[np.cumsum(text)] += x
            if rare is not None:
                text, n, logs, x = unpack(rare, "<u4", "<i8", "<f8", "<f8")
                n_known[text] += n
                base[text] += logs
                score[text] += x
        return pa.table({"id": ids.flatten(), "held_out": held_out, "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score - cost / STEP})

    list_kind = pa.list_(pa.field("element", rows.select("id").limit(0).toArrow().schema.field("id").type))
    dealt_kind = f"part int, block long, data binary, rare binary, head binary, ids array<{id_kind}>"
    answer_kind = f"dest int, kind int, block long, data binary, head binary, ids array<{id_kind}>"
    sent = pairs.where("part IS NOT NULL").select("part", F.lit(None).cast("long").alias("block"), "data", "rare", F.lit(None).cast("binary").alias("head"), F.lit(None).cast(f"array<{id_kind}>").alias("ids"))
    dealt = rows.mapInArrow(blocks, dealt_kind).unionByName(sent)
    # a task has its parts one after the other
    dealt = dealt.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    answers = dealt.mapInArrow(answer, answer_kind).unionByName(counts.where(~is_top).select("word", "n").mapInArrow(known_counts, answer_kind))
    answers = answers.repartitionById(places, F.col("dest")).sortWithinPartitions("kind").mapInArrow(look_up, f"block long, data binary, rare binary, head binary, ids array<{id_kind}>")
    done = answers.groupBy("block").applyInArrow(added, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
