"""N-gram Jaccard join by prefix filters under several global token orders.

Texts with equal shingle sets form classes, and only one text a class takes part.
A pair of sets at the threshold shares a token among the first n - ceil(t*n) + 1 of
each, in whatever order all tokens are put; so a candidate must pass that filter
under two different orders, each with a bound on the overlap, before its full sets
are compared. Both orders put frequent tokens last, by level, and differ within a level.
Levels come from counts of all tokens of all texts in a table of fixed size, so what
a near copy has of its own stands first and its group's tokens are seldom in prefixes.

Classes are compared only until their components are known: in a bucket of a shared
prefix token all members first meet one pivot, and members of one component never
meet again. What is still apart then meets in full, so no component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, cut, cut_small, observed, small, text_batches
from graphloom.llm.graph import components
from graphloom.llm.words import distinct_per_row, mix, ragged, shingle_hashes, text_slices, word_hashes

#: Tokens are counted in BLOCKS * CELLS cells by their highest bits; two of one cell share a level.
BLOCKS, CELLS = 256, 1 << 16
#: Tokens that a task counts before it sends them, and parts that a block is first merged in.
FLUSH, SALTS = 1 << 20, 16
#: Bits of the map of shared tokens (16 MiB).
MAP_BITS = 27
#: Parts in which the driver fetches that map (at most 2 MiB each), however many partitions the tokens have.
MAP_PARTS = 8
#: Rounds of pivots before what is apart meets in full, and how many pairs end them earlier.
ROUNDS, PAIRS_PER_ROW = 8, 16
#: A round that leaves more than this share of the pairs apart is the last of pivots: the rest are unlike.
SHRINK = 0.7
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Sets:
    """Distinct shingle hashes of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int):
        self.rows = len(offsets) - 1
        self.row, self.token = distinct_per_row(*shingle_hashes(*word_hashes(data, offsets), shingle))
        self.n = np.bincount(self.row, minlength=self.rows)

    def cells(self) -> np.ndarray:
        return (self.token >> np.uint64(40)).astype(np.int64)

    def prefixes(self, seed: np.uint64, percent: int, levels: np.ndarray) -> pa.ListArray:
        level = levels[self.cells()]
        order = np.lexsort((mix(self.token ^ seed), level, self.row))
        row, token = self.row[order], self.token[order]
        first = np.cumsum(self.n) - self.n
        keep = np.arange(len(row)) - first[row] < prefix_length(self.n, percent)[row]
        return ragged(row[keep], signed(token[keep]), self.rows)

    def marks(self) -> list[pa.Array]:
        out = []
        for seed in SEEDS:
            total = np.zeros(self.rows, np.uint64)
            np.add.at(total, self.row, mix(self.token + seed))
            out.append(pa.array(signed(mix(total))))
        return out


def _per_text(docs: DataFrame, shingle: int, columns, schema: str) -> DataFrame:
    """(id, n, ...) of every text; ``columns(sets)`` gives the further columns."""
    names = [x.split()[0] for x in schema.split(", ")] if schema else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                sets = _Sets(data, offsets, shingle)
                made = [batch.column(0).slice(first, sets.rows), pa.array(sets.n.astype(np.int64)), *columns(sets)]
                yield pa.RecordBatch.from_arrays(made, ["id", "n", *names])

    return docs.mapInArrow(run, "id long, n long" + (f", {schema}" if schema else ""))


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells as gaps, and counts up to 2**32 - 1, compressed."""
    gaps = np.diff(cells.astype(np.uint16), prepend=np.uint16(0)).astype(np.uint16)
    return zstandard.compress(gaps.tobytes() + np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(packed)
    n = len(data) // 6
    return np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.int64), np.frombuffer(data[2 * n :], np.uint32)


def token_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """The log2 of how many texts have a token of each cell: BLOCKS * CELLS bytes whatever the input."""
    schema = "block int, salt int, counts binary"

    def blocks(cells: np.ndarray, salt: int) -> pa.RecordBatch:
        cell, count = np.unique(cells, return_counts=True)
        ends = np.searchsorted(cell, np.arange(BLOCKS + 1) * CELLS)
        held = np.flatnonzero(np.diff(ends))
        parts = [slice(ends[b], ends[b + 1]) for b in held]
        packed = [_pack(cell[p] % CELLS, count[p]) for p in parts]
        columns = [pa.array(held, pa.int32()), pa.array(np.full(len(held), salt), pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "salt", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                kept.append(_Sets(data, offsets, shingle).cells())
                n += len(kept[-1])
                if n >= FLUSH:
                    yield blocks(np.concatenate(kept), salt)
                    kept, n = [], 0
        if n:
            yield blocks(np.concatenate(kept), salt)

    def totals(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(block, np.zeros(CELLS, np.int64))
                cells, counts = _unpack(packed)
                total[cells] += counts
        return sums

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in totals(batches).items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(at, total[at])], pa.binary())], ["block", "salt", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in totals(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()], pa.binary())], ["block", "levels"])

    counted = texts.mapInArrow(count, schema).repartition("block", "salt").mapInArrow(merge, schema)
    found = counted.repartition("block").mapInArrow(level, "block int, levels binary")
    levels = np.zeros((BLOCKS, CELLS), np.uint8)
    for row in found.collect():  # at most BLOCKS rows
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


def maybe_shared(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(token, id, place) of prefix tokens, without nearly all that ``shared`` lacks: a bitmap of fixed size tells."""
    block, bit = F.shiftrightunsigned("token", 64 - MAP_BITS + 15), F.shiftrightunsigned("token", 64 - MAP_BITS).bitwiseAND(F.lit((1 << 15) - 1))
    bits = np.zeros((1 << (MAP_BITS - 15), 1 << 12), np.uint8)
    blocks = shared.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    for row in blocks.repartition(MAP_PARTS).toLocalIterator():  # at most 2**MAP_BITS bits, a job a part
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    held = sets.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy()
            token = batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            at = (token.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            keep = np.flatnonzero((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            row, pos = row[keep], pos[keep]
            place = (batch.column(1).to_numpy()[row] << 32) | pos
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column(0).take(pa.array(row)), pa.array(place)], ["token", "id", "place"])

    return sets.mapInArrow(spread, "token long, id long, place long")


def join_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``n_shingles``, ``component_id``, ``class_id``.

    Two documents link when 100 * intersection >= percent * union of their distinct word
    shingles (lower-cased A-Z; the whole sequence if it has fewer words). ``component_id`` is the
    smallest id reachable by links, the own one included; ``class_id`` the smallest id with an equal
    set. Null, empty and blank texts have the empty set and link with nothing, nor do rows
    without an id (component null). Rows of one id are one document with the links of all. Shingles
    are 64-bit hashes. Broadcast: a byte a cell of the token counts (16 MiB) and id lists below a checked size.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = cut(_per_text(rows, shingle, lambda s: s.marks(), "mark long, mark2 long"))
    linkable = first.where("n > 0 and id is not null")
    classes = linkable.groupBy("mark", "mark2", "n").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes)
    levels = docs.sparkSession.sparkContext.broadcast(token_levels(rows.select("text"), shingle))
    by_row = cut(linkable.select("id", "mark", "mark2", "n").join(classes, ["mark", "mark2", "n"]))
    # every text but its class's own is left out
    marked = "id", "mark", "mark2"
    copied = cut_small(by_row.where("id <> class_id").select(*marked).distinct())
    counted = cut(by_row.where("id = class_id and copies > 1").select("id", "copies").distinct())
    schema = "mark long, mark2 long, prefix array<long>, prefix2 array<long>"
    again = _per_text(rows, shingle, lambda s: [*s.marks(), s.prefixes(SEEDS[0], percent, levels.value), s.prefixes(SEEDS[1], percent, levels.value)], schema)
    chosen = again.where("n > 0 and id is not null").join(copied, [*marked], "left_anti")
    sets = cut(chosen.drop("mark", "mark2"))

    # narrow rows while most tokens are one text's alone
    shared = cut(sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"))
    tokens = maybe_shared(sets.select("id", "n", "prefix"), shared)
    # how many tokens before it a text shares with any other: those that none has can't be common
    before = Window.partitionBy("id", n := F.shiftright("place", 32)).orderBy("place")
    ranked = cut(tokens.join(shared, "token").withColumn("rank", F.row_number().over(before) - 1))
    # of a pair, the smaller set has its shared token among fewer: it is at most as large as the other
    ranked = ranked.select("token", "id", n.alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "rank")
    fewer = F.col("n") - F.floor((F.col("n") * (2 * percent) + 99 + percent) / (100 + percent)) + 1
    ranked = ranked.withColumn("first", F.col("pos") < fewer)
    # tokens that the same texts share make one bucket: near copies share most of their prefixes
    member = F.xxhash64("id", "n", "first"), F.xxhash64(F.lit(1), "id", "n", "first")
    by_token = ranked.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.count_if("first").alias("few"), *(F.bit_xor(m).alias(f"m{i}") for i, m in enumerate(member)))
    chosen = cut(by_token.where("few > 0").groupBy("k", "m0", "m1").agg(F.min("token").alias("token")).select("token"))
    copies = small(counted.groupBy("id").agg(F.max("copies").alias("copies")))
    buckets = cut(ranked.join(small(chosen), "token").join(copies, "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))))
    # ids with several texts tie the classes of these together
    several = by_row.groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("id", "a")
    tied = by_row.join(several, "id").select("a", F.col("class_id").alias("b")).where("a != b")
    labels = components(tied) if tied.limit(1).count() else None

    before = float("inf")
    for turn in range(ROUNDS + 1):
        active = buckets.withColumn("label", F.col("id"))
        if labels is not None:
            active = buckets.join(small(labels), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        columns = ("id", "n", "pos", "rank", "first", "label")
        # the pivot is the class with most copies at first, then any; all members meet it alone
        worth = F.least("copies", F.lit(1 << 22)) if turn == 0 else F.lit(0).cast("long")
        order = F.shiftleft(worth, 40) + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 40))
        pivot = (F.max_by(c, order).alias(f"o_{c}") for c in columns)
        apart = active.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"), F.count_if("first").alias("few"), *pivot)
        apart, seen = observed(apart.where("lo < hi"), k=F.sum("k"), pairs=F.sum(F.col("k").cast("double") * F.col("few")))
        if not seen["n"]:
            break
        n, pairs = seen["k"], seen["pairs"]
        few = F.broadcast if seen["n"] <= BROADCAST_ROWS else lambda df: df
        last = turn == ROUNDS or turn and pairs <= PAIRS_PER_ROW * n or pairs > SHRINK * before
        before = pairs
        if last:
            active = cut(active.join(few(apart.select("token")), "token"))
            other = active.select("token", *(F.col(c).alias(f"o_{c}") for c in columns))
            met = active.where("first").join(other, "token").where(f"label <> o_label and (n < o_n or n = o_n and id < o_id) and {_possible(percent)}")
        else:
            pivots = few(apart.select("token", *(f"o_{c}" for c in columns)))
            met = active.join(pivots, "token").where(f"label <> o_label and (n <= o_n and first or n >= o_n and o_first) and {_possible(percent)}")
        met = met.withColumnRenamed("o_id", "b")
        cand = candidates(met, sets, percent)
        links = verify(rows, cand, shingle, percent)
        known = links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = components(known)
        if last:
            break
    out = first.join(classes.drop("copies"), ["mark", "mark2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("class_id"))
    if labels is not None:
        out = out.join(small(labels.withColumnRenamed("id", "class_id")), "class_id", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def _possible(percent: int) -> str:
    """What a shared token's places leave possible: common tokens before it, itself and those after it."""
    most = "least(rank, o_rank) + 1 + least(n - pos - 1, o_n - o_pos - 1)"
    return f"100 * least(n, o_n) >= {percent} * greatest(n, o_n) and {100 + percent} * ({most}) >= {percent} * (n + o_n)"


def candidates(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the overlap bound in both orders."""
    pairs = met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    pairs = cut(pairs)
    wanted = cut_small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = sets.join(wanted, "id")  # few of all
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"), F.col("prefix2").alias(f"q_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def passes(x: str):
        # tokens beyond the prefix that ends first in the order can't exceed what its set has left
        rest = F.greatest(F.col("n_a") - F.size(f"{x}_a"), F.col("n_b") - F.size(f"{x}_b"))
        most = F.size(F.array_intersect(f"{x}_a", f"{x}_b")) + rest
        return F.arrays_overlap(f"{x}_a", f"{x}_b") & (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b")))

    return cut(both.where(passes("p") & passes("q")).select("a", "b").distinct())


def verify(rows: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs at or above the threshold, by full sets, made where both texts of a pair are."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = rows.join(cut_small(wanted), "id").select("id", "text")
    repeated, seen = observed(texts.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id"))
    if seen["n"]:
        again = F.broadcast(repeated) if seen["n"] <= BROADCAST_ROWS else repeated
        texts = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").distinct())
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                one, row, token = _Sets(data, offsets, shingle), [], []
                n = one.n.copy()
                for at, other, ends in text_slices(batch.column(3).slice(first, one.rows)):
                    two = _Sets(other, ends, shingle)
                    n[at : at + two.rows] += two.n
                    row.append(two.row + at)
                    token.append(two.token)
                row, token = np.concatenate([one.row, *row]), np.concatenate([one.token, *token])
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                twice = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
                shared = np.bincount(row[1:][twice], minlength=one.rows)
                linked = pa.array((shared > 0) & (100 * shared >= percent * (n - shared)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, one.rows).filter(linked) for i in (0, 1)], ["a", "b"])

    return cut(both.mapInArrow(run, "a long, b long").distinct())
