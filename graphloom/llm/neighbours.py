"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is its centroid plus a residual; the residual is rotated at random and
kept as its signs, its length and the inner product of the signs with its
direction. A query is rotated as well and its components are rounded to a few bits, so that
the inner product is estimated from the packed signs by counting the bits that they share
with each bit plane of the query. Vectors whose estimate plus its error bound reaches the
k-th best found so far are computed exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, queries in a block, and vectors that one task compares with a block of queries.
BLOCK, QUERY_BLOCK, TASK_VECTORS = 4096, 4096, 1 << 20
#: Bits of a query's components.
QUERY_BITS = 4
#: Standard errors of the bounds; about 1 in 70 estimates lies beyond them on the side that loses a vector.
EPSILON = 2.2


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, or of floats where the column has floats (a float is a double without loss)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def packed_signs(rest: np.ndarray) -> np.ndarray:
    """The signs of each row as 64-bit words, padded with zeros."""
    bits = np.packbits(rest > 0, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def centroid(rows: DataFrame, dim: int) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total, n = total + x.sum(0, dtype=np.float64), n + len(x)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim + 1), "s": np.append(total, n)})

    parts = rows.select("v").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # dim + 1 rows
    got = {r["i"]: r["s"] for r in parts}
    return np.array([got.get(i, 0.0) for i in range(dim)]) / max(1.0, got.get(dim, 0.0))


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``y``, summed in the order of the components."""
    return np.cumsum(x * y, axis=1)[:, -1]


class Block:
    """Vectors with their codes, as bytes in a row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.codes, self.shared_bits = np.ascontiguousarray(codes.T), np.bitwise_count(codes).sum(1).astype(np.float64)
        length, fit = scalars
        dim = vectors.shape[1]
        #: what a unit of the signs' inner product and of a query's length are worth
        self.unit = length / (fit * np.sqrt(dim))
        self.error = length * np.sqrt(np.maximum(0, 1 - fit**2)) / (fit * np.sqrt(max(1, dim - 1)))
        self.longest = float(np.sqrt((self.vectors**2).sum(1).max())) if len(ids) else 0.0


class Best:
    """The best found for the queries of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors, self.k = ids, vectors.astype(np.float64), k
        self.base, self.length = self.vectors @ centre, np.sqrt((self.vectors**2).sum(1))
        turned = self.vectors @ turn.T
        # components as low + step * whole numbers, these as bit planes
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        whole = np.clip(np.nan_to_num(np.rint((turned - self.low[:, None]) / self.step[:, None])), 0, (1 << QUERY_BITS) - 1).astype(np.int64)
        self.total = turned.shape[1] * self.low + self.step * whole.sum(1)
        self.planes = [packed_signs((whole >> b) & 1) for b in range(QUERY_BITS)]
        self.found, self.score = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)

    def bounds(self, block: Block, j: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the vectors' inner products with a query, and what they may be short of."""
        dot = np.zeros(len(block.ids), np.int32)
        for b, planes in enumerate(self.planes):
            for word, plane in zip(block.codes, planes[j], strict=True):
                dot += np.left_shift(np.bitwise_count(word & plane), b, dtype=np.int32)
        estimate = block.unit * (2 * self.step[j] * dot + (2 * self.low[j] * block.shared_bits - self.total[j]))
        return estimate + self.base[j], epsilon * self.length[j] * block.error

    def likely(self, block: Block, j: int, epsilon: float) -> np.ndarray:
        """Positions of the vectors whose upper bound reaches the k-th best known: so far, or of this block's best by estimate."""
        if epsilon == np.inf:
            return np.flatnonzero(block.ids != self.ids[j])
        estimate, error = self.bounds(block, j, epsilon)
        estimate[block.ids == self.ids[j]] = -np.inf
        floor = self.score[j][-1] if len(self.score[j]) == self.k else -np.inf
        if floor == -np.inf and len(estimate) > 2 * self.k:
            best = np.argpartition(estimate, -2 * self.k)[-2 * self.k :]
            best = best[block.ids[best] != self.ids[j]]
            floor = np.partition(block.vectors[best] @ self.vectors[j], -self.k)[-self.k] if len(best) >= self.k else floor
        # estimates that overflow are computed
        return np.flatnonzero(~(estimate + error < floor) & (block.ids != self.ids[j]))

    def take(self, block: Block, epsilon: float) -> None:
        for j, score in enumerate(self.score):
            at = self.likely(block, j, epsilon)
            rough = block.vectors[at] @ self.vectors[j]
            # sums in another order differ by rounding: what may be among the best is summed again
            slack = 1e-10 * self.length[j] * block.longest
            floor = score[-1] if len(score) == self.k else -np.inf
            if len(at) > self.k:
                floor = np.fmax(floor, np.partition(rough, -self.k)[-self.k])
            at = at[~(rough < floor - slack)]
            if len(at):
                ids, score = np.append(self.found[j], block.ids[at]), np.append(score, inner(block.vectors[at], self.vectors[j]))
                order = np.lexsort((ids, -score))[: self.k]
                self.found[j], self.score[j] = ids[order], score[order]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(self.ids, [len(f) for f in self.found])
        return pa.RecordBatch.from_pydict({"query_id": query, "vec_id": np.concatenate([*self.found, np.zeros(0, np.int64)]), "score": np.concatenate([*self.score, np.zeros(0)])})


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, seed: int = 11, epsilon: float = EPSILON, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, rows of its own id left out.

    Vectors that are null or zero, or hold null or non-finite components, and rows without an id
    take no part. Vectors of one length are compared with each other only. Every row is a candidate, repeated
    ones as often as they come; an id with several rows asks with the smallest of its vectors. Ties go to the
    smaller id. ``epsilon`` standard errors of the estimate bound what is computed exactly: the scores are
    always exact, what is found is nearly all (infinite: all). Queries are a fixed share of the rows and meet
    all vectors in blocks: a task keeps one block of vectors, one of queries and k rows for each query. The
    only broadcast are the rotation and the centroid.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("queries")).where("queries > 0").orderBy("dim").collect()  # one row a length
    found = None
    for shape in shapes:
        part = _nearest(rows.where(F.size("v") == shape["dim"]), shape["dim"], shape["n"], shape["queries"], k, seed, epsilon)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest(rows: DataFrame, dim: int, total: int, n_queries: int, k: int, seed: int, epsilon: float) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((rotation(dim, seed), centroid(rows, dim)))
    kind_of = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(-(-total // TASK_VECTORS), min(-(-partitions // query_blocks), -(-total // BLOCK)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centre = shared.value
        salt = TaskContext.get().partitionId()
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for s in range(0, len(ids), BLOCK):
                rest = (x[s : s + BLOCK] - centre) @ turn.T
                length = np.linalg.norm(rest, axis=1)
                fit = np.where(length > 0, np.abs(rest).sum(1) / np.sqrt(dim) / np.where(length > 0, length, 1), 1)
                scalars = np.stack([length, np.where(fit > 0, fit, 1)])
                salt = (salt + 1) % salts
                yield row(1, salt, 0, ids[s : s + BLOCK], x[s : s + BLOCK], packed_signs(rest).tobytes(), scalars.tobytes())

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for b in np.unique(at):
                yield row(0, 0, int(b), ids[at == b], x[at == b], b"", b"")

    def row(kind: int, salt: int, at: int, ids: np.ndarray, x: np.ndarray, codes: bytes, scalars: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "kind": pa.array([kind], pa.int32()), "salt": pa.array([salt], pa.int32()), "at": pa.array([at], pa.int32()),
            "ids": [np.ascontiguousarray(ids, np.int64).tobytes()], "v": [x.astype(kind_of).tobytes()], "codes": [codes], "scalars": [scalars],
        })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centre = shared.value
        now, asked, best = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch[name][r].as_buffer(), kind)
                if (task := batch["task"][r].as_py()) != now:
                    if best is not None:
                        yield best.rows()
                    now, asked, best = task, [], None
                ids, x = get("ids", np.int64), get("v", kind_of).reshape(-1, dim)
                if batch["kind"][r].as_py() == 0:
                    asked.append((ids, x))
                elif asked:
                    best = best or Best(*(np.concatenate([a[i] for a in asked]) for i in (0, 1)), k, centre, turn)
                    best.take(Block(ids, x, get("codes", np.uint64).reshape(len(ids), -1), get("scalars", np.float64).reshape(2, -1)), epsilon)
        if best is not None:
            yield best.rows()

    schema = "kind int, salt int, at int, ids binary, v binary, codes binary, scalars binary"
    data = rows.select("id", "v").mapInArrow(blocks, schema).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("at"))
    asked = queries.mapInArrow(asking, schema).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asked.unionByName(data).withColumn("task", F.col("at") * salts + F.col("salt"))
    met = met.repartitionById(query_blocks * salts, "task").sortWithinPartitions("task", "kind")
    found = met.select("task", "kind", "ids", "v", "codes", "scalars").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
