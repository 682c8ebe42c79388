"""Centroid clustering in integers, with Orchard's search for the nearest centroid.

Each centroid has the list of all centroids, nearest first. A vector starts at some centroid and walks that
centroid's list; whenever it meets a closer centroid it jumps to the beginning of that one's list. Centroids
already visited are skipped. As |c - s| > 2 |x - c| implies |x - s| > |x - c|, the walk ends at the first
list entry strictly beyond twice the vector's distance; entries at exactly twice may be ties and are visited.
All distances are squared integers, so comparisons are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut

#: Largest absolute component: squared distances of up to 64 such components stay below 2**63.
LARGEST = 1 << 27


class Orchard:
    """Exact nearest centroid by squared distance; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.int64)
        k = len(self.c)
        apart = np.array([((self.c - row) ** 2).sum(1) for row in self.c]).reshape(k, k)
        order = np.argsort(apart, axis=1, kind="stable")
        # a centroid's own list has itself first, also where another one lies at the same place
        for i in range(k):
            order[i] = np.concatenate(([i], order[i][order[i] != i]))
        self.lists, self.apart = order, np.take_along_axis(apart, order, 1)
        sums = self.c.sum(1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def start(self, x: np.ndarray) -> np.ndarray:
        """A centroid to begin with: one whose component sum is next to the vector's."""
        return self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(1)), len(self.sums) - 1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) for each row of ``x``, and how many distances were computed. All rows walk in step."""
        n, k = len(x), len(self.c)
        best = self.start(x)
        dist = ((x - self.c[best]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        at, walking, computed = np.ones(n, np.int64), np.arange(n), n
        while True:
            walking = walking[at[walking] < k]
            walking = walking[self.apart[best[walking], at[walking]] <= 4 * dist[walking]]
            if not len(walking):
                return best, dist, computed
            other = self.lists[best[walking], at[walking]]
            at[walking] += 1
            fresh = ~seen[walking, other]
            row, other = walking[fresh], other[fresh]
            seen[row, other] = True
            d = ((x[row] - self.c[other]) ** 2).sum(1)
            computed += len(row)
            closer = (d < dist[row]) | ((d == dist[row]) & (other < best[row]))
            row = row[closer]
            best[row], dist[row], at[row] = other[closer], d[closer], 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x): vectors of ``dims`` components, none null or non-finite, each as floor(scale * component)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.coalesce((F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    large = F.exists("x", lambda c: F.abs(c) > LARGEST)
    x = vectors.where(whole).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    return x.withColumn("x", F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(F.col("x")))


def first_centroids(x: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of the smallest sha256 of ``<seed>:<id>``, in that order (fewer if there are no k). Rows without an id are none."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [r["x"] for r in x.where("id is not null").orderBy(h, "x").limit(k).collect()]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(x: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of each centroid's vectors: added up in each task, then by Spark, so that k * dims rows arrive."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, k = Orchard(np.array(centroids)), len(centroids)
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            m = _matrix(b.column("x"), dims)
            best = orchard.nearest(m)[0]
            np.add.at(total[:, :dims], best, m)
            total[:, dims] += np.bincount(best, minlength=k)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"c": pa.array(c, pa.int64()), "d": pa.array(d, pa.int64()), "s": pa.array(total[c, d], pa.int64())})

    rows = x.select("x").mapInArrow(add, "c long, d long, s long").groupBy("c", "d").agg(F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    table = {(r["c"], r["d"]): r["s"] for r in rows}
    for c in {c for c, _ in table}:
        out[c] = (table[c, dims], [table.get((c, d), 0) for d in range(dims)])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """Rounds of exact integer k-means; (id, cluster, distance) of every kept vector, and the final centroids.

    A vector is kept if it has ``dims`` components, none null or non-finite; repeated rows count each. Ids may be
    null (such a row is no first centroid). With fewer vectors than k there are as many centroids as vectors, with
    none the result is empty. The driver holds k centroids and k * dims sums, whatever the number of vectors; the
    input is read once a round. A component beyond 2**27 after scaling stops the job, as distances would not fit.
    """
    x = integers(vectors, id_col, vector_col, dims, scale)
    centroids = first_centroids(x, k, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _sums(x, centroids, dims).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(np.array(centroids)) if centroids else None
        for b in batches:
            if orchard and len(b):
                best, dist, _ = orchard.nearest(_matrix(b.column("x"), dims))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best.astype(np.int32)), pa.array(dist)], ["id", "cluster", "distance"])

    kind = x.schema["id"].dataType.simpleString()
    return x.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and the centroid's sha256; joined from one row a centroid."""
    assigned = cut(assigned)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
