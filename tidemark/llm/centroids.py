"""Centroid clustering by sort-means, in exact integers.

Vectors become integers floor(scale * x); centroids start at the vectors whose hash is
least.  Each round orders, for every centroid, the others by their distance from it.  A
vector scans that order from the centroid it had before and stops at the first centroid
strictly farther from that one than twice the vector's own distance to it: by the
triangle inequality no later one is as near.  Then every centroid that has vectors moves
to the floor of their mean, component by component; empty ones stay.

The rows of a round are written with their assignment, and each task adds the sums of its
rows by centroid to the same table, so that a round reads and writes the vectors once and
the driver gets one row a centroid.  All sums and distances are exact: products are taken
in doubles only where every partial sum stays below 2**53, else in 64-bit integers.

Cases: vectors that are null, of another length than ``dims`` or hold a null or
non-finite component are left out; components beyond +-2**27 / scale count as that bound,
so that squared distances fit a long (for 256: 524,288); fewer vectors than ``k`` give as many centroids; an empty
table gives no rows; ties go to the smaller centroid number; rows that repeat an id are
vectors of their own (equal hashes: by components), a null id hashes as the empty text;
further columns are not read, and the result has only its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Largest component, so that a squared distance fits a long at 64 components.
MOST = 1 << 27
#: Rows that a step holds.
ROWS = 1 << 13


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others by distance from it (ties: smaller number), and those squared distances."""
    apart = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids), exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and the number of distances that the scan evaluated."""
    order, apart = known or orders(centroids)
    cluster, distance, looked = before.copy(), np.zeros(len(x), np.int64), 0
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = squared(x[rows], centroids[c : c + 1])[:, 0]
        # scanned: every centroid not farther than twice the distance, apart**2 <= 4 * own
        scan = np.searchsorted(-(-apart[c] // 4), own, "right")
        far = np.argsort(-scan, kind="stable")
        rows, own, scan = rows[far], own[far], scan[far]
        best, at = own.copy(), np.full(len(rows), c)
        n = np.searchsorted(-scan, -np.arange(1, len(order[c]) + 1), "right")  # rows that come to each place of the order
        looked += len(rows) + int(n.sum())
        for j in range(int(scan.max(initial=0))):
            other, m = order[c, j], n[j]
            d = squared(x[rows[:m]], centroids[other : other + 1])[:, 0]
            better = (d < best[:m]) | ((d == best[:m]) & (other < at[:m]))
            best[:m][better], at[:m][better] = d[better], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance, looked


def whole(embedding: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of ``dims`` finite components, their integer vectors)."""
    if isinstance(embedding, pa.ChunkedArray):
        embedding = embedding.combine_chunks()
    some = np.flatnonzero(np.asarray(embedding.value_lengths().fill_null(-1)) == dims)
    x = np.asarray(embedding.take(pa.array(some)).flatten().cast(pa.float64()).fill_null(np.nan), np.float64).reshape(-1, dims)
    finite = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return some[finite], np.clip(np.floor(x[finite] * scale), -MOST, MOST).astype(np.int64)


def _step(centroids: np.ndarray):
    """Rows (id, vector, cluster) with their new cluster and distance, and per task the count, sums and distances by cluster."""
    k, dims = centroids.shape
    known = orders(centroids)
    names = ["id", "vector", "cluster", "distance", "n", "sums"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, object)
        kind = None
        for b in batches:
            kind = b.column(0).type
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
                cluster, distance, _ = assign(x, part.column(2).to_numpy().astype(np.int64), centroids, known)
                by = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[by], return_index=True)
                n[own] += np.diff(np.r_[first, len(by)])
                sums[own] += np.add.reduceat(x[by], first, axis=0)
                for c in own:  # Python integers: a sum of distances may pass 64 bits
                    total[c] += sum(distance[cluster == c].tolist())
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), none.cast(pa.int64()), none.cast(pa.list_(pa.string()))], names)
        own = np.flatnonzero(n)
        if len(own):
            told = [[str(total[c]), *map(str, sums[c].tolist())] for c in own]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), kind), pa.nulls(len(own), pa.binary()), pa.array(own.astype(np.int32)), pa.nulls(len(own), pa.int64()), pa.array(n[own]), pa.array(told, pa.list_(pa.string()))], names)

    return step


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) for every vector that has ``dims`` finite components.

    ``centroid`` is the final one of the cluster, as integers; inertias beyond a long are cut to its largest value.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole(b.column(1), dims, scale)
            ids = b.column(0).take(pa.array(rows))
            vector = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vector, pa.array(np.zeros(len(rows), np.int32))], ["id", "vector", "cluster"])

    table = scratch.written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(read, f"id {kind}, vector binary, cluster int"), "cluster-vectors")
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = table.select(hash_.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    if not first:
        return table.selectExpr("id", "cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "array(0) AS centroid").limit(0)
    centroids = np.stack([np.frombuffer(r.vector, "<i4") for r in first]).astype(np.int64)
    fields = f"id {kind}, vector binary, cluster int, distance long, n long, sums array<string>"
    for turn in range(rounds + 1):
        after = scratch.written(table.mapInArrow(_step(centroids), fields), "cluster-round")
        # a task has at most one row a centroid; Spark adds them up place by place
        at = F.posexplode("sums").alias("at", "part")
        parts = after.where("n is not null").select("cluster", "n", at).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        sums = parts.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "total"))).alias("totals")).collect()
        scratch.remove(table)
        table = after.where("n is null").select("id", "vector", "cluster", "distance")
        table._scratch_path = after._scratch_path
        if turn < rounds:
            for r in sums:
                centroids[r.cluster] = [int(t.total) // r.n for t in r.totals[1:]]
    inertia = {r.cluster: int(r.totals[0].total) for r in sums}
    most = 2**63 - 1
    told = [(c, min(most, n), min(most, sum(inertia.values())), centroids[c].tolist()) for c, n in inertia.items()]
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))  # k rows
    return table.join(told, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, np.asarray(centroid).tolist())).encode()).hexdigest()
