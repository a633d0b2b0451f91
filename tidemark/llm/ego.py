"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other.  Vectors
are turned onto their principal axes (an orthogonal turn keeps distances), put on a
grid of cell width eps over the leading axes, and sorted by cell: the epsilon grid
order.  The sequence is cut into intervals; interval pairs whose bounding boxes are
further apart than eps are provably without links and skipped, first among whole
intervals by table joins, then recursively within a pair.  What is left is compared
by exact cosines in double precision; those within 1e-9 of the threshold are taken again
from the vectors as given, as dot(a, b) / sqrt(dot(a, a) * dot(b, b)).  Equal vectors are folded into one row that
carries their number before anything meets.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different lengths never link; null ids count as links
but are no component's name unless alone; repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, scratch

THRESHOLD = 0.9
#: Leading principal axes of the grid.
AXES = 6
#: Most vectors and bytes of a sequence interval, vectors of the pieces that are multiplied out, intervals on a side of a task.
INTERVAL = 4096
INTERVAL_BYTES = 4 << 20
LEAF = 256
SQUARE = 4
#: Most vector components (the covariance has this squared).
MOST_DIMS = 4096
_SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.values if isinstance(col, pa.FixedSizeListArray) else col.flatten(), np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaling by the largest component first keeps squares finite and normal."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of all vectors: each task sends one dims x dims sum, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for b in batches:
            u = _unit(_matrix(b.column(0)))
            total[:dims] += u.T @ u
            total[dims] += u.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((dims + 1) * dims)), pa.array(total.ravel())], ["cell", "s"])

    sums = vectors.select("v").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    got = sums.toPandas().sort_values("cell")
    if got.empty:
        return np.eye(dims)
    m = got.s.to_numpy().reshape(dims + 1, dims)
    scatter = m[:dims] - np.outer(m[dims], m[dims]) / max(1.0, np.trace(m[:dims]))
    return np.linalg.eigh(scatter)[1][:, ::-1]


def _intervals(vectors: DataFrame, dims: int, eps: float) -> tuple[DataFrame, np.ndarray]:
    """(block, ids, weights, x, low, high): sequence intervals of the grid order with their bounding boxes, and the turn onto the axes."""
    turn = _axes(vectors, dims)
    n = vectors.count()
    rows = max(LEAF, min(INTERVAL, INTERVAL_BYTES // (8 * dims)))
    k = min(AXES, dims)
    cells = [f"c{i}" for i in range(k)]

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(2))) @ turn
            c = np.floor(x[:, :k] / eps).astype(np.int32)
            rows = pa.array([r.tobytes() for r in _matrix(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c[:, i]) for i in range(k)], rows], ["rep", "weight", *cells, "x"])

    placed = vectors.select("rep", "weight", "v").mapInArrow(grid, f"rep long, weight long, {', '.join(f'{c} int' for c in cells)}, x binary")
    placed = placed.repartitionByRange(max(1, -(-n // rows)), *cells, "rep").sortWithinPartitions(*cells, "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for a in range(0, b.num_rows, rows):
                piece = b.slice(a, rows)
                raw = np.frombuffer(b"".join(piece.column(piece.num_columns - 1).to_pylist()), np.float64).reshape(piece.num_rows, dims)
                x = _unit(raw) @ turn
                low = raw.astype(np.float32)  # half the bytes where nothing is lost
                kept = low if (low == raw).all() else raw
                row = [part + k, piece.column(0).to_numpy().tobytes(), piece.column(1).to_numpy().tobytes(), kept.tobytes(), x.min(0).tolist(), x.max(0).tolist()]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "ids", "weights", "x", "low", "high"])
                k += 1

    return scratch.written(placed.mapInArrow(cut, "block long, ids binary, weights binary, x binary, low array<double>, high array<double>"), "ego-intervals"), turn


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap)


def join_intervals(a: np.ndarray, b: np.ndarray | None, eps: float, threshold: float, found: list, off_a: int = 0, off_b: int = 0) -> None:
    """Append to ``found`` the index pairs (i in a, j in b; b None: i < j in a) with cosine >= threshold - 1e-9, and the cosines.

    Halves both sequences until the pieces are small or their boxes provably apart.
    """
    same = b is None
    if not len(a) or not same and not len(b):
        return
    other = a if same else b
    if not same and _apart(a.min(0), a.max(0), b.min(0), b.max(0)) > eps * eps + _SLACK:
        return
    if len(a) <= LEAF and len(other) <= LEAF:
        cosine = a @ other.T
        i, j = np.nonzero(cosine >= threshold - _SLACK)
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i + off_a, j + (off_a if same else off_b), cosine[i, j]))
        return
    h = (len(a) + 1) // 2
    if same:
        join_intervals(a[:h], None, eps, threshold, found, off_a)
        join_intervals(a[h:], None, eps, threshold, found, off_a + h)
        join_intervals(a[:h], a[h:], eps, threshold, found, off_a, off_a + h)
        return
    g = (len(b) + 1) // 2
    parts_a = [(a[:h], off_a), (a[h:], off_a + h)] if len(a) > LEAF else [(a, off_a)]
    parts_b = [(b[:g], off_b), (b[g:], off_b + g)] if len(b) > LEAF else [(b, off_b)]
    for x, ox in parts_a:
        for y, oy in parts_b:
            join_intervals(x, y, eps, threshold, found, ox, oy)


def _pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """(a, b) of intervals whose boxes are not provably apart, a <= b.

    Both sides are spread over the cells of the first axis that they touch (sorted
    intervals touch few), meet on a cell, and are tested on all axes.
    """
    box = intervals.select("block", "low", "high", F.floor(F.col("low")[0] / eps).alias("c0"), F.floor(F.col("high")[0] / eps).alias("c1"))
    left = box.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence("c0", "c1")).alias("c"))
    right = box.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("c"))
    gap = F.zip_with(
        F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return left.join(right, "c").where("a <= b").where(apart <= eps * eps + _SLACK).select("a", "b").distinct()


def _linked(vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(kind, u, v): kind 0 gives distinct vector u further v links, kind 1 links u and v.

    A task gets ``SQUARE`` neighbouring intervals on each side and compares all their pairs that are not provably apart,
    so that an interval travels once for up to ``SQUARE`` pairs.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    intervals, turn = _intervals(vectors, dims, eps)
    place = intervals.select("block", F.floor((F.row_number().over(W.orderBy("block")) - 1) / SQUARE).alias("square"))  # a number an interval
    pairs = _pairs(intervals, eps).join(place.select(F.col("block").alias("a"), F.col("square").alias("sa")), "a").join(place.select(F.col("block").alias("b"), F.col("square").alias("sb")), "b")
    pairs = pairs.groupBy("sa", "sb", F.col("a").alias("block")).agg(F.collect_list("b").alias("others"))
    needed = pairs.withColumn("block", F.explode("others")).select("sa", "sb", "block").union(pairs.select("sa", "sb", "block")).distinct()
    met = needed.join(pairs, ["sa", "sb", "block"], "left").join(intervals.select("block", "ids", "weights", "x"), "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {}
        for r in pdf.itertuples():
            ids, raw = np.frombuffer(r.ids, np.int64), np.frombuffer(r.x, np.float32 if len(r.x) * 2 == len(r.ids) * dims else np.float64).reshape(-1, dims)
            blocks[r.block] = ids, np.frombuffer(r.weights, np.int64), raw, _unit(raw.astype(np.float64)) @ turn
        names = sorted(blocks)
        sizes = [len(blocks[n][0]) for n in names]
        start = dict(zip(names, np.cumsum([0, *sizes[:-1]]).tolist()))
        ids, weights = np.concatenate([blocks[n][0] for n in names]), np.concatenate([blocks[n][1] for n in names])
        more, root_links = np.zeros(len(ids), np.int64), []
        for r in pdf.itertuples():
            for other in [] if r.others is None else r.others:
                same = other == r.block
                _, wa, ra, xa = blocks[r.block]
                _, wb, rb, xb = blocks[other]
                found: list = []
                join_intervals(xa, None if same else xb, eps, threshold, found)
                i, j, cosine = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
                near = np.flatnonzero(cosine < threshold + _SLACK)
                x, y = ra[i[near]].astype(np.float64), rb[j[near]].astype(np.float64)
                ok = np.ones(len(i), bool)
                ok[near] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                # links by vector, and a star for each component of the pair: no list of pairs is held
                more[start[r.block] : start[r.block] + len(wa)] += np.bincount(i, wb[j], len(wa)).astype(np.int64)
                more[start[other] : start[other] + len(wb)] += np.bincount(j, wa[i], len(wb)).astype(np.int64)
                root = graph.local_roots(len(wa) + len(wb), i, j if same else j + len(wa))
                at = np.concatenate([start[r.block] + np.arange(len(wa)), start[other] + np.arange(len(wb))])
                star = np.flatnonzero(root != np.arange(len(root)))
                root_links.append((at[star], at[root[star]]))
        u, v = (np.concatenate([x[k] for x in root_links] or [np.zeros(0, np.int64)]) for k in range(2))
        root = graph.local_roots(len(ids), u, v)
        star, has = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(more)
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(has), len(star)]), "u": np.concatenate([ids[has], ids[star]]), "v": np.concatenate([more[has], ids[root[star]]])})

    return met.groupBy("sa", "sb").applyInPandas(run, "kind long, u long, v long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for every vector, linked at cosine >= threshold."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    good = rows.where(fine)
    # a distinct vector is known by a hash-free row number: its place in the written table
    distinct = good.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    distinct = scratch.written(distinct.withColumn("rep", F.monotonically_increasing_id()), "ego-distinct")
    sizes = [r[0] for r in distinct.select(F.size("v").alias("n")).distinct().orderBy("n").limit(MOST_DIMS + 1).collect()]
    if sizes and max(sizes) > MOST_DIMS:
        raise ValueError(f"vectors have more than {MOST_DIMS} components")
    found = None
    for n in sizes:
        one = _linked(distinct.where(F.size("v") == n), n, threshold)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = scratch.written(found, "ego-links")
    links = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("other")).withColumnRenamed("u", "rep")
    comp = graph.components(found.where("kind = 1"), "u", "v").withColumnRenamed("id", "rep")
    known = distinct.join(links, "rep", "left").join(comp, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    named = known.groupBy("comp").agg(F.min("first").alias("component"))
    known = known.join(named, "comp").select("v", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), "component")
    linked = good.join(known, "v").select("id", "n_links", F.coalesce("component", "id").alias("component"))
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
