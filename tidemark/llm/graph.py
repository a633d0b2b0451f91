"""Connected components of a link table, in Spark, by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links a-b (one task's share) and those of an earlier ``root``."""
    root = np.arange(n) if root is None else root.copy()
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link the larger (large) or the smaller-or-equal neighbours of a node to its least neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the least id reachable from every id that has a link to another.

    Ids without links do not appear.  Each round is written to a shared table, so
    the plan does not grow; the rounds needed grow with the logarithm of the
    longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.written(e, "links")
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        new = scratch.written(_stars(_stars(e, True), False), "links")
        scratch.remove(e)
        e = new
        now = e.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
