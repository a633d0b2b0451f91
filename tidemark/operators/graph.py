"""Graphs over node and edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, kept


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that has an edge: the least id reachable, by hook and jump on labels.

    Each round joins edges with labels twice and halves the label chains; rounds grow with the logarithm of the diameter.
    """
    e = kept(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    label = kept(e.groupBy("x").agg(F.least("x", F.min("y")).alias("l")), "labels")
    while True:
        near = e.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        hook = label.join(near, "x").select("x", F.least("l", "m").alias("l"))
        jump = hook.select(F.col("x").alias("l"), F.col("l").alias("j"))
        new = kept(hook.join(jump, "l", "left").select("x", F.least("l", "j").alias("l")), "labels")
        done = new.join(label.withColumnRenamed("l", "o"), "x").where("l <> o").isEmpty()
        drop(label)
        if done:
            drop(e)
            return new.select(F.col("x").alias("id"), F.col("l").alias("component"))
        label = new


def ranked_paths(edges: DataFrame, a: str = "a", b: str = "b", step: str = "step") -> DataFrame:
    """(id, head, distance) of every node of paths whose nodes have one edge in and one out at most, by pointer jumping.

    ``distance`` sums ``step`` from the head.  Every round doubles the length that is looked back over, so rounds grow with
    the logarithm of the longest path.  A ring is opened before its least node.
    """
    e = kept(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(step).cast("long").alias("d")), "path-edges")
    heads = e.select(F.col("a").alias("id")).join(e.select(F.col("b").alias("id")), "id", "left_anti").distinct()
    ended = [kept(heads.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("done"), F.col("id").alias("low")), "path-heads")]
    active = e.select(F.col("b").alias("id"), F.col("a").alias("up"), "d", F.lit(False).alias("done"), F.least("a", "b").alias("low"))
    left, rings = e.count(), False
    while left:
        every = active
        for t in ended if not rings else []:
            every = every.unionByName(t)
        above = every.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        moved = active.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell"))
        moved = kept(moved, "paths")
        still, fell = moved.where("not done").agg(F.count("*"), F.count_if("fell")).first()
        # as long as a path goes on beyond the span its next nodes end in every round, so one without an end leaves rings only;
        # they turn by themselves until none of their least nodes falls any more
        if rings and not fell:
            break
        if not rings and still < left:
            ended.append(moved.where("done").drop("fell"))
        rings = still == left
        active, left = moved.where("not done").drop("fell"), still
    out = ended[0]
    for t in ended[1:]:
        out = out.unionByName(t)
    out = out.select("id", F.col("up").alias("head"), F.col("d").alias("distance"))
    if left:  # each node has seen all of its ring, so low is the ring's least node
        ring = active.select(F.col("id").alias("b"), "low")
        out = out.unionByName(ranked_paths(e.join(ring, "b").where("b <> low"), "a", "b", "d"))
        # a ring of one node has no edge left
        out = out.unionByName(e.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("head"), F.lit(0).cast("long").alias("distance")))
    return out


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id): nodes with children and no parent."""
    return edges.select(F.col(a).alias("id")).distinct().join(edges.select(F.col(b).alias("id")), "id", "left_anti")


def paths(edges: DataFrame, group: str, a: str = "a", b: str = "b", most: int = 10_000) -> DataFrame:
    """(group, path): every path from a root to a leaf of each group's directed graph, cycles folded into one node.

    Groups are small graphs (alignments of one read); ``most`` bounds the paths of one group and a larger one is an error.
    """
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for x, y in pdf[[a, b]].drop_duplicates().itertuples(index=False):
            out.setdefault(x, set()).add(y)
            out.setdefault(y, set())
        comp = _strong(out)
        folded: dict = {}
        for x, ys in out.items():
            folded.setdefault(comp[x], set()).update(comp[y] for y in ys if comp[y] != comp[x])
        inner = {y for ys in folded.values() for y in ys}
        found: list = []
        stack = [[r] for r in sorted(folded) if r not in inner]
        while stack:
            p = stack.pop()
            nxt = sorted(folded[p[-1]])
            if not nxt:
                found.append(p)
                if len(found) > most:
                    raise ValueError(f"group {pdf[group].iloc[0]!r} has more than {most} paths")
            stack += [[*p, y] for y in nxt]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(found), "path": sorted(found)})

    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, path array<{kinds[a]}>")


def _strong(out: dict) -> dict:
    """Least member of the strongly connected component of each node (two passes, no recursion)."""
    order, seen = [], set()
    for root in sorted(out):
        stack = [(root, iter(sorted(out[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            x, it = stack[-1]
            y = next((y for y in it if y not in seen), None)
            if y is None:
                order.append(x)
                stack.pop()
            else:
                seen.add(y)
                stack.append((y, iter(sorted(out[y]))))
    back: dict = {x: [] for x in out}
    for x, ys in out.items():
        for y in ys:
            back[y].append(x)
    comp: dict = {}
    for x in reversed(order):
        if x in comp:
            continue
        members, todo = [], [x]
        comp[x] = x
        while todo:
            y = todo.pop()
            members.append(y)
            for z in back[y]:
                if z not in comp:
                    comp[z] = x
                    todo.append(z)
        least = min(members)
        for y in members:
            comp[y] = least
    return comp


def best_chain(segments: DataFrame, group: str, max_gap: int, max_intron: int) -> DataFrame:
    """(group, score, ids): the chain of compatible alignments of a read with the highest summed score.

    ``segments``: (group, id, chrom, strand, qs, qe, ts, te, score).  One follows another on the same chromosome and strand
    if query and target both go on, the query gap is at most ``max_gap`` and the target gap at most ``max_intron``.
    """
    kinds = dict(segments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["qs", "qe", "ts", "id"]).to_dict("records")
        best: list = []
        for i, r in enumerate(rows):
            prior = (0.0, [])
            for j in range(i):
                p = rows[j]
                if p["chrom"] == r["chrom"] and p["strand"] == r["strand"] and 0 <= r["qs"] - p["qe"] <= max_gap and 0 <= r["ts"] - p["te"] <= max_intron and best[j][0] > prior[0]:
                    prior = best[j]
            best.append((prior[0] + r["score"], [*prior[1], r["id"]]))
        score, ids = max(best, key=lambda x: (x[0], [-k for k in x[1]] if all(isinstance(k, int) for k in x[1]) else 0))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "score": [score], "ids": [ids]})

    return segments.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, score double, ids array<{kinds['id']}>")
