"""Transcript reduction and prediction: chains of compatible junctions merged into families.

Transcripts (id, chrom, exons) with the same junctions fold into one chain first.  A
chain is part of another if its junctions match consecutive ones of it, each end within
the tolerance.  Chains that are part of each other are one; a chain that is part of no
longer one is the root of a family, and everything below it belongs to that family:
``exhaustive`` to every root above it, ``greedy`` to the first (most junctions, most
transcripts, least id).  A family's junction ends are the ones most of its transcripts
have (ties: the smaller), its bounds the widest of the members that reach its first or
last junction.  ``predicted`` goes on and joins families whose ends overlap.

Everything is joins: candidates meet on the first junction's position bin, reach is
extended in rounds of one join, and paths are contracted by pointer jumping, so a locus
of any size is spread over all tasks.  Chains that meet no other one are set apart as they
are; only the others are ranked and voted on.  Transcripts of one exon have no junctions
and are not part of this (see ``nonredundant.clustered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import drop, kept
from . import graph

#: Position bins in which junctions meet.
BIN = 1 << 10


def _junctions() -> Column:
    """The gaps between neighbouring exons, as (l, r)."""
    return F.transform(F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda x, k: F.struct(F.get("exons", k)["e"].alias("l"), x["s"].alias("r")))


def chains(tx: DataFrame) -> DataFrame:
    """(chain, chrom, junctions, m, n, s, e): distinct junction chains, named by their least transcript; m junctions, n transcripts."""
    rows = tx.where(F.size("exons") > 1).select("id", "chrom", _junctions().alias("junctions"), F.get("exons", F.lit(0))["s"].alias("s"), F.try_element_at("exons", F.lit(-1))["e"].alias("e"))
    folded = rows.groupBy("chrom", "junctions").agg(F.min("id").alias("chain"), F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))
    return folded.select("chain", "chrom", "junctions", F.size("junctions").alias("m"), "n", "s", "e")


def members(tx: DataFrame, c: DataFrame) -> DataFrame:
    """(chain, id): the transcripts of each of their chains ``c``."""
    rows = tx.where(F.size("exons") > 1).select("id", "chrom", _junctions().alias("junctions"))
    return rows.join(c.select("chain", "chrom", "junctions"), ["chrom", "junctions"]).select("chain", "id")


def _near(a: Column, b: Column, tolerance: int) -> Column:
    return (F.abs(a["l"] - b["l"]) <= tolerance) & (F.abs(a["r"] - b["r"]) <= tolerance)


def meetings(c: DataFrame, tolerance: int, width: int = BIN, where: str = "true") -> DataFrame:
    """(big, at, small, mb, ms): chains whose junction ``at`` (from 0) matches the first junction of another chain, and the ones after it while both last.

    ``where`` is a condition on at, mb and ms (junctions of both).  Two junctions are compared where chains meet; the few pairs
    that share more of them then look up their chains.
    """
    nxt = lambda k: F.get("junctions", k)
    two = F.posexplode(F.transform("junctions", lambda j, k: F.struct(j["l"].alias("l"), j["r"].alias("r"), nxt(k + 1)["l"].alias("l2"), nxt(k + 1)["r"].alias("r2")))).alias("at", "j")
    big = c.select(F.col("chain").alias("big"), "chrom", F.col("m").alias("mb"), two).select("big", "chrom", "mb", "at", "j.*")
    first, second = nxt(F.lit(0)), nxt(F.lit(1))
    bins = F.sequence(F.floor((first["l"] - tolerance) / width), F.floor((first["l"] + tolerance) / width))
    small = c.select(F.col("chain").alias("small"), F.col("chrom").alias("on"), F.col("m").alias("ms"), first.alias("x"), second.alias("y"), F.explode(bins).alias("bin"))
    small = small.select("small", "on", "ms", "bin", F.col("x.l").alias("xl"), F.col("x.r").alias("xr"), F.col("y.l").alias("yl"), F.col("y.r").alias("yr"))
    fits = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    shared = F.least(F.col("mb") - F.col("at"), "ms")
    met = big.join(small, (F.col("chrom") == F.col("on")) & (F.floor(F.col("l") / width) == F.col("bin")) & (F.col("big") != F.col("small")) & fits("l", "xl") & fits("r", "xr"))
    met = kept(met.where(where).where((shared == 1) | (fits("l2", "yl") & fits("r2", "yr"))).select("big", "at", "small", "mb", "ms"), "meetings")
    # written in between, so that few pairs are known to be few and the chains stay where they are
    more = kept(met.where(shared > 2), "longer-meetings")
    more = kept(more.join(c.select(F.col("chain").alias("big"), F.col("junctions").alias("jb")), "big"), "longer-meetings")
    more = more.join(c.select(F.col("chain").alias("small"), F.col("junctions").alias("js")), "small")
    same = F.forall(F.zip_with(F.slice("jb", F.col("at") + 3, shared - 2), F.slice("js", F.lit(3), shared - 2), lambda x, y: _near(x, y, tolerance)), lambda x: x)
    return met.where(shared <= 2).unionByName(more.where(same).select(*met.columns))


def _subsets(c: DataFrame, tolerance: int, width: int) -> DataFrame:
    return kept(meetings(c, tolerance, width, "mb - at >= ms"), "subsets")


def _apart(c: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains of ``c`` that are in no pair of ``inside``, and those that are."""
    ids = inside.select(F.col("big").alias("chain")).union(inside.select("small")).distinct()
    rows = kept(c.join(ids.withColumn("linked", F.lit(True)), "chain", "left"), "chains")
    return rows.where("linked IS NULL AND chain IS NOT NULL").select(*c.columns), rows.where("linked").select(*c.columns)


def families(c: DataFrame, tolerance: int = 10, how: str = "exhaustive", width: int = BIN) -> DataFrame:
    """(family, chain, at): every chain with the families it belongs to and the place of its first junction in the root's.

    ``family`` is the root: the least chain of those that are part of each other and of no longer one.
    """
    inside = _subsets(c, tolerance, width)
    apart, linked = _apart(c.select("chain", "m", "n"), inside)
    return _placed(linked, inside, how).unionByName(apart.select(F.col("chain").alias("family"), "chain", F.lit(0).alias("at")))


def _placed(linked: DataFrame, inside: DataFrame, how: str) -> DataFrame:
    """``families`` of the chains ``linked`` by ``inside``, which is dropped."""
    if how not in ("exhaustive", "greedy"):
        raise ValueError(f"how is exhaustive or greedy, not {how!r}")
    equal = graph.connected_components(inside.where("mb = ms"), "big", "small")
    named = kept(linked.select("chain", "m", "n").join(equal.withColumnRenamed("id", "chain"), "chain", "left").withColumn("node", F.coalesce("component", "chain")), "nodes")
    name = named.select("chain", "node")
    up = inside.where("mb > ms").join(name.withColumnsRenamed({"chain": "big", "node": "above"}), "big").join(name.withColumnsRenamed({"chain": "small", "node": "below"}), "small")
    up = kept(up.groupBy("above", "below").agg(F.min("at").alias("at")), "above")
    roots = named.select("node").distinct().join(up.select(F.col("below").alias("node")), "node", "left_anti")
    reach = kept(roots.select(F.col("node").alias("family"), "node", F.lit(0).alias("at")), "reach")
    front = reach
    while True:
        step = front.join(up.withColumnRenamed("at", "more"), F.col("node") == F.col("above")).groupBy("family", F.col("below").alias("node")).agg(F.min(F.col("at") + F.col("more")).alias("at"))
        step = kept(step.join(reach.select("family", "node"), ["family", "node"], "left_anti"), "front")
        if step.isEmpty():
            break
        reach = kept(reach.unionByName(step), "reach")
        front = step
    if how == "greedy":
        size = named.groupBy("node").agg(F.max("m").alias("m"), F.sum("n").alias("n"))
        best = F.min_by(F.struct("family", "at"), F.struct(-F.col("m"), -F.col("n"), "family"))
        reach = reach.join(size.withColumnRenamed("node", "family"), "family").groupBy("node").agg(best.alias("x")).select("x.family", "node", "x.at")
    out = kept(reach.join(name, "node").select("family", "chain", "at"), "families")
    for t in (inside, named, up):
        drop(t)
    return out


def consensus(c: DataFrame, placed: DataFrame, support: int = 1) -> DataFrame:
    """(chain, chrom, junctions, m, n, s, e) of families (family, chain, at): the shape of ``chains``, so that it can be merged again.

    ``n`` counts transcripts.  Where the most frequent ends would leave an exon without bases the longest member's junctions stay.
    """
    return _agreed(kept(placed.join(c, "chain"), "members"), support)


def _agreed(rows: DataFrame, support: int = 1) -> DataFrame:
    """``consensus`` of chains with their ``family`` and ``at``."""
    last = F.max(F.struct((F.col("at") + F.col("m")).alias("m"), "e"))
    total = rows.groupBy("family", "chrom").agg(last.alias("last"), F.sum("n").alias("n"), F.min_by("junctions", F.struct(F.col("at"), -F.col("m"), "chain")).alias("own"), F.min(F.when(F.col("at") == 0, F.col("s"))).alias("s"))
    found = total.where(F.col("n") >= support).select("family", "chrom", "n", "own", "s", "last.m", "last.e")
    each = rows.select("family", "n", "at", F.posexplode("junctions").alias("k", "j")).select("family", "n", (F.col("at") + F.col("k")).alias("pos"), F.posexplode(F.array("j.l", "j.r")).alias("side", "v"))
    votes = each.groupBy("family", "pos", "side", "v").agg(F.sum("n").alias("votes"))
    ends = votes.groupBy("family", "pos").agg(*[F.expr(f"min_by(v, struct(-votes, v)) FILTER (WHERE side = {i})").alias(x) for i, x in enumerate("lr")])
    agreed = ends.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "r"))).alias("x"))
    found = found.join(agreed, "family")
    kinds = rows.schema["junctions"].dataType.elementType  # the ends share a column above
    agreed_j = F.transform("x", lambda x: F.struct(*[x[i].cast(kinds[i].dataType).alias(i) for i in ("l", "r")]))
    inner = F.forall(F.zip_with(F.slice(agreed_j, F.lit(1), F.size("x") - 1), F.slice(agreed_j, F.lit(2), F.size("x") - 1), lambda p, q: p["r"] < q["l"]), lambda x: x)
    sound = inner & (F.col("s") < F.get("x", F.lit(0))["l"]) & (F.try_element_at("x", F.lit(-1))["r"] < F.col("e")) & F.forall("x", lambda x: x["l"] <= x["r"])
    return found.select(F.col("family").alias("chain"), "chrom", F.when(sound | (F.size("own") < F.col("m")), agreed_j).otherwise(F.col("own")).alias("junctions"), "m", "n", "s", "e")


def exons(c: DataFrame) -> DataFrame:
    """``c`` with its junctions as ``exons``."""
    starts = F.concat(F.array("s"), F.transform("junctions", lambda j: j["r"]))
    ends = F.concat(F.transform("junctions", lambda j: j["l"]), F.array("e"))
    return c.withColumn("exons", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))).drop("junctions")


def reduced(tx: DataFrame, tolerance: int = 10, how: str = "exhaustive", support: int = 1, width: int = BIN) -> DataFrame:
    """(chain, chrom, m, n, s, e, exons): one row a family of transcripts (id, chrom, exons)."""
    apart, voted = _merged(kept(chains(tx), "chains"), tolerance, how, width, support)
    return exons(apart.where(F.col("n") >= support).unionByName(voted))


def _merged(c: DataFrame, tolerance: int, how: str, width: int, support: int = 1) -> tuple[DataFrame, DataFrame]:
    """The chains of ``c`` that are families by themselves, as they are, and the consensus of the other families."""
    inside = _subsets(c, tolerance, width)
    apart, linked = _apart(c, inside)
    return apart, consensus(linked, _placed(linked, inside, how), support)


def _joins(c: DataFrame, tolerance: int, least: int, width: int) -> DataFrame:
    """(a, b, step): pairs where b goes on from a, each other's best: most shared junctions, then the least chain."""
    ahead = meetings(c, tolerance, width, f"at > 0 AND ms > mb - at AND mb - at >= {least} AND ms > {least}").select(F.col("big").alias("a"), F.col("small").alias("b"), F.col("at").alias("step"), (F.col("mb") - F.col("at")).alias("shared"))
    right = W.partitionBy("a").orderBy(F.desc("shared"), "b", "step")
    left = W.partitionBy("b").orderBy(F.desc("shared"), "a", "step")
    ranked = ahead.select("a", "b", "step", F.row_number().over(right).alias("i"), F.row_number().over(left).alias("j"))
    return ranked.where("i = 1 AND j = 1").select("a", "b", "step")


def predicted(tx: DataFrame, tolerance: int = 10, least: int = 1, rounds: int = 0, support: int = 1, width: int = BIN) -> DataFrame:
    """(chain, chrom, m, n, s, e, exons): families joined where the end of one is the beginning of another, ``least`` junctions at least.

    Each round joins pairs that are each other's longest continuation, whole paths at once; ``rounds`` 0 goes on until none is left.
    """
    apart, voted = _merged(kept(chains(tx), "chains"), tolerance, "greedy", width)
    c = apart.unionByName(kept(voted, "voted"))
    turn = 0
    while not rounds or turn < rounds:
        pairs = kept(_joins(c, tolerance, least, width), "joins")
        if pairs.isEmpty():
            break
        paths = graph.ranked_paths(pairs, "a", "b", "step").select(F.col("id").alias("chain"), F.col("head").alias("family"), F.col("distance").cast("int").alias("at"))
        rows = kept(c.join(paths, "chain", "left"), "chains")
        c = rows.where("family IS NULL").select(*c.columns).unionByName(kept(_agreed(rows.where("family IS NOT NULL")), "voted"))
        turn += 1
    return exons(c.where(F.col("n") >= support))
