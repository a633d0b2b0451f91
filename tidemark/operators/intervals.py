"""Interval algebra on tables of half-open intervals: columns ``chrom``, ``s``, ``e`` and any others.

Sweeps turn intervals into +1/-1 events, fold events by position, and run sums in
two levels (`running`), so a hot chromosome spreads over its bins.  Range joins
meet on (chrom, bin) and emit a pair only in the bin of its first shared base, so
nothing needs to be made distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import following, running, sweep

#: Width of position bins; about a thousand intervals a bin is a good choice.
BIN = 1 << 14


def _bin(pos: str | Column, width: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / width)


def events(iv: DataFrame, keys: list[str], weight: str | Column = 1) -> DataFrame:
    """(keys, pos, delta): net depth change at each position where it is not zero."""
    w = F.col(weight) if isinstance(weight, str) else F.lit(weight) if isinstance(weight, int) else weight
    ends = F.array(F.struct(F.col("s").alias("pos"), w.alias("d")), F.struct(F.col("e").alias("pos"), (-w).alias("d")))
    flat = iv.where("s < e").select(*keys, F.explode(ends).alias("x")).select(*keys, "x.pos", "x.d")
    return flat.groupBy(*keys, "pos").agg(F.sum("d").alias("delta")).where("delta <> 0")


def coverage(iv: DataFrame, keys: list[str] = ["chrom"], weight: str | Column = 1, min_depth: int = 1, width: int = BIN) -> DataFrame:
    """(keys, s, e, depth): maximal segments of equal depth of at least ``min_depth``.

    ``width`` 0 is for keys that have few rows each (`running.dealt`): one window a key, no bins.
    """
    ev = events(iv, keys, weight)
    if not width:
        own = W.partitionBy(*keys).orderBy("pos")
        ev = ev.withColumns({"depth": F.sum("delta").over(own.rowsBetween(W.unboundedPreceding, 0)), "e": F.lead("pos").over(own)})
        return ev.where((F.col("depth") >= min_depth) & F.col("e").isNotNull()).select(*keys, F.col("pos").alias("s"), "e", "depth")
    ev = ev.withColumn("_bin", _bin("pos", width))
    return sweep(ev, keys, "_bin", "pos", {"delta": "depth"}, "e").where((F.col("depth") >= min_depth) & F.col("e").isNotNull()).select(*keys, F.col("pos").alias("s"), "e", "depth")


def islands(iv: DataFrame, keys: list[str] = ["chrom"], gap: int = 0, touch: bool = True, width: int = BIN, tie: list[str] = []) -> DataFrame:
    """Every row with ``island``, a number by position within the keys.

    Rows chain while the next start is at most ``gap`` beyond the furthest end so far
    (less than that if not ``touch``: half-open intervals that only touch stay apart).
    ``width`` 0 is for keys that have few rows each (exons of a transcript): one window a key, no bins.
    """
    order = ["s", "e", *tie]
    if width:
        rows = running(iv.withColumn("_bin", _bin("s", width)), keys, "_bin", order, "e", "max", "_far", inclusive=False)
    else:
        plain = W.partitionBy(*keys).orderBy(*order)
        rows = iv.withColumn("_far", F.max("e").over(plain.rowsBetween(W.unboundedPreceding, -1)))
    reach = F.col("_far") + gap
    new = F.col("_far").isNull() | ((F.col("s") > reach) if touch else (F.col("s") >= reach))
    rows = rows.withColumn("_new", new.cast("long"))
    if not width:
        return rows.withColumn("island", F.sum("_new").over(plain.rowsBetween(W.unboundedPreceding, 0))).drop("_far", "_new")
    # of rows that are equal under the order the one that opens the island comes first, however the first pass had them
    return running(rows, keys, "_bin", [*order, F.desc("_new")], "_new", "sum", "island").drop("_bin", "_far", "_new")


def merge(iv: DataFrame, keys: list[str] = ["chrom"], gap: int = 0, touch: bool = True, width: int = BIN) -> DataFrame:
    """(keys, s, e, n): the islands with their hull and number of members."""
    got = islands(iv.select(*keys, "s", "e"), keys, gap, touch, width)
    return got.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def _two_sets(a: DataFrame, b: DataFrame, keys: list[str], wanted: Column, width: int) -> DataFrame:
    """(keys, s, e): maximal runs of positions where ``wanted``, a condition on the depths da and db of both sets, holds.

    A position's depths before its own events are the running sums less those events, so each row tells by itself
    whether the condition turns; runs are what lies between one turn and the next.
    """
    zero = F.lit(0).cast("long")
    both = a.select(*keys, "s", "e", F.lit(1).cast("long").alias("in_a"), zero.alias("in_b")).unionByName(b.select(*keys, "s", "e", zero.alias("in_a"), F.lit(1).cast("long").alias("in_b")))
    ends = F.array(F.struct(F.col("s").alias("pos"), F.col("in_a").alias("a"), F.col("in_b").alias("b")), F.struct(F.col("e").alias("pos"), (-F.col("in_a")).alias("a"), (-F.col("in_b")).alias("b")))
    flat = both.where("s < e").select(*keys, F.explode(ends).alias("x")).select(*keys, "x.pos", "x.a", "x.b")
    ev = flat.groupBy(*keys, "pos").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b")).where("_a <> 0 OR _b <> 0").withColumn("_bin", _bin("pos", width))
    deep = sweep(ev, keys, "_bin", "pos", {"_a": "_da", "_b": "_db"}, "_e")
    deep = deep.withColumns({"da": F.col("_da"), "db": F.col("_db")}).withColumn("_on", wanted)
    deep = deep.withColumns({"da": F.col("_da") - F.col("_a"), "db": F.col("_db") - F.col("_b")}).withColumn("_was", wanted)
    turns = deep.where("_on <> _was").select(*keys, "pos", "_bin", "_on")
    return following(turns, keys, "_bin", "pos", "e").where("_on").select(*keys, F.col("pos").alias("s"), "e")


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = ["chrom"], width: int = BIN) -> DataFrame:
    """(keys, s, e): maximal runs of positions in a and not in b."""
    return _two_sets(a, b, keys, F.expr("da > 0 AND db = 0"), width)


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = ["chrom"], width: int = BIN) -> DataFrame:
    """(keys, s, e): maximal runs of positions in both a and b."""
    return _two_sets(a, b, keys, F.expr("da > 0 AND db > 0"), width)


def union(a: DataFrame, b: DataFrame, keys: list[str] = ["chrom"], width: int = BIN) -> DataFrame:
    """(keys, s, e): maximal runs of positions in a or b."""
    return merge(a.select(*keys, "s", "e").unionByName(b.select(*keys, "s", "e")), keys, width=width).drop("n")


def pad(iv: DataFrame, n: int, lengths: DataFrame | None = None) -> DataFrame:
    """Rows widened by ``n`` on both sides, clamped to 0 and, with ``lengths`` (chrom, length), to the chromosome's end."""
    out = iv.withColumn("s", F.greatest(F.col("s") - n, F.lit(0))).withColumn("e", F.col("e") + n)
    if lengths is not None:
        out = out.join(lengths.select("chrom", F.col("length").alias("_length")), "chrom", "left").withColumn("e", F.least("e", F.coalesce("_length", "e"))).drop("_length")
    return out


def complement(iv: DataFrame, lengths: DataFrame, width: int = BIN) -> DataFrame:
    """(chrom, s, e): what the intervals leave of whole chromosomes (chrom, length)."""
    whole = lengths.select("chrom", F.lit(0).cast("long").alias("s"), F.col("length").cast("long").alias("e"))
    return subtract(whole, iv, width=width)


def tile(iv: DataFrame, size: int, whole: bool = True) -> DataFrame:
    """Each row cut into windows of ``size`` from its start; a shorter last window only if not ``whole``."""
    last = F.floor((F.col("e") - F.col("s") - (size if whole else 1)) / size)
    steps = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    out = iv.withColumn("_k", F.explode(steps)).withColumn("_s", F.col("s") + F.col("_k") * size)
    return out.withColumn("e", F.least("e", F.col("_s") + size)).withColumn("s", F.col("_s")).drop("_k", "_s")


def _prefixed(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else f"{p}_{c}") for c in df.columns])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str] = ["chrom"], how: str = "inner", slack: int = 0, width: int = BIN, where: Column | None = None) -> DataFrame:
    """Pairs of rows that share a base (or lie within ``slack`` bases): keys, a_*, b_* and ``bp`` shared.

    ``how``: inner, left_semi, left_anti (columns of a), or left (b_* null where nothing meets).
    ``where`` is a further condition on a_*, b_* and bp; without one, which rows meet nothing is told without pairs.
    """
    left, right = _prefixed(a, "a", keys), _prefixed(b, "b", keys)
    wide_a = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col("a_s") - slack, width), _bin(F.col("a_e") - 1 + slack, width))))
    wide_b = right.withColumn("_bin", F.explode(F.sequence(_bin("b_s", width), _bin(F.col("b_e") - 1, width))))
    first = _bin(F.greatest(F.col("a_s") - slack, F.col("b_s")), width)
    bp = F.greatest(F.least("a_e", "b_e") - F.greatest("a_s", "b_s"), F.lit(0))
    met = wide_a.join(wide_b, [*keys, "_bin"]).where((F.col("a_s") - slack < F.col("b_e")) & (F.col("b_s") < F.col("a_e") + slack) & (F.col("_bin") == first)).withColumn("bp", bp)
    if where is not None:
        met = met.where(where)
    met = met.drop("_bin")
    if how == "inner":
        return met
    if where is None:
        some = F.coalesce(F.col("_reach") > F.col("s") - slack, F.lit(False))
        marked = _reached(a, b, keys, slack, width)
        if how in ("left_semi", "left_anti"):
            return marked.where(some if how == "left_semi" else ~some).drop("_reach")
        return met.unionByName(_prefixed(marked.where(~some).drop("_reach"), "a", keys), allowMissingColumns=True)
    # rows are known by all their columns: equal rows meet the same rows, and no number has to be the same in two evaluations
    own = met.select(*left.columns).distinct()
    same = F.lit(True)
    for c in left.columns:
        same = same & left[c].eqNullSafe(own[c])
    if how in ("left_semi", "left_anti"):
        return left.join(own, same, how).select(*[F.col(c).alias(c if c in keys else c[2:]) for c in left.columns])
    alone = left.join(own, same, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def _reached(a: DataFrame, b: DataFrame, keys: list[str], slack: int, width: int) -> DataFrame:
    """``a`` with ``_reach``: the furthest end of the rows of b that start before the row's end and slack.

    A row shares a base with some row of b just where that end lies beyond its start, so whether it does takes one running
    maximum over starts and ends, and no pairs.
    """
    until = F.col("e") + slack
    starts = b.where("s <= e").groupBy(*keys, F.col("s").alias("_pos")).agg(F.max("e").alias("_x")).withColumn("_kind", F.lit(1))
    ends = a.select(*keys, until.alias("_pos")).distinct().withColumn("_kind", F.lit(0))
    rows = starts.unionByName(ends, allowMissingColumns=True).withColumn("_bin", _bin("_pos", width))
    told = running(rows, keys, "_bin", ["_pos", "_kind"], "_x", "max", "_reach").where("_kind = 0 AND _reach IS NOT NULL")
    return a.withColumn("_pos", until).join(told.select(*keys, "_pos", "_reach"), [*keys, "_pos"], "left").select(*a.columns, "_reach")


def nearest(a: DataFrame, b: DataFrame, keys: list[str] = ["chrom"], tie: str = "id", width: int = BIN) -> DataFrame:
    """Each row of a with the nearest row of b by gap (0 if they overlap): a_*, b_*, distance; ties by b's start, then ``tie``.

    Overlaps come from the range join; else the candidates are the last b that ends before and the
    first b that starts after, found by two-level running maxima over both.  Of rows of b with one
    end, or one start, the first under the tie order stands for all.
    """
    b_cols = [c for c in b.columns if c not in keys]
    one = F.struct(*[F.col(c).alias(f"b_{c}") for c in b_cols])
    spots = a.select(*keys, F.col("s").alias("a_s"), F.col("e").alias("a_e")).distinct()
    kind = b.select(one.alias("x")).schema["x"].dataType

    def last(own: Column, other: DataFrame) -> DataFrame:
        """Spots with the row of ``other`` (keys, p, x) that has the greatest p not beyond ``own``."""
        marks = spots.select(*keys, own.alias("p"), F.lit(1).alias("kind"), "a_s", "a_e", F.lit(None).cast(f"struct<p:bigint,x:{kind.simpleString()}>").alias("c"))
        seen = other.select(*keys, F.col("p").cast("long").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a_s"), F.lit(None).cast("long").alias("a_e"), F.struct(F.col("p").cast("long").alias("p"), "x").alias("c"))
        rows = marks.unionByName(seen).withColumn("_bin", _bin("p", width))
        return running(rows, keys, "_bin", ["p", "kind"], "c", "max", "best").where("kind = 1 AND best IS NOT NULL").select(*keys, "a_s", "a_e", F.col("best.x").alias("x"))

    first = F.min(F.struct(F.col("s").alias("k1"), F.col(tie).alias("k2"), one.alias("x")))
    before = last(F.col("a_s"), b.groupBy(*keys, F.col("e").alias("p")).agg(first.alias("m")).select(*keys, "p", "m.x"))
    after = last(-F.col("a_e"), b.groupBy(*keys, (-F.col("s")).alias("p")).agg(first.alias("m")).select(*keys, "p", "m.x"))
    met = overlap_join(spots.select(*keys, F.col("a_s").alias("s"), F.col("a_e").alias("e")), b, keys, width=width).select(*keys, "a_s", "a_e", one_of("b", b_cols).alias("x"))
    found = before.unionByName(after).unionByName(met)
    distance = F.greatest(F.col("x.b_s") - F.col("a_e") + 1, F.col("a_s") - F.col("x.b_e") + 1, F.lit(0))
    distance = F.when((F.col("a_s") < F.col("x.b_e")) & (F.col("x.b_s") < F.col("a_e")), F.lit(0)).otherwise(distance)
    best = found.groupBy(*keys, "a_s", "a_e").agg(F.min(F.struct(distance.alias("distance"), F.col("x.b_s").alias("k1"), F.col(f"x.b_{tie}").alias("k2"), "x")).alias("m"))
    left = _prefixed(a, "a", keys)
    return left.join(best, [*keys, "a_s", "a_e"], "left").select(*left.columns, *[F.col(f"m.x.b_{c}").alias(f"b_{c}") for c in b_cols], F.col("m.distance").alias("distance"))


def one_of(side: str, columns: list[str]) -> Column:
    """The columns of one side of a join as a struct."""
    return F.struct(*[F.col(f"{side}_{c}") for c in columns])


def cogroup_loci(sets: dict[str, DataFrame], gap: int = 0, touch: bool = False, width: int = BIN) -> DataFrame:
    """Loci over several interval sets at once: (chrom, s, e, n_<set>...) for each chain of overlapping members."""
    every = None
    for name, df in sets.items():
        one = df.select("chrom", "s", "e", F.lit(name).alias("_set"))
        every = one if every is None else every.unionByName(one)
    got = islands(every, ["chrom"], gap, touch, width, ["_set"])
    counts = [F.count_if(F.col("_set") == n).alias(f"n_{n}") for n in sets]
    return got.groupBy("chrom", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), *counts).drop("island")


def multi_subtract_one(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """[s, e) less [s2, e2) as an array of 0 to 2 structs (s, e)."""
    left = F.when(s < s2, F.struct(s.alias("s"), F.least(e, s2).alias("e")))
    right = F.when(e2 < e, F.struct(F.greatest(s, e2).alias("s"), e.alias("e")))
    whole = F.struct(s.alias("s"), e.alias("e"))
    return F.when((s2 >= e) | (e2 <= s), F.array(whole)).otherwise(F.array_compact(F.array(left, right)))
