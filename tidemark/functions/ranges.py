"""Scalar range functions on two half-open ranges given as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column, padding: int = 0) -> Column:
    """Both on one chromosome and sharing a base once the second is padded (its start clamped at 0)."""
    return (c1 == c2) & (s1 < e2 + padding) & (F.greatest(s2 - padding, F.lit(0)) < e1)


def overlap_size(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    return F.when(c1 == c2, F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))).otherwise(F.lit(0))


def adjacent(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    return (c1 == c2) & ((e1 == s2) | (e2 == s1))


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.struct(F.least(s1, s2).alias("s"), F.greatest(e1, e2).alias("e"))


def shared(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The part both have, null if none."""
    return F.when(F.greatest(s1, s2) < F.least(e1, e2), F.struct(F.greatest(s1, s2).alias("s"), F.least(e1, e2).alias("e")))


def compare(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column, padding: int = 0) -> Column:
    """0 if they overlap (with padding), -1 if the first comes before, else 1."""
    before = (c1 < c2) | ((c1 == c2) & (s1 < s2))
    return F.when(overlaps(c1, s1, e1, c2, s2, e2, padding), F.lit(0)).when(before, F.lit(-1)).otherwise(F.lit(1))


def distance(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    """-1 on other chromosomes, 0 if they overlap, else the steps from one's last base to the other's first."""
    gap = F.when(e1 <= s2, s2 - e1 + 1).otherwise(s1 - e2 + 1)
    return F.when(c1 != c2, F.lit(-1)).when((s1 < e2) & (s2 < e1), F.lit(0)).otherwise(gap)


def locus_url(base: str, db: Column, chrom: Column, s: Column, e: Column) -> Column:
    """Browser address of a half-open range, shown 1-based."""
    return F.concat(F.lit(base), F.lit("?db="), db, F.lit("&position="), chrom, F.lit(":"), (s + 1).cast("string"), F.lit("-"), e.cast("string"))
