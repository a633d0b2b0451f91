"""Quality strings as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets of the quality encodings (fixed values): Sanger S, PacBio P, Illumina I (1.3), J (1.5), L (1.8); X is Solexa.
OFFSETS = {"S": 33, "P": 33, "L": 33, "I": 64, "J": 64, "X": 64}

#: Ranges of character codes of the known encodings (fixed values); every one that holds all codes is named.
CODE_RANGES = {"Sanger": (33, 93), "Solexa": (59, 104), "Illumina-1.3": (64, 104), "Illumina-1.5": (67, 104)}


def codes(qual: str | Column) -> Column:
    """Character codes of a quality string, in order."""
    q = F.col(qual) if isinstance(qual, str) else qual
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c))


def error_probability(code: Column, kind: str = "S") -> Column:
    """Of one character code; Solexa codes are odds."""
    q = (code - OFFSETS[kind]) / 10.0
    p = F.pow(F.lit(10.0), -q)
    return p / (1 + p) if kind == "X" else p


def mean_error(qual: str | Column, kind: str = "S") -> Column:
    c = codes(qual)
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + error_probability(x, kind)) / F.size(c)


def count_between(qual: str | Column, low: int, high: int) -> Column:
    """Characters whose code lies in [low, high]."""
    q = F.col(qual) if isinstance(qual, str) else qual
    return F.regexp_count(q, F.lit(r"[\x{%x}-\x{%x}]" % (low, high)))


def low_count(qual: str | Column, most: int) -> Column:
    """Characters whose code is at most ``most``."""
    return count_between(qual, 0, most)


def to_phred33(rate: Column) -> Column:
    return F.char(F.floor(-10 * F.log10(rate)).cast("int") + 33)


def from_phred33(char: Column) -> Column:
    return F.pow(F.lit(10.0), -(F.ascii(char) - 33) / 10.0)


def encodings(low: Column, high: Column) -> Column:
    """Names of the encodings whose code range holds [low, high]."""
    names = [F.when((low >= a) & (high <= b), F.lit(n)) for n, (a, b) in sorted(CODE_RANGES.items())]
    return F.array_compact(F.array(*names))


def called(reads: DataFrame, qual: str, keys: list[str] = []) -> DataFrame:
    """(keys, kind): the encoding told from how many characters fall into marked code ranges; null where none fits.

    P (PacBio), S (Sanger), J (Illumina 1.5+), I (Illumina 1.3+); more than two characters of a range count as a sign.
    Codes that only Solexa has are recognised, but such reads are not called.
    """
    # fixed values: the code ranges that tell the encodings apart
    ranges = {"pacbio": (105, 113), "first": (64, 65), "high": (76, 104), "solexa": (59, 63), "start": (64, 66), "next": (67, 72), "low": (33, 58)}
    by = reads.where(F.length(qual) > 0).groupBy(*keys).agg(*(F.sum(count_between(qual, *r)).alias(f"_{name}") for name, r in ranges.items()))
    kind = F.expr("CASE WHEN _pacbio > 2 AND _low > 2 THEN 'P' WHEN _low > 2 THEN 'S' WHEN _solexa > 2 AND _high > 2 THEN NULL WHEN _next > 2 AND _high > 2 AND _first = 0 THEN 'J' WHEN _start > 2 AND _high > 2 THEN 'I' END")
    return by.select(*keys, kind.alias("kind"))
