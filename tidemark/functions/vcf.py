"""Filters on variant rows (columns of the VCF source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import seq


def info_int(key: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(info, '(?:^|;){key}=([0-9]+)', 1), '') AS int)")


def dp4() -> Column:
    """Reference forward and reverse, alternative forward and reverse read counts."""
    return F.transform(F.split(F.regexp_extract("info", r"(?:^|;)DP4=([0-9,]+)", 1), ","), lambda x: x.try_cast("int"))


def filtered(variants: DataFrame, quality: float | None = None, total_depth: int | None = None, allele_depth: int | None = None, strand_depth: int | None = None, biallelic: bool = False) -> DataFrame:
    """Rows that pass every given bound; counts that are missing do not pass."""
    d, out = dp4(), variants
    if quality is not None:
        out = out.where(F.col("qual") >= quality)
    if total_depth is not None:
        out = out.where(info_int("DP") >= total_depth)
    if allele_depth is not None:
        out = out.where(F.least(*[F.get(d, F.lit(i)) + F.get(d, F.lit(i + 1)) for i in (0, 2)]) >= allele_depth)
    if strand_depth is not None:
        out = out.where((F.size(d) == 4) & (F.array_min(d) >= strand_depth))
    if biallelic:
        out = out.where(seq.is_simple_snp("ref", "alt") & F.exists("samples", lambda s: s.rlike(r"^(0[|/]1|1[|/]0)(:|$)")))
    return out
