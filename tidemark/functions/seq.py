"""Sequence functions as Spark columns (JVM side); Python only for the zlib name codec."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_c(seq), "ACTGUNXactgunx", "TGACANXtgacanx"))


def reverse_complement_rna(seq: str | Column) -> Column:
    """As RNA where a U occurs (A becomes U); null where U and T mix; unknown characters stay."""
    s = _c(seq)
    rna, dna = F.lower(s).contains("u"), F.lower(s).contains("t")
    return F.when(rna & dna, F.lit(None)).when(rna, F.reverse(F.translate(s, "ACGUacgu", "UGCAugca"))).otherwise(F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca")))


def count_of(seq: str | Column, letters: str) -> Column:
    """Characters of ``seq`` that are among ``letters``."""
    s = _c(seq)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def n_count(seq: str | Column) -> Column:
    return count_of(seq, "Nn")


def gc_content(seq: str | Column) -> Column:
    """Share of G and C among the letters that are not N; null if there are none."""
    known = F.length(_c(seq)) - n_count(seq)
    return F.when(known > 0, count_of(seq, "GCgc") / known)


def homopolymer_compress(seq: str | Column) -> Column:
    return F.regexp_replace(_c(seq), r"(.)\1+", "$1")


def homopolymer_runs(seq: str | Column) -> Column:
    """array<struct(position, length)> of the runs longer than one, positions in the compressed sequence."""
    runs = F.regexp_extract_all(_c(seq), F.lit(r"((.)\2*)"), F.lit(1))
    numbered = F.transform(runs, lambda r, i: F.struct(i.alias("position"), F.length(r).alias("length")))
    return F.filter(numbered, lambda r: r["length"] > 1)


def compressed_usable(seq: str | Column, min_known: int = 40, max_n: int = 1) -> Column:
    """Whether the compressed sequence keeps enough known letters and few N."""
    c = homopolymer_compress(seq)
    return (F.length(c) - n_count(c) >= min_known) & (n_count(c) <= max_n)


def burrows_wheeler(seq: str | Column, end: str = "|") -> Column:
    """Last characters of the sorted rotations of the sequence with an end mark."""
    s = F.concat(_c(seq), F.lit(end))
    turns = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, i), F.substr(s, F.lit(1), i - 1)))
    return F.concat_ws("", F.transform(F.array_sort(turns), lambda t: F.right(t, F.lit(1))))


def tiles(seq: str | Column, size: int) -> Column:
    """array<struct(i, piece)> of pieces of at most ``size`` letters; the last may be shorter.  One pass over the sequence."""
    pieces = F.regexp_extract_all(_c(seq), F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("piece")))


def kmers(seq: str | Column, k: int) -> Column:
    """All k-mers in order.  One pass over the sequence."""
    return F.regexp_extract_all(_c(seq), F.lit("(?s)(?=(.{%d}))" % k), F.lit(1))


def overlapping(seq: str | Column, size: int, more: int) -> Column:
    """Pieces of ``size`` letters, each with the next ``more`` letters of the sequence behind it: they hold every (more + 1)-mer once."""
    pieces = F.regexp_extract_all(_c(seq), F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(pieces, i + 1), 1, more), F.lit(""))))


def chunked(reference: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(name, chunk, seq): a reference (name, seq) in rows of ``size`` letters, so that a slice reads few of them."""
    pieces = F.transform(F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % size), F.lit(0)), lambda p, i: F.struct(i.cast("long").alias("chunk"), p.alias("seq")))
    return reference.select("name", F.explode(pieces).alias("x")).select("name", "x.*")


def slices(chunks: DataFrame, regions: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``regions`` (id, name, s, e) with the letters [s, e) of the chunked reference; only the chunks that a region touches meet it."""
    touched = F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.greatest("e", F.col("s") + 1) - 1) / size))).alias("chunk")
    met = regions.select("id", "name", "s", "e", touched).join(chunks, ["name", "chunk"])
    at = F.col("chunk") * size
    part = F.substr("seq", (F.greatest(F.col("s") - at, F.lit(0)) + 1).cast("int"), (F.least(F.col("e") - at, F.lit(size)) - F.greatest(F.col("s") - at, F.lit(0))).cast("int"))
    got = met.groupBy("id", "name", "s", "e").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"])).alias("seq"))
    return regions.join(got, ["id", "name", "s", "e"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def slice_of(seq: str | Column, start: str | Column, end: str | Column, strand: Column | None = None) -> Column:
    """Letters [start, end) of the sequence, reverse complemented on strand ``-``."""
    piece = F.substr(_c(seq), _c(start).cast("int") + 1, (_c(end) - _c(start)).cast("int"))
    return piece if strand is None else F.when(strand == "-", reverse_complement(piece)).otherwise(piece)


def trim(seq: str | Column, n: int, side: str) -> Column:
    """Without ``n`` letters on the left or right; null if too short."""
    s = _c(seq)
    kept = F.substr(s, F.lit(n + 1)) if side == "left" else F.substr(s, F.lit(1), F.length(s) - n)
    return F.when(F.length(s) >= n, kept)


def pad_to(seq: str | Column, size: int, letter: str = "N") -> Column:
    """Filled up with ``letter``; longer sequences stay."""
    s = _c(seq)
    return F.when(F.length(s) < size, F.rpad(s, size, letter)).otherwise(s)


def extend(seq: str | Column, n: int, letter: str = "N") -> Column:
    return F.concat(_c(seq), F.lit(letter * n))


def first_word(header: str | Column) -> Column:
    return F.regexp_extract(_c(header), r"^(\S+)", 1)


def collapse_coordinates(coords: str | Column) -> Column:
    """Sorted distinct integers as ``a-b,c-d`` runs (a lone one as ``a-a``)."""
    xs = F.transform(F.sort_array(F.array_distinct(_c(coords))), lambda x: x.cast("bigint"))

    def runs(xs: Column) -> Column:
        # a run begins where the number before is not one less, and ends where the next is not one more
        starts = F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) + 1 != x))
        ends = F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1) - 1 != x))
        return F.concat_ws(",", F.zip_with(starts, ends, lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))))

    # as a lambda's variable the sorted numbers are made once, not again for each of them
    return F.get(F.transform(F.array(xs), runs), F.lit(0))


def break_by_length(df: DataFrame, size: str, most: int, order: list[str], most_rows: int | None = None) -> DataFrame:
    """Column ``part``: records in order (``order`` is unique), a new part where the total size up to the record passes another ``most``."""
    from ..operators.select import running_total

    rows = running_total(df, order, {size: "_size"} | ({"1": "_rows"} if most_rows else {}))
    part = F.floor((F.col("_size") - 1) / most)
    if most_rows:
        part = F.greatest(part, F.floor((F.col("_rows") - 1) / most_rows))
    return rows.withColumn("part", part).drop("_size", "_rows")


def _encode(name: str) -> str | None:
    return None if name is None else "SZ_" + base64.b32encode(zlib.compress(name.encode(), 9)).decode().rstrip("=")


def _decode(name: str) -> str | None:
    if name is None:
        return None
    body = name[3:]
    return zlib.decompress(base64.b32decode(body + "=" * (-len(body) % 8))).decode()


def _batched(one):
    """An Arrow UDF of a function of one string."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([one(None if pd.isna(n) else n) for n in names], dtype=object)

    return run


def encode_name(name: str | Column) -> Column:
    """Reversible safe name: SZ_ and base32 of the compressed text."""
    return _batched(_encode)(_c(name))


def decode_name(name: str | Column) -> Column:
    return _batched(_decode)(_c(name))


def genotype_count(gt: str | Column) -> Column:
    """Alleles that are present in a genotype: ``.`` and 0 count nothing, any other allele one."""
    alleles = F.split(F.regexp_extract(_c(gt), r"^([^:]*)", 1), r"[|/]")
    return F.size(F.filter(alleles, lambda a: ~a.isin("0", ".", "")))


def is_simple_snp(ref: str | Column, alt: str | Column) -> Column:
    return _c(ref).rlike("^[ACTUG]$") & _c(alt).rlike("^[ACTUG]$")


def phased_genotype(sample: str | Column) -> Column:
    """struct(left, right) of ``a|b``; nulls if not phased."""
    m = r"^([01])\|([01])"
    left = F.regexp_extract(_c(sample), m, 1)
    return F.struct(F.when(left != "", left.cast("int")).alias("left"), F.when(left != "", F.regexp_extract(_c(sample), m, 2).cast("int")).alias("right"))
