"""Errors of aligned reads: alignment columns, difference lists and the shares of each kind.

Alignments are rows (id, cigar, query, target, qs, ts): ``qs`` and ``ts`` are where the
aligned part begins in the two sequences, from 0, and ids are unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cg

_QUERY, _TARGET = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")


def blocks(alignments: DataFrame) -> DataFrame:
    """``alignments`` with ``blocks``: array<struct(op, n, q, t)>, each operation with where it begins in query and target.

    Places are running sums over operations; only those travel, not the sequences.
    """
    ops = alignments.select("id", F.posexplode(cg.parse("cigar")).alias("k", "x")).select("id", "k", "x.n", "x.op")
    before = W.partitionBy("id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)

    def at(which: tuple) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op").isin(*which), F.col("n")).otherwise(0)).over(before), F.lit(0))

    placed = ops.withColumns({"q": at(_QUERY), "t": at(_TARGET)})
    by = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "op", "n", "q", "t"))), lambda b: F.struct(b["op"].alias("op"), b["n"].alias("n"), (b["q"]).alias("q"), (b["t"]).alias("t"))).alias("blocks"))
    return alignments.join(by, "id", "left")


def _piece(text: str, start: Column, n: Column) -> Column:
    return F.substr(F.col(text), (start + 1).cast("int"), n)


def _letters(text: Column) -> Column:
    """The letters of a text in one pass; a substring for each would walk the text again and again."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def columns(alignments: DataFrame) -> DataFrame:
    """(id, i, kind, base, ref): the columns of each alignment in order; kind is match, mismatch, insertion or deletion."""
    flat = blocks(alignments).select("id", F.posexplode("blocks").alias("k", "b"), "query", "target", "qs", "ts").where(F.col("b.op").isin("M", "=", "X", "I", "D"))
    base = F.when(F.col("b.op") != "D", _piece("query", F.col("qs") + F.col("b.q"), F.col("b.n"))).otherwise("")
    ref = F.when(F.col("b.op") != "I", _piece("target", F.col("ts") + F.col("b.t"), F.col("b.n"))).otherwise("")
    pieces = flat.select("id", "k", "b.op", F.arrays_zip(_letters(base).alias("base"), _letters(ref).alias("ref")).alias("x"))
    each = pieces.select("id", "k", "op", F.posexplode("x").alias("j", "x"))
    one = each.select("id", "k", "j", "op", F.coalesce("x.base", F.lit("")).alias("base"), F.coalesce("x.ref", F.lit("")).alias("ref"))
    kind = F.when(F.col("op") == "I", "insertion").when(F.col("op") == "D", "deletion").when(F.col("base") == F.col("ref"), "match").otherwise("mismatch")
    return one.select("id", (F.col("k").cast("long") * (1 << 32) + F.col("j")).alias("i"), kind.alias("kind"), "base", "ref")


def known(cols: DataFrame) -> DataFrame:
    """Columns without N on either side."""
    return cols.where("base <> 'N' AND ref <> 'N'")


#: Columns that are gathered before they are counted.
CHUNK = 1 << 18
_KINDS = ("match", "mismatch", "insertion", "deletion")


def _codes(text: str) -> np.ndarray:
    """Code points plus one, so that 0 stands for no letter."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def _walk(cigar: str, query: str, target: str, qs: int, ts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, base and ref of the columns of one alignment, as in ``columns``."""
    q, t = _codes(query), _codes(target)
    out = [(np.zeros(0, np.int64),) * 3]
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=XID":
            base = q[qs : qs + n] if op != "D" else q[:0]
            ref = t[ts : ts + n] if op != "I" else t[:0]
            size = max(len(base), len(ref))
            base, ref = np.pad(base, (0, size - len(base))), np.pad(ref, (0, size - len(ref)))
            kind = np.full(size, 2 + (op == "D")) if op in "ID" else (base != ref).astype(np.int64)
            out.append((kind, base, ref))
        qs += n * (op in _QUERY)
        ts += n * (op in _TARGET)
    return tuple(np.concatenate(x) for x in zip(*out))


def _tally(rows: list[tuple]) -> Iterator[tuple]:
    """Each distinct row of parallel arrays with how often it stands there."""
    cols = [np.concatenate(x) for x in zip(*rows)]
    letters = np.unique(np.concatenate([np.flatnonzero(np.bincount(c)) for c in cols]))
    places = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
    places[letters] = np.arange(len(letters))
    key = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        key = key * max(len(letters), 1) + places[c]
    seen, n = np.unique(key, return_counts=True) if len(letters) ** len(cols) > 1 << 20 else ((b := np.bincount(key)).nonzero()[0], b[b > 0])
    back = []
    for _ in cols:
        back.append(letters[seen % len(letters)] if len(seen) else seen)
        seen = seen // max(len(letters), 1)
    return zip(*(x.tolist() for x in reversed(back)), n.tolist())


def _letter(code: int) -> str:
    return chr(code - 1) if code else ""


def _counted(alignments: DataFrame, of, shown, schema: str) -> DataFrame:
    """Columns of alignments counted where they are read; ``of`` makes the rows of one alignment, ``shown`` names a distinct one."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows.append(of(*_walk(r.cigar, r.query, r.target, int(r.qs), int(r.ts))))
                size += len(rows[-1][0])
                if size >= CHUNK:
                    yield pd.DataFrame([(*shown(*x[:-1]), x[-1]) for x in _tally(rows)], columns=[*names, "n"])
                    rows, size = [], 0
        if size:
            yield pd.DataFrame([(*shown(*x[:-1]), x[-1]) for x in _tally(rows)], columns=[*names, "n"])

    needed = ("cigar", "query", "target", "qs", "ts")
    whole = alignments.select(*needed).where(" AND ".join(f"{c} IS NOT NULL" for c in needed))
    return whole.mapInPandas(run, schema + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))


def counts(alignments: DataFrame) -> DataFrame:
    """(kind, base, ref, n): the columns of all alignments, counted; ``known`` leaves out those with N."""
    return _counted(alignments, lambda *x: x, lambda kind, base, ref: (_KINDS[kind], _letter(base), _letter(ref)), "kind string, base string, ref string")


def profile(alignments: DataFrame) -> DataFrame:
    """(before, after, ref, base, n): ``reads.error_profile`` of the ``known`` columns, counted."""
    unknown = ord("N") + 1

    def around(kind: np.ndarray, base: np.ndarray, ref: np.ndarray) -> tuple:
        here = (base != unknown) & (ref != unknown) & (ref != 0)
        base, ref = base[here], ref[here]
        return ref[:-2], ref[2:], ref[1:-1], base[1:-1]

    return _counted(alignments, around, lambda *x: tuple(map(_letter, x)), "before string, after string, ref string, base string")


def differences(alignments: DataFrame, most: int = 100) -> DataFrame:
    """(id, differences, errors, rate): how each read departs from its target, places counted from 1 at the alignment's start.

    ``5A>C`` is a mismatch, ``5+GG`` letters inserted before the place, ``5-A`` a letter deleted; ``*`` stands for none.  Letters N in
    the read are not named, though they count as errors.  Alignments with other operations than M, I and D, or that run over an end,
    are left out, and so are those with more than ``most`` errors in a hundred letters of the read (whole per cent).
    """
    rows = alignments.select("id", "cigar", "query", "target", "qs", "ts").where(F.col("cigar").rlike(r"^([0-9]+[MID])+$") & F.col("query").isNotNull() & F.col("target").isNotNull() & F.col("qs").isNotNull() & F.col("ts").isNotNull())

    def told(cigar: str, query: str, target: str, qs: int, ts: int) -> tuple[str, int] | None:
        """The names and the number of errors of one alignment; None where it runs over an end."""
        ops = [(int(n), op) for n, op in re.findall(r"([0-9]+)([MID])", cigar)]
        if qs + sum(n for n, op in ops if op != "D") > len(query) or ts + sum(n for n, op in ops if op != "I") > len(target):
            return None
        names, errors, at, x, y = [], 0, 0, _codes(query), _codes(target)
        for n, op in ops:
            q, t = qs, ts + at
            if op == "M":
                wrong = np.flatnonzero(x[q : q + n] != y[t : t + n]).tolist()
                names += [f"{at + i + 1}{target[t + i]}>{query[q + i]}" for i in wrong if query[q + i] != "N"]
                errors += len(wrong)
            elif op == "I":
                base = query[q : q + n]
                names += [f"{at + 1}+{base}"] if base.strip("Nn") else []
                errors += n
            else:
                names += [f"{at + i + 1}-{target[t + i]}" for i in range(n)]
                errors += n
            qs, at = qs + n * (op != "D"), at + n * (op != "I")
        return " ".join(names) or "*", errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = told(r.cigar, r.query, r.target, int(r.qs), int(r.ts))
                if x and (rate := 100 * x[1] // max(len(r.query), 1)) <= most:
                    out.append((r.id, *x, rate))
            yield pd.DataFrame(out, columns=["id", "differences", "errors", "rate"])

    return rows.mapInPandas(run, f"id {dict(alignments.dtypes)['id']}, differences string, errors long, rate long")
