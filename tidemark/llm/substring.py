"""Substring dedup over words: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A window is removed where its words also start in a document with a smaller id; the
windows removed in a document merge into maximal intervals.

A window's hash is a polynomial over its words' hashes at four bases modulo the prime
2**31 - 1 (124 bits), rolled along by prefix sums.  So that not every window travels,
neighbouring windows are counted as runs first: each window points at the least of the
hashes of its shorter sub-windows (the leftmost on a tie), which equal windows do alike
wherever they lie, and consecutive windows that point at one place form a run.  Then

* runs whose sub-window is found under one id only hold no window that goes;
* a run equal to one under a smaller id goes as a whole;
* where a sub-window has different runs, the windows of the runs that are left are
  counted one by one, and those whose least id is smaller go.

No window, document or partner is left out at any step.  Equality is that of 124-bit
hashes of 62-bit word hashes.

Cases: null and empty texts, and texts shorter than a window, lose nothing; ids may be
of any type that has an order; null ids come after all others and are not smaller than
one another (an integer id of 2**63 - 1 counts like null); rows that repeat an id each
stand for themselves and take nothing from one another, and equal rows get equal
results; repeated windows within one document stay; texts are taken whole (beyond a
megabyte in blocks of words, so a task holds about ten times the longest text); further
columns are not read, and the result has only its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel, scratch

WIDTH = 50
#: Windows that a step hashes at a time.
WINDOWS = 1 << 17
#: Fixed random numbers: bases of the window hash.
_BASES = tuple(int(b) for b in np.random.default_rng(20240611).integers(1 << 20, (1 << 31) - 2, 4))
_U = np.uint64
_SPAN = "array<struct<start:int,n:int>>"


def _place(ids: Column, kind: T.DataType) -> Column:
    """What orders ids, null last; never null itself.  An integer compares as such, anything else as a struct."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(ids.cast("long"), F.lit(2**63 - 1))
    return F.struct(ids.isNull().alias("nil"), ids.alias("id"))


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of each word of one text, block by block."""
    got, a = [], 0
    while a < len(buf):
        b = min(a + kernel.CHUNK, len(buf))
        while b < len(buf) and not kernel.SPACE[buf[b - 1]]:  # a block ends after a word
            step = np.flatnonzero(kernel.SPACE[buf[b : b + kernel.CHUNK]])
            b = b + int(step[0]) + 1 if len(step) else min(b + kernel.CHUNK, len(buf))
        part = buf[a:b]
        starts, ends, _ = kernel.words(part, np.array([0, len(part)]))
        got.append(kernel.spans(kernel.prefix(part), starts, ends))
        a = b
    return np.concatenate(got) if got else np.zeros(0, _U)


class Windows:
    """Rolling hashes over a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = [kernel.sums(kernel.mix(words + _U(k)) & kernel.PRIME, b) for k, b in enumerate(_BASES)]

    def half(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """One of the two independent 62-bit halves of the hash of words [start, end)."""
        k = 2 * which
        one, two = (kernel.between(self.sums[j], _BASES[j], start, end) for j in (k, k + 1))
        return one << _U(31) | two


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values the index of its least one, the leftmost on a tie."""
    at, size = np.arange(len(values)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[left] <= values[right], left, right)

    while 2 * size <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    if size < width:
        at = better(at[: size - width], at[width - size :])
    return at


def runs(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, sub-window hash, two halves of the run's hash) of each run; ``doc`` numbers the words' documents."""
    if len(words) < width:
        z = np.zeros(0, np.int64)
        return z, z, *[np.zeros(0, _U)] * 3
    rolled, sub = Windows(words), max(1, width // 3)
    at = np.arange(len(words) - sub + 1)
    short = kernel.mix(rolled.half(at, at + sub, 0))
    own = least_places(short, width - sub + 1)
    inside = doc[: len(own)] == doc[width - 1 :]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(own)] != doc[: len(own) - 1])]
    first = np.flatnonzero(fresh)
    n = np.diff(np.r_[first, len(own)])
    kept = inside[first]
    first, n = first[kept], n[kept]
    end = first + n - 1 + width
    return first, n, short[own[first]], rolled.half(first, end, 0), rolled.half(first, end, 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut(width: int):
    """Runs of every text of the batches (key, hash of the text, text)."""
    names = ["place", "text_hash", "sub", "run_a", "run_b", "start", "n"]

    def rows(b: pa.RecordBatch, doc: np.ndarray, start: np.ndarray, found: tuple) -> pa.RecordBatch:
        at = pa.array(doc)
        _, n, sub, one, two = found
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _long(sub), _long(one), _long(two), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, buf, offs in kernel.texts(b.column(2)):
                if len(offs) == 2 and len(buf) > 2 * kernel.CHUNK:  # one long text
                    words = word_hashes(buf)
                    for k in range(0, max(1, len(words) - width + 1), WINDOWS):
                        part = words[k : k + WINDOWS + width - 1]
                        found = runs(part, np.zeros(len(part), np.int8), width)
                        yield rows(b, np.full(len(found[0]), a), found[0] + k, found)
                    kernel.trim()
                    continue
                starts, ends, doc = kernel.words(buf, offs)
                found = runs(kernel.spans(kernel.prefix(buf), starts, ends), doc, width)
                lead = np.searchsorted(doc, np.arange(len(offs) - 1))  # a document's first word
                own = doc[found[0]]
                yield rows(b, own + a, found[0] - lead[own], found)

    return cut


def _listed(col: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows in the list of one row; none where it is null."""
    spans = col[row].values
    if spans is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spans.field("start").to_numpy().astype(np.int64), spans.field("n").to_numpy().astype(np.int64)


def _single(width: int):
    """Hashes of the windows that (key, hash of the text, text, list of runs) name, one row each."""
    names = ["place", "text_hash", "win_a", "win_b", "start"]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, buf, offs in kernel.texts(b.column(2)):
                for d in range(a, z):
                    first, n = _listed(b.column(3), d)
                    rolled = Windows(word_hashes(buf[offs[d - a] : offs[d - a + 1]]))
                    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    for k in range(0, len(at), WINDOWS):
                        p = at[k : k + WINDOWS]
                        own = pa.array(np.full(len(p), d))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), _long(rolled.half(p, p + width, 0)), _long(rolled.half(p, p + width, 1)), pa.array(p.astype(np.int32))], names)

    return single


def _removed(width: int):
    """Counts, maximal intervals and what is left of every text (id, text, list of removed runs)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for d, text in enumerate(b.column(1)):
                words = (text.as_py() or b"").split()
                first, n = _listed(b.column(2), d)
                lo, hi, left = np.zeros(0, np.int64), np.zeros(0, np.int64), words
                if len(first):
                    edge = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + n - 1 + width, minlength=len(words) + 1)
                    gone = np.diff(np.r_[0, np.cumsum(edge[:-1]) > 0, 0])
                    lo, hi = np.flatnonzero(gone == 1), np.flatnonzero(gone == -1)
                    left = [w for p, q in zip(np.r_[0, hi], np.r_[lo, len(words)]) for w in words[p:q]]
                n_words.append(len(words))
                n_removed.append(int((hi - lo).sum()))
                spans.append([{"start": p, "end": q} for p, q in zip(lo.tolist(), hi.tolist())])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "spans", "kept"])

    return removed


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for every row: the removed word intervals [start, end) and the words left, joined by one space."""
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), _place(F.col(id_col), kind).alias("place"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    key = f"place {slim.schema['place'].dataType.simpleString()}, text_hash long"
    found = slim.select("place", "text_hash", "text").mapInArrow(_cut(width), f"{key}, sub long, run_a long, run_b long, start int, n int")
    found = scratch.written(found, "window-runs")
    # sub-windows under several ids; ``mixed`` if their runs differ
    ids = [F.min("place").alias("first_place"), F.max("place").alias("last_place")]
    common = found.groupBy("sub").agg(*ids, (F.min("run_a") < F.max("run_a")).alias("mixed")).where("first_place < last_place").select("sub", "mixed")
    common = scratch.written(common, "window-subs")  # a table of its own, so that a hot key's rows can be split in the join
    some = scratch.written(found.join(common, "sub").drop("sub"), "window-common")
    whole = scratch.written(some.groupBy("run_a", "run_b").agg(*ids).where("first_place < last_place").drop("last_place"), "window-whole")
    told = some.join(whole, ["run_a", "run_b"], "left").withColumn("gone", F.coalesce(F.col("place") > F.col("first_place"), F.lit(False)))
    told = scratch.written(told.where("gone or mixed").select("place", "text_hash", "start", "n", "gone"), "window-told")
    listed = F.collect_set(F.struct("start", "n")).cast(_SPAN)
    opened = told.where("not gone").groupBy("place", "text_hash").agg(listed.alias("open"))
    single = slim.select("place", "text_hash", "text").join(opened, ["place", "text_hash"])
    single = single.select("place", "text_hash", "text", "open").mapInArrow(_single(width), f"{key}, win_a long, win_b long, start int")
    single = scratch.written(single, "window-single")
    least = scratch.written(single.groupBy("win_a", "win_b").agg(*ids).where("first_place < last_place").drop("last_place"), "window-least")
    more = single.join(least, ["win_a", "win_b"]).where("place > first_place").select("place", "text_hash", "start", F.lit(1).alias("n"))
    gone = told.where("gone").drop("gone").unionByName(more).groupBy("place", "text_hash").agg(listed.alias("gone"))
    rows = slim.join(gone, ["place", "text_hash"], "left").select("id", "text", "gone")
    return rows.mapInArrow(_removed(width), f"id {kind.simpleString()}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every document with the words that are left, joined by one space."""
    return repeats(docs, width, id_col, text_col).select("id", F.col("kept").cast("string").alias("text"))
