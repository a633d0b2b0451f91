"""Exact substring dedup with a blockwise suffix array over a difference cover.

Every byte that lies in a ``length``-byte string which also starts earlier (in a
smaller document, or earlier in the same one) is removed.

1. Documents are ranged by id into blocks, so block order is document order, and
   the blocks are written once as compressed buffers.  A document whose whole text
   occurs in an earlier one goes as a whole; what follows leaves it out.
2. Cover ranks: suffixes at positions whose residue modulo v lies in a difference
   cover (v = 73 with 9 residues for length 100) are sorted by their first
   ``length - v + 1`` bytes.  For any two equal strings some shift below v puts
   both on the cover, so a suffix none of whose next v cover suffixes has an equal
   has no equal itself.  The precomputed ranks thus settle which suffixes tie at
   all, before any of them is sorted.
3. One suffix bucket after another, the tying suffixes are sorted by the
   fingerprint of their first ``length`` bytes (equal strings are neighbours just as
   in byte order); within a tie the first in document order is the one kept.  A
   bucket holds a fixed share of the suffixes, so memory and shuffle stay bounded;
   within a round its sub-buckets are sorted in parallel.
4. Each block marks the strings that start earlier elsewhere and cuts their union.

The order is that of fingerprints, not of bytes: lexicographic ranks would need some
20 times the input in shuffles (see the README).  Fingerprints of strings have 128
bits, 16 bytes an entry without positions, because a block can find the order of its
own entries again.  A block sends each distinct string once, so that a string that
every document holds is one entry a block.

Cases: null and empty texts have nothing to remove; texts shorter than ``length``
stay whole; rows that repeat an id count in text order, the later copies being
removed; rows with null ids come first; a very long text is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel, scratch

LENGTH = 100
#: Perfect difference covers: modulus and residues whose differences give every residue.
COVERS = ((7, (0, 1, 3)), (13, (0, 1, 3, 9)), (31, (0, 1, 3, 8, 12, 18)), (57, (0, 1, 3, 13, 32, 36, 43, 52)), (73, (0, 1, 3, 7, 15, 31, 36, 54, 63)))
#: Rounds of suffix buckets; a round has a power of two of sub-buckets that one task sorts each,
#: at least BUCKETS and enough for BUCKET_BYTES of text to a sub-bucket.
ROUNDS = 4
BUCKETS = 64
BUCKET_BYTES = 16 << 20
#: Bytes of text in a block: what one task holds at a time, several times over.
BLOCK_BYTES = 1 << 20
#: Bytes of text whose fingerprints are taken at a time: whole documents, at least one.
CHUNK = 1 << 18
_U = np.uint64


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The widest cover that leaves cover suffixes at least a quarter of ``length`` to compare."""
    v, residues = max((c for c in COVERS if c[0] <= 3 * length // 4 + 1), default=COVERS[0])
    if v > length:
        raise ValueError("strings are too short for a difference cover")
    return v, np.array(residues)


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(block, n_bytes, ids, offs, text, rest): runs of documents in id order.

    Ids and offsets are int64 buffers, text is compressed, ``rest`` has the carried columns as an Arrow stream.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)))
    n = scratch.shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(3)
        ids: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        rest: list[pa.RecordBatch] = []
        held = k = 0

        def out() -> pa.RecordBatch:
            lens = np.concatenate(sizes)
            row = [part + k, int(lens.sum()), np.concatenate(ids).tobytes(), np.append(0, np.cumsum(lens)).astype(np.int64).tobytes(), pack.compress(np.concatenate(texts).tobytes()), pack.compress(_stream(rest))]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "n_bytes", "ids", "offs", "text", "rest"])

        for b in batches:
            names = b.column(0)
            null = np.asarray(names.is_null())
            name = np.where(null, np.iinfo(np.int64).min, names.fill_null(0).to_numpy())
            for first, last, buf, offs in kernel.texts(b.column(1)):
                ids.append(name[first:last])
                texts.append(buf)
                sizes.append(np.diff(offs))
                rest.append(b.slice(first, last - first).select(b.schema.names[2:]))
                held += len(buf)
                if held >= BLOCK_BYTES:
                    yield out()
                    ids, texts, sizes, rest, held, k = [], [], [], [], 0, k + 1
        if ids:
            yield out()

    ranged = slim.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    return ranged.mapInArrow(run, "block long, n_bytes long, ids binary, offs binary, text binary, rest binary")


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges [start, end)."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


class _Block:
    """A block's text with the fingerprints that its rounds need; ``copies`` are documents that go as a whole."""

    def __init__(self, ids: bytes, offs: bytes, text: bytes, copies: list | None, length: int):
        self.ids, self.offs = np.frombuffer(ids, np.int64), np.frombuffer(offs, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(self.offs[-1])))
        self.buf, self.length = np.frombuffer(raw, np.uint8), length
        self.v, self.residues = cover_for(length)
        self.copies = np.zeros(len(self.ids), bool)
        self.copies[copies or []] = True

    def cover(self) -> np.ndarray:
        """Positions of the cover suffixes, in order."""
        short = self.length - self.v + 1
        out = []
        for a, e, copy in zip(self.offs[:-1], self.offs[1:], self.copies):
            last = e - a - short  # the last start
            if e - a >= self.length and not copy:
                steps = np.arange(0, last + self.v, self.v)
                p = (steps[:, None] + self.residues[None]).ravel()
                out.append(a + p[p <= last])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _at(self, positions: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        """Fingerprints of the ``width`` bytes from each position (sorted, inside a document)."""
        got = []
        for a, b in kernel.chunks(self.offs, CHUNK):
            lo, hi = self.offs[a], self.offs[b]
            p = positions[np.searchsorted(positions, lo) : np.searchsorted(positions, hi)] - lo
            if len(p):
                got.append(kernel.spans(kernel.prefix(self.buf[lo:hi], which), p, p + width, which))
        return np.concatenate(got) if got else np.zeros(0, np.uint64)

    def cover_keys(self) -> np.ndarray:
        return self._at(self.cover(), self.length - self.v + 1)

    def tying(self, cover_ties: np.ndarray) -> np.ndarray:
        """Starts of strings with a cover suffix among the next v positions that has an equal."""
        n = len(self.buf)
        hit = self.cover()[cover_ties]
        starts = np.flatnonzero(_covered(n, np.maximum(hit - self.v + 1, 0), hit + 1))
        end = self.offs[np.searchsorted(self.offs, starts, "right")]
        return starts[starts + self.length <= end]

    def strings(self, starts: np.ndarray, rounds: int = 1, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (high and low half) of the strings of round ``k``, in order, and that order; equal ones come in any order."""
        hi = self._at(starts, self.length, 0)
        if rounds > 1:
            own = _bucket(hi, rounds) == k
            starts, hi = starts[own], hi[own]
        lo = self._at(starts, self.length, 1)
        order = _order(hi, lo)
        return hi[order], lo[order], order


def _order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Order by (hi, lo); equal ones come in any order."""
    order = np.argsort(hi)
    s, t = hi[order], lo[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():  # half the fingerprint collides: rare
        return np.lexsort((lo, hi))
    return order


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether each of the sorted entries differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _leads(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least index of each run of equal entries; ``first`` marks where the runs of ``order`` begin."""
    return np.minimum.reduceat(order, np.flatnonzero(first)) if len(order) else order


def _ties(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per run (distinct cover suffixes) of one bucket: bits of those that another run has too."""
    runs = [np.frombuffer(r, np.uint64) if w else np.frombuffer(r, np.uint32) for r, w in zip(pdf.run, pdf.wide)]
    every = np.sort(np.concatenate(runs))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for r in runs:
        if len(twice):
            at = np.minimum(np.searchsorted(twice, r), len(twice) - 1)
            out.append(np.packbits(twice[at] == r).tobytes())
        else:
            out.append(bytes((len(r) + 7) // 8))
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "bits": out})


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per run (distinct strings of a block) of one bucket: bits of the strings that an earlier block has."""
    pdf = pdf.sort_values("block", kind="stable")
    runs = [np.frombuffer(r, np.uint64).reshape(-1, 2) for r in pdf.run]
    cut = np.append(0, np.cumsum([len(r) for r in runs]))
    keys = np.concatenate(runs)
    order = _order(keys[:, 0], keys[:, 1])
    s = keys[order]
    later = np.ones(len(keys), bool)
    later[_leads(order, _first(s[:, 0], s[:, 1]))] = False  # runs are in document order
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "bits": [np.packbits(later[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]})


_RUN = "block long, bucket int, run binary"
_BITS = "block long, bucket int, bits binary"


def _gathered(bits: DataFrame, name: str) -> DataFrame:
    """(block, name): the bits of each block's runs in bucket order."""
    return bits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(name))


def _unpack(runs: list, bucket_of: np.ndarray) -> np.ndarray:
    """Bits of a block's runs as flags of its sorted distinct entries; ``bucket_of`` gives the entries' buckets."""
    flags = np.zeros(len(bucket_of), bool)
    for r in runs or []:
        a, b = np.searchsorted(bucket_of, [r["bucket"], r["bucket"] + 1])
        flags[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).view(bool)
    return flags


def _starts(block: _Block, packed: bytes) -> np.ndarray:
    """Starts of the block's strings that may tie."""
    bits = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, len(block.buf)))
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(block.buf)).view(bool))


def _bucket(keys: np.ndarray, total: int) -> np.ndarray:
    """The leading bits of the keys: which of ``total`` (a power of two) buckets they fall into."""
    return (keys >> _U(64 - (total - 1).bit_length())).astype(np.int64) if total > 1 else np.zeros(len(keys), np.int64)


class _Cover:
    """Sizes of the cover's buckets and keys.

    Keys need not be exact: a few suffixes that only seem to tie are sorted in vain.  32 bits below the bucket's keep
    those few while the cover has under 2**32 suffixes, beyond that all 64 bits go.
    """

    def __init__(self, n_bytes: int, buckets: int):
        self.buckets, self.wide = buckets, n_bytes >> 35 > 0
        self.shift = _U(0) if self.wide else _U(32 - (buckets - 1).bit_length())

    def entries(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's cover keys as they are compared, in order; that order; which differ from the one before."""
        keys = block.cover_keys() >> self.shift
        order = np.argsort(keys)
        return keys[order], order, _first(keys[order])

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return _bucket(keys << self.shift, self.buckets)

    def runs(self, block: _Block, name: int) -> pa.RecordBatch:
        keys, _, first = self.entries(block)
        keys = keys[first]
        return _batch(name, self.bucket(keys), keys if self.wide else keys.astype(np.uint32))

    def ties(self, block: _Block, runs: list) -> np.ndarray:
        """Which cover suffixes of the block have an equal, in it or elsewhere."""
        keys, order, first = self.entries(block)
        group = np.cumsum(first) - 1
        found = _unpack(runs, self.bucket(keys[first])) | (np.bincount(group, minlength=int(first.sum())) > 1)
        flags = np.zeros(len(keys), bool)
        flags[order] = found[group]
        return flags


def _texts(blocks: DataFrame, length: int) -> DataFrame:
    """(block, k, text): digests of the whole texts of at least ``length`` bytes, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                block = _Block(row["ids"], row["offs"], row["text"], None, length)
                raw, at = block.buf.tobytes(), [k for k in range(len(block.ids)) if block.offs[k + 1] - block.offs[k] >= length]
                text = [hashlib.sha256(raw[block.offs[k] : block.offs[k + 1]]).digest() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.binary())], ["block", "k", "text"])

    every = blocks.select("block", "ids", "offs", "text").mapInArrow(run, "block long, k int, text binary")
    return scratch.written(every, "suffix-texts")


def _copies(every: DataFrame) -> DataFrame:
    """(block, copies): documents whose whole text an earlier document has."""
    first = every.groupBy("text").agg(F.min(F.struct("block", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").select("text", "first")
    return every.join(first, "text").where(F.struct("block", "k") != F.col("first")).groupBy("block").agg(F.collect_list("k").alias("copies"))


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept, kept_text): every document with the spans to remove and what stays.

    ``kept`` has the bytes that stay; ``kept_text`` drops what is left of a character whose bytes were cut.
    The columns ``carry`` come along, named carry_0 and so on.
    """
    spark = docs.sparkSession
    cover_for(length)
    if rounds & (rounds - 1):
        raise ValueError("rounds must be a power of two")
    blocks = scratch.written(_blocks(docs, id_col, text_col, carry), "suffix-blocks")
    scratch.release(spark)
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(BUCKETS, 1 << (n_bytes // (rounds * BUCKET_BYTES)).bit_length())
    total = rounds * buckets
    cover = _Cover(n_bytes, buckets)
    texts = _texts(blocks, length)
    marked = scratch.written(blocks.join(_copies(texts), "block", "left"), "suffix-copies")
    scratch.remove(texts)
    scratch.remove(blocks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                row["row"] = b.slice(i, 1)
                yield row, _Block(row.pop("ids"), row.pop("offs"), row.pop("text"), row.pop("copies"), length)
                kernel.trim()

    def cover_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            yield cover.runs(block, row["block"])

    runs = marked.drop("rest").mapInArrow(cover_runs, _RUN).withColumn("wide", F.lit(cover.wide))
    ties = scratch.written(_gathered(runs.groupBy("bucket").applyInPandas(_ties, _BITS), "ties"), "suffix-ties")
    columns = marked.columns

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            found = np.zeros(len(block.buf), bool)
            found[block.tying(cover.ties(block, row["ties"]))] = True
            packed = zstandard.ZstdCompressor(3).compress(np.packbits(found).tobytes())
            yield pa.RecordBatch.from_arrays([row["row"].column(c) for c in columns] + [pa.array([packed])], [*columns, "starts"])

    # found once and for all: the rounds read the blocks with the starts that tie and shuffle only keys
    tied = marked.join(ties, "block", "left").mapInArrow(starts, T.StructType([*marked.schema, T.StructField("starts", T.BinaryType())]))
    tied = scratch.written(tied, "suffix-tied")
    scratch.remove(marked)
    scratch.remove(ties)
    scratch.release(spark)

    def string_runs(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, block in each(batches):
                hi, lo, _ = block.strings(_starts(block, row["starts"]), rounds, k)
                first = _first(hi, lo)
                yield _batch(row["block"], _bucket(hi[first], total), np.column_stack([hi[first], lo[first]]))

        return run

    found = None
    for k in range(rounds):
        bits = scratch.written(tied.drop("rest").mapInArrow(string_runs(k), _RUN).groupBy("bucket").applyInPandas(_later, _BITS), "suffix-bits")
        found = bits if found is None else found.union(bits)
        scratch.release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            at = _starts(block, row["starts"])
            hi, lo, order = block.strings(at)
            first = _first(hi, lo)
            later = np.ones(len(at), bool)
            later[_leads(order, first)] = _unpack(row["later"], _bucket(hi[first], total))
            at = at[later]
            gone = _covered(len(block.buf), at, at + length) | np.repeat(block.copies, np.diff(block.offs))
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(row["rest"])).read_all().combine_chunks()
            yield from _cuts(block, gone, rest)

    marked = tied.join(_gathered(found, "later"), "block", "left")
    schema = T.StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_text string")
    for k, c in enumerate(carry):
        schema = schema.add(f"carry_{k}", docs.schema[c].dataType)
    return marked.mapInArrow(cut, schema)


def _batch(block: int, bucket_of: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that the sorted entries fall into."""
    entries = np.ascontiguousarray(entries)
    begin = np.flatnonzero(_first(bucket_of))
    ends = np.append(begin, len(bucket_of)).astype(np.int32) * np.int32(entries.nbytes // max(1, len(entries)))
    run = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(entries)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), block, np.int64)), pa.array(bucket_of[begin].astype(np.int32)), run], ["block", "bucket", "run"])


def _cuts(block: _Block, gone: np.ndarray, rest: pa.Table) -> Iterator[pa.RecordBatch]:
    """Result rows of a block from the mask of removed bytes, about a megabyte of text at a time."""
    spans_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for a, b in kernel.chunks(block.offs):
        rows = []
        for d in range(a, b):
            lo, hi = block.offs[d], block.offs[d + 1]
            g, t = gone[lo:hi], block.buf[lo:hi]
            flip = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).view(np.int8)))
            kept = (t[~g] if len(flip) else t).tobytes()
            ident = int(block.ids[d])
            rows.append((None if ident == np.iinfo(np.int64).min else ident, hi - lo, int(g.sum()), len(flip) // 2, [{"start": int(x), "end": int(y)} for x, y in zip(flip[::2], flip[1::2])], kept, kept.decode(errors="ignore")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), spans_of, pa.binary(), pa.string()]
        more = rest.slice(a, b - a)
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [c.combine_chunks() for c in more.columns]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text", *more.schema.names])


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every repeated string cut from its texts and ``chars_col`` (if there) set anew; documents left empty go."""
    others = [c for c in docs.columns if c not in (id_col, text_col, chars_col)]
    found = repeats(docs, length, id_col, text_col, carry=tuple(others)).where(F.length("kept_text") > 0)
    cols = {c: F.col(f"carry_{k}").alias(c) for k, c in enumerate(others)}
    cols |= {id_col: F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), text_col: F.col("kept_text").alias(text_col)}
    if chars_col in docs.columns:
        cols[chars_col] = F.length("kept_text").cast(docs.schema[chars_col].dataType).alias(chars_col)
    return found.select(*(cols[c] for c in docs.columns))
