"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of five segments.  If two of them
differ in at most ``TAU`` = 2 bits, some start on the ring has every prefix of
its chain of consecutive segments within the proportional budget floor(l * 2/5):
none in the first two segments, at most one in three and four, two in all
(pigeonring principle).  So candidates meet on two whole segments (25 or 26 bits)
in five rotations, the chain prunes them, and the full Hamming distance is
checked last.  Equal fingerprints are folded into one row before anything meets.

``near_duplicates`` is exact for that budget.  ``first_of_group``, the pipeline's
stage, looks for similar texts: fingerprints of 1,024 bits over five-word shingles that
link within ``SIMILAR`` bits.  Texts meet where they share one of ``ROUTES`` min-hashes of
their shingles, so the work is linear in the texts; of pairs with a similarity s a share
of 1 - (1 - s)**ROUTES meets (0.998 at 0.8).  What meets is compared by pigeonring on a
ring of 57 segments: some chain differs in at most 2 bits in its first segment and 8 in
its first three.  Small groups prune all their pairs by the ring's words; in large ones
each segment looks up all 172 changes of up to two bits, the chain prunes, and the full
Hamming distance decides.  Groups beyond ``GROUP`` rows are compared block by block, in
tasks of two blocks.  Pairs that other links have already joined need no comparing.

Cases: null and empty texts have fingerprint 0 and link like any other; null ids
take the component of their fingerprint (null if all its ids are); repeated rows stay
repeated in ``near_duplicates``, and of a group ``first_of_group`` keeps one row: the least
id, then the first row read; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import features, graph, kernel, scratch

TAU = 2
SEGMENTS = (13, 13, 13, 13, 12)
#: Sorted groups up to this size compare all their pairs; larger ones probe every allowed change instead.
PROBE_FROM = 1500
_TURNS = [SEGMENTS[i:] + SEGMENTS[:i] for i in range(5)]
#: Words of a wide fingerprint, and most of their 1,024 bits that differ in linked texts: texts with a similarity of 0.8 differ in
#: 1024 / pi * acos(2 * 0.8 / 1.8) = 155 on average, with a deviation of 11, so nine in ten of them link.
_WIDE = 16
SIMILAR = 170
#: Segments of the wide ring (170 bits in all are at most two in one of 57); most differing bits in a chain's first three.
_ARCS = (18,) * 55 + (17,) * 2
_THREE = 3 * SIMILAR // len(_ARCS)
#: Min-hashes by which texts meet.
ROUTES = 4
#: Rows of a group that are compared in one task, and up to how many all pairs are pruned directly.
GROUP, DIRECT = 1 << 16, 300
#: Candidate pairs that are looked at at a time.
CANDIDATES = 1 << 20
_KEY = np.array([sum(t[:2]) for t in _TURNS], np.uint64)
_AFTER3 = np.array([64 - sum(t[:3]) for t in _TURNS], np.uint64)
_AFTER4 = np.array([64 - sum(t[:4]) for t in _TURNS], np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of one text."""
    return int(_fingerprints([text], width, seed)[0])


def _hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, seed)]
    ends = list(accumulate([len(w) + 1 for w in words]))
    return [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]


def _fingerprints(texts: list[bytes], width: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    parts: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        h = np.array(_hashes(t, width, seed), np.uint64)
        parts.append(h)
        sizes[i] = len(h)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.cumsum(sizes[full]) - sizes[full]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        on = 2 * ones > sizes[full][:, None]
        out[full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for _, _, buf, offs in kernel.texts(batch.column(1)):
                raw = buf.tobytes()
                got.append(_fingerprints([raw[a:b] for a, b in zip(offs[:-1], offs[1:])], width, seed))
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def _changes(free: int) -> np.ndarray:
    """All changes of one or two of the low ``free`` bits."""
    one = [1 << i for i in range(free)]
    return np.array(one + [x | y for k, x in enumerate(one) for y in one[:k]], np.uint64)


def _links(ring: np.ndarray, rot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``TAU`` bits among rows sorted by (group, ring); ``bounds``: group starts and the end."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size = np.diff(bounds)
    big = size > PROBE_FROM
    end = np.repeat(bounds[1:], size)
    # bits that are left after three and after four segments of the ring that starts at rot
    after3, after4 = _AFTER3[rot], _AFTER4[rot]
    i = np.flatnonzero(~np.repeat(big, size))
    d = 1
    while len(i := i[i + d < end[i]]):
        x = ring[i] ^ ring[i + d]
        ok = np.bitwise_count(x >> after3[i]) <= 1
        ok[ok] = np.bitwise_count(x[ok] >> after4[i[ok]]) <= 1
        ok[ok] = np.bitwise_count(x[ok]) <= TAU
        left.append(i[ok])
        right.append(i[ok] + d)
        d += 1
    for k in np.flatnonzero(big):
        lo, hi = bounds[k], bounds[k + 1]
        own = ring[lo:hi]
        for m in _changes(64 - int(_KEY[rot[lo]])):
            want = own ^ m
            at = np.minimum(np.searchsorted(own, want), hi - lo - 1)
            hit = np.flatnonzero((own[at] == want) & (at > np.arange(hi - lo)))
            left.append(lo + hit)
            right.append(lo + at[hit])
    if not left:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(left), np.concatenate(right)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a partition that is sorted by ``names``; no group of equal ``names`` is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(t.num_rows, bool)
        for n in names:
            v = t.column(n).to_numpy()
            last &= v == v[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition of rotated fingerprints sorted by rot and key, as stars within each group that is linked."""
    for t in _whole_groups(batches, ("rot", "key")):
        yield from _met(t)


def _met(t: pa.Table) -> Iterator[pa.RecordBatch]:
    rot = t.column("rot").to_numpy()
    ring = t.column("ring").to_numpy().view(np.uint64)
    rep = t.column("rep").to_numpy()
    key = (ring >> (np.uint64(64) - _KEY[rot])) | (rot.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((ring, key))
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    met = ~(first & np.r_[first[1:], True])  # alone in its group: nothing to compare
    order, key = order[met], key[met]
    if not len(order):
        return
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    rep = rep[order]
    a, b = _links(ring[order], rot[order], bounds)
    if not len(a):
        return
    root = graph.local_roots(len(rep), a, b)
    u = np.flatnonzero(root != np.arange(len(rep)))
    yield pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[root[u]])], ["a", "b"])


def _grouped(links: DataFrame, distinct: DataFrame) -> DataFrame:
    """``distinct`` (node, first, ...) with the least ``first`` of each node's component as ``component``."""
    comp = graph.components(links, "a", "b").withColumnRenamed("id", "node").withColumnRenamed("component", "root")
    known = distinct.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return known.join(known.groupBy("root").agg(F.min("first").alias("component")), "root").drop("root")


def _parts(distinct: DataFrame, starts: int) -> int:
    """Partitions of about a million rows each when every row of ``distinct`` meets at ``starts`` starts."""
    return max(scratch.shuffle_partitions(distinct.sparkSession), distinct.count() * starts >> 20)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long, component): documents whose fingerprints chain within two bits share a component."""
    fps = scratch.written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("first"))
    distinct = scratch.written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    starts = list(accumulate((0, *SEGMENTS[:-1])))
    ring = F.array(*(F.struct(F.lit(i).alias("rot"), F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s) if s else F.lit(0).cast("long")).alias("ring")) for i, s in enumerate(starts)))
    rotated = distinct.select(F.col("node").alias("rep"), F.explode(ring).alias("x")).select("rep", "x.rot", "x.ring")
    rotated = rotated.withColumn("key", F.when(F.col("rot") >= 3, F.shiftrightunsigned("ring", 64 - 25)).otherwise(F.shiftrightunsigned("ring", 64 - 26)))
    links = rotated.repartition(_parts(distinct, len(SEGMENTS)), "rot", "key").sortWithinPartitions("rot", "key").mapInArrow(_meet, "a long, b long")
    named = _grouped(links, distinct).select("fp", "component")
    return fps.join(named, "fp").select("id", "fp", "component")


_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
_SPREAD = _SPREAD.sum(1, dtype=np.uint64)


def wide_fingerprints(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> np.ndarray:
    """SimHash of 1,024 bits (documents x 16 words) of the lower-cased texts' shingles of ``width`` words, repeats included."""
    return _wide(buf, offs, width)[0]


def _wide(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprints and the min-hashes (documents x ROUTES) of the same shingles."""
    n = len(offs) - 1
    out, route = np.zeros((n, _WIDE), np.uint64), np.zeros((n, ROUTES), np.uint64)
    low = kernel.LOWER[buf]
    starts, ends, doc = kernel.words(low, offs)
    if not len(starts):
        return out, route
    word = kernel.spans(kernel.prefix(low), starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    left = np.repeat(first + count, count) - np.arange(len(word))  # words up to the document's end
    own = np.flatnonzero((left >= width) | (np.arange(len(word)) == first[doc]))  # a shorter text is one shingle
    h = np.full(len(own), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(width):
        inside = left[own] > k
        nxt = word[np.minimum(own + k, len(word) - 1)]
        h = np.where(inside, kernel.mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt), h)
    d = doc[own]
    # eight counters of eight bits to a 64-bit number: sums of up to 255 shingles do not overflow
    begin = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    size = np.diff(np.r_[begin, len(d)])
    steps = -(-size // 255)
    cut = np.repeat(begin, steps) + 255 * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    piece = np.cumsum(steps) - steps
    who = d[begin]
    for w in range(_WIDE):
        bits = kernel.mix(h + np.uint64((w + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))).view(np.uint8).reshape(-1, 8)
        ones = np.stack([np.add.reduceat(_SPREAD[bits[:, k]], cut).view(np.uint8).reshape(-1, 8) for k in range(8)], 1).reshape(-1, 64)
        ones = np.add.reduceat(ones, piece, axis=0, dtype=np.int64)
        out[who, w] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    for k in range(ROUTES):
        route[who, k] = np.minimum.reduceat(kernel.mix(h ^ np.uint64((2 * k + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))), begin)
    return out, route


def _alike(f: np.ndarray, cut: int, arcs: list[int]) -> np.ndarray:
    """Smallest index that each row of ``f`` reaches over links within ``SIMILAR`` bits whose chain starts in one of ``arcs``.

    The first ``cut`` rows are compared with the others, or all with each other if there are no others.
    """
    n, root, found = len(f), np.arange(len(f)), []

    def join() -> None:
        nonlocal root
        if found:
            root = graph.local_roots(n, *np.concatenate(found, axis=1), root)
            found.clear()

    for arc in arcs:
        w, off = divmod(sum(_ARCS[:arc]), 64)
        ring = f[:, w] >> np.uint64(off)
        if off:
            ring = ring | f[:, (w + 1) % _WIDE] << np.uint64(64 - off)
        width = _ARCS[arc]
        ring &= np.uint64((1 << sum((_ARCS * 2)[arc : arc + 3])) - 1)
        key = (ring & np.uint64((1 << width) - 1)).astype(np.int32)
        left = np.argsort(key[:cut])
        right = cut + np.argsort(key[cut:]) if cut < n else left
        own, a_ring, b_ring = key[left], ring[left], ring[right]
        at = np.append(0, np.cumsum(np.bincount(key[right], minlength=1 << width))).astype(np.int32)

        def compare(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            """Links of the rows ``i`` of the left side with the rows [lo, hi) of the right one."""
            some = np.flatnonzero(hi > lo)
            i, lo, hi = i[some], lo[some], hi[some]
            while len(i):
                size = (hi - lo).astype(np.int64)
                if size.sum() > n:  # many: leave out what is joined already
                    join()
                    r = root[right]
                    turn = np.append(0, np.cumsum(r[1:] != r[:-1]))
                    todo = (turn[lo] != turn[hi - 1]) | (r[lo] != root[left[i]])
                    i, lo, hi, size = i[todo], lo[todo], hi[todo], size[todo]
                    if not len(i):
                        return
                end = np.cumsum(size)
                k = max(1, int(np.searchsorted(end, CANDIDATES, "right")))
                b = np.arange(end[k - 1]) + np.repeat(lo[:k] - (end[:k] - size[:k]), size[:k])
                near = np.flatnonzero(np.bitwise_count(np.repeat(a_ring[i[:k]], size[:k]) ^ b_ring[b]) <= _THREE)
                if len(near):
                    p, q = left[i[np.searchsorted(end, near, "right")]], right[b[near]]
                    apart = np.bitwise_count(f[p] ^ f[q]).sum(1) <= SIMILAR
                    found.append(np.stack([p[apart], q[apart]]))
                i, lo, hi = i[k:], lo[k:], hi[k:]

        every = np.arange(len(own))
        compare(every, every.astype(np.int32) + 1 if cut == n else at[own], at[own + 1])
        for top in range(width):
            i = np.flatnonzero(own >> top & 1 == 0) if cut == n else every  # each pair of keys once
            for low in [0, *(1 << x for x in range(top))]:
                other = own[i] ^ np.int32(1 << top | low)
                compare(i, at[other], at[other + 1])
        join()
    return root


def _chained(x: np.ndarray) -> np.ndarray:
    """Rows of differences (pairs x words) in which some chain of three words on the ring keeps the proportional budgets."""
    c = np.bitwise_count(x).astype(np.int16)
    two = c + np.roll(c, -1, 1)
    ok = (c <= SIMILAR // _WIDE) & (two <= 2 * SIMILAR // _WIDE) & (two + np.roll(c, -2, 1) <= 3 * SIMILAR // _WIDE)
    return ok.any(1)


def _direct(f: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Index pairs within ``SIMILAR`` bits inside the groups of rows that end (exclusive) at ``end``; all pairs of small groups."""
    found, d, i = [], 1, np.arange(len(f))
    while len(i := i[i + d < end[i]]):
        for k in range(0, len(i), CANDIDATES >> 4):
            p = i[k : k + (CANDIDATES >> 4)]
            x = f[p] ^ f[p + d]
            near = np.flatnonzero(_chained(x))
            near = near[np.bitwise_count(x[near]).sum(1) <= SIMILAR]
            found.append(np.stack([p[near], p[near] + d]))
        d += 1
    return found


_MEETING = ("slot", "key", "i", "j")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows (slot, key, i, j, block, node, wide) that meet, as stars of what is joined; sorted by ``_MEETING``."""
    for t in _whole_groups(batches, _MEETING, 1 << 15):
        names = [t.column(n).to_numpy() for n in _MEETING]
        first = np.flatnonzero(np.r_[True, np.any([n[1:] != n[:-1] for n in names], axis=0)])
        size = np.diff(np.r_[first, t.num_rows])
        node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(-1, _WIDE)
        small = np.repeat((size > 1) & (size <= DIRECT), size)
        rows = np.flatnonzero(small)
        pairs = _direct(wide[rows], np.cumsum(size[(size > 1) & (size <= DIRECT)]).repeat(size[(size > 1) & (size <= DIRECT)]))
        root = graph.local_roots(len(rows), *np.concatenate(pairs, axis=1)) if pairs else np.arange(len(rows))
        star = np.flatnonzero(root != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(node[rows[star]]), pa.array(node[rows[root[star]]])], ["a", "b"])
        for a, n in zip(first[size > DIRECT], size[size > DIRECT]):
            own = a + np.argsort(block[a : a + n] != names[2][a], kind="stable")  # block i comes first
            cut = int((block[own] == names[2][a]).sum())
            root = _alike(wide[own], cut, list(range(len(_ARCS))))
            star = np.flatnonzero(root != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(node[own[star]]), pa.array(node[own[root[star]]])], ["a", "b"])
            kernel.trim()


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of similar texts: that of the least id (null ids last; ids are integers)."""
    row_col, wide_col, *key_cols = features.fresh(docs, "sim_row", "sim_wide", *(f"sim_key_{k}" for k in range(ROUTES)))

    def score(col: pa.Array) -> list[pa.Array]:
        got = [_wide(buf, offs, width) for _, _, buf, offs in kernel.texts(col)]
        f, r = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros((0, _WIDE), np.uint64), np.zeros((0, ROUTES), np.uint64))
        return [pa.array([x.tobytes() for x in f], pa.binary()), *(pa.array(r[:, k].copy().view(np.int64)) for k in range(ROUTES))]

    told = features.annotated(docs, score, ", ".join([f"{wide_col} binary", *(f"{c} long" for c in key_cols)]), text_col)
    told = scratch.written(told.withColumn(row_col, F.monotonically_increasing_id()), "similar-rows")
    place = F.struct(F.col(id_col).isNull().alias("null_id"), F.col(id_col).cast("long").alias("id"), F.col(row_col).alias("row")).alias("place")
    slim = told.select(F.col(wide_col).alias("wide"), place, F.array(*key_cols).alias("keys"))
    distinct = slim.groupBy("wide").agg(F.min("place").alias("first"), F.min("keys").alias("keys"))  # any of the equal ones' keys
    distinct = scratch.written(distinct.withColumn("node", F.monotonically_increasing_id()), "similar-distinct")
    meet = distinct.select("node", "wide", F.posexplode("keys").alias("slot", "key"))
    hot = meet.groupBy("slot", "key").count().where(F.col("count") > GROUP)
    hot = scratch.written(hot.select("slot", "key", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")), "similar-hot")
    meet = meet.join(hot, ["slot", "key"], "left") if hot.count() else meet.withColumn("blocks", F.lit(1))
    n = F.coalesce("blocks", F.lit(1))
    meet = meet.withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    meet = meet.select("slot", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "wide")
    parts = max(scratch.shuffle_partitions(docs.sparkSession), distinct.count() * ROUTES >> 19)
    links = meet.repartition(parts, *_MEETING).sortWithinPartitions(*_MEETING).mapInArrow(_similar, "a long, b long")
    links = scratch.written(links.distinct(), "similar-links")
    nodes = scratch.written(distinct.select("node", "first"), "similar-nodes")
    scratch.remove(distinct)  # the fingerprints are not needed any more
    keep = _grouped(links, nodes).select(F.col("component.row").alias(row_col)).distinct()
    return told.join(keep, row_col, "left_semi").select(*docs.columns)
