"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt into
partitions; each is packed by best-fit decreasing, and dual-feasible functions
(Fekete and Schepers' families u, U and phi) give a lower bound on its bins.  Full bins
are final.  Partitions with more bins than their bound have a gap: the documents of
their open bins are exchanged, that is dealt anew among fewer partitions and packed
again, until none has a gap or an exchange saves no bin (then the packing before it is
kept).  While the bins of all partitions still exceed the bound of the whole table, the
open bins of the certified partitions (about one each) are exchanged in the same way.

Cases: null and empty texts are one piece of the end id alone; repeated rows, also
with one id, are packed each for itself; an empty table gives an empty result; pieces
as long as a sequence fill one each; a very long text is encoded whole, then cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, scratch
from .tokens import Encoder

CAPACITY = 2048
END_ID = 0
#: About so many sequences, and so many pieces, a partition; bounds what one task packs.
BINS_PER_PARTITION = 4096
PIECES_PER_PARTITION = 1 << 17
_encoders: dict = {}


def _encoder(path: str | None, added: bool) -> Encoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path=path, added=added)
    return _encoders[path, added]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep_ids: bool = False, added: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents cut into pieces; only the first may be shorter than ``capacity``.

    ``added``: the added token of the tokenizer file is found in the texts (see ``tokens``).
    """
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, added)
        for b in batches:
            names = b.column(0)
            for first, last, buf, offs in kernel.texts(b.column(1)):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(enc.encode(buf, offs)):
                    ids = np.array([*ids, END_ID], "<u4")
                    head = len(ids) % capacity
                    cuts = [*([0] if head else []), *range(head, len(ids), capacity), len(ids)]
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        row.append(first + k)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(ids[x:y]))
                        if keep_ids:
                            kept.append(ids[x:y].astype(np.int32))
                cols = [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin.

    Bins are stacked by the room they have; a bit mask of the rooms in use finds the tightest that fits.
    """
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offset, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts`` items of each size uses fewer bins: the best dual-feasible function of three families."""
    x, n = sizes.astype(np.int64), counts.astype(float)
    if not len(x):
        return 0
    best = float((x * n).sum() / capacity)
    for k in range(1, 65):
        y = (k + 1) * x
        best = max(best, float((np.where(y % capacity == 0, x / capacity, (y // capacity) / k) * n).sum()))
    for eps in np.unique(np.r_[x[x <= capacity // 2], capacity - x[x > capacity // 2] + 1]):
        if 0 < eps <= capacity // 2:
            big = np.where(x > capacity - eps, capacity, np.where(x >= eps, x, 0)) / capacity
            parts = capacity // int(eps)
            phi = np.where(2 * x > capacity, 1 - ((capacity - x) // eps) / parts, np.where(x >= eps, 1 / parts, 0.0))
            best = max(best, float((big * n).sum()), float((phi * n).sum()))
    return int(np.ceil(best - 1e-6))


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offset, fill = best_fit_decreasing(pdf.length.to_numpy(), capacity)
        size, n = np.unique(pdf.length.to_numpy(), return_counts=True)
        return pdf.assign(bin=bins, offset=offset, room=capacity - fill[bins], part_bins=np.int64(len(fill)), part_bound=np.int64(lower_bound(size, n, capacity)))

    return run


_ITEM = "id long, piece int, start long, length long, ids_crc32 long, part long"


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound) for every piece of ``cut`` (see ``pieces``).

    ``part_bins`` and ``part_bound`` certify the packing that a piece comes from: the bins of its partition and their lower bound.
    """
    cut = scratch.written(cut.select("id", "piece", "start", "length", "ids_crc32"), "pieces")
    one = F.lit(1).cast("long")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done = full.withColumns({"part_bins": one, "part_bound": one})
    items = cut.where(F.col("length") < capacity)
    histogram = items.groupBy("length").count().toPandas()  # at most capacity - 1 rows
    bound = lower_bound(histogram.length.to_numpy(), histogram["count"].to_numpy(), capacity)
    out = [*cut.columns, "sequence_id", "offset", "part_bins", "part_bound"]
    gap, room = F.expr("part_bins > part_bound and room > 0"), F.col("room") > 0
    first = F.col("offset") == 0

    def packed(rows: DataFrame, r: int) -> tuple[DataFrame, int]:
        """One packing of ``rows`` and its number of partitions; names of sequences hold ``r``."""
        n, tokens = rows.agg(F.count("*"), F.sum("length")).first()
        parts = max(1, -(-(tokens or 0) // (capacity * BINS_PER_PARTITION)), -(-n // PIECES_PER_PARTITION))
        # dealt by place in a written table: the same for every attempt of a task, and even for rows that are alike
        dealt = rows.select(*cut.columns, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(r)), F.lit(parts)).alias("part"))
        found = dealt.groupBy("part").applyInPandas(_pack(capacity), f"{_ITEM}, bin long, offset long, room long, part_bins long, part_bound long")
        return scratch.written(found.withColumn("sequence_id", (F.lit(r) * F.lit(2**52) + F.col("part") * F.lit(2**22) + F.col("bin")) * 2 + 1), "packed"), parts

    def bins(rows: DataFrame, which: Column) -> int:
        return rows.where(first & which).count()

    now, parts = packed(items, 0)
    total, r = bins(now, F.lit(True)), 0
    if parts == 1 or total <= bound:
        return done.unionByName(now.select(*out))
    waiting = now.limit(0)
    while True:  # partitions with a gap
        done = done.unionByName(now.where(~room).select(*out))
        waiting, pool = waiting.unionByName(now.where(room & ~gap)), now.where(gap)
        n = bins(pool, F.lit(True))
        if n == 0 or parts == 1 or total <= bound:
            break
        r += 1
        new, parts = packed(pool, r)
        saved = n - bins(new, F.lit(True))
        if saved <= 0:
            break
        now, total = new, total - saved
    waiting = scratch.written(waiting.unionByName(pool), "waiting")
    n = bins(waiting, F.lit(True))
    while n and total > bound:  # what is left over in all partitions
        r += 1
        now, parts = packed(waiting, r)
        saved = n - bins(now, F.lit(True))
        if saved <= 0:
            break
        done, waiting, total = done.unionByName(now.where(~room).select(*out)), now.where(room), total - saved
        n = bins(waiting, F.lit(True))
        if parts == 1:
            break
    return done.unionByName(waiting.select(*out))
