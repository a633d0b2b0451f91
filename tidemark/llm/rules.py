"""Quality rules: rule statistics of whole texts judged by an isolation forest.

Each tree of the forest splits a small random subset of rows at random values of
random statistics; rows that few splits isolate are anomalous.  The forest is
fitted on a bounded sample of rows; the threshold is calibrated on all labelled
rows from a histogram of their scores.  A document is kept if it passes the
fixed base rules and its score stays under the threshold.

Cases: null and empty texts have no word, so they fail the base rules; without
labelled rows of both kinds the threshold is the 0.5 of the method's definition
raised to the score that at most ``CLEAN_LOSS`` of all rows exceed.  Repeated rows get
equal verdicts and count each in the calibration; ids with both labels are left out of
it; of thresholds that part equally well the middle one is taken; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, kernel, scratch

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?=~^_{}[]\\@"]] = True

#: Rows that the forest is fitted on, trees, rows of a tree.
FIT_ROWS = 16_384
TREES = 120
ROWS_PER_TREE = 256
#: Most of the labelled good rows that calibration may give up.
CLEAN_LOSS = 0.005
BINS = 2000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_echo")


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rule statistics (documents x STATS) of one chunk of whole texts."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    if not len(buf):
        return out
    pre = kernel.prefix(buf)
    starts, ends, doc = kernel.words(buf, offs)
    out[:, 0] = kernel.counts(doc, n)
    point = (buf & 0xC0) != 0x80
    out[:, 1] = kernel.per_doc(point & ~kernel.SPACE[buf], offs)
    out[:, 2] = kernel.per_doc(SYMBOLS[buf], offs)
    salt = kernel.mix(np.arange(1, n + 1, dtype=np.uint64))
    # lines with a word that repeat an earlier line of their document
    cut = np.flatnonzero(buf == 10)
    cut_doc = np.searchsorted(offs, cut, "right") - 1
    line_start = np.r_[offs[:-1], cut + 1]
    line_doc = np.r_[np.arange(n), cut_doc]
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    last = np.r_[line_doc[1:] != line_doc[:-1], True]
    line_end = np.where(last, offs[line_doc + 1], np.r_[line_start[1:] - 1, 0])
    ink = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~kernel.SPACE[buf], out=ink[1:])
    full = ink[line_end] > ink[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    _, later = kernel.repeated(kernel.spans(pre, line_start, line_end) ^ salt[line_doc])
    out[:, 3] = kernel.counts(line_doc[later], n)
    # words covered by a 5-word window that occurs twice or more in the document
    if len(starts):
        h = kernel.spans(pre, starts, ends)
        if len(starts) >= 5:
            five = h[:-4].copy()
            for k in range(1, 5):
                five = kernel.mix(five * _U(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k])
            own = doc[:-4] == doc[4:]
            many, _ = kernel.repeated(five[own] ^ salt[doc[:-4][own]])
            at = np.flatnonzero(own)[many]
            edge = np.zeros(len(h) + 1, np.int64)
            edge[at] += 1
            edge[at + 5] -= 1
            out[:, 4] = kernel.counts(doc[np.cumsum(edge[:-1]) > 0], n)
        echo = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 8] = kernel.counts(doc[1:][echo], n)
    out[:, 5] = kernel.counts(line_doc, n)
    out[:, 6] = kernel.per_doc(_UPPER[buf], offs)
    out[:, 7] = kernel.per_doc(_MARKS[buf], offs)
    return out


def shape(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: ratios of the statistics that do not grow with the text's length."""
    s = stats.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.column_stack((chars / words, np.sqrt(s[:, 2] / chars), s[:, 3] / lines, s[:, 4] / words, np.sqrt(s[:, 6] / chars), np.sqrt(s[:, 7] / chars), np.sqrt(s[:, 8] / words)))


class Forest:
    """Isolation forest in flat arrays, one row of nodes a tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS_PER_TREE, seed: int = 11):
        rnd = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        size = 2 ** (self.depth + 1)
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 1, 0, x[rnd.choice(len(x), self.rows, replace=False)] if len(x) else x, rnd)

    @staticmethod
    def _left(n: float) -> float:
        """Mean further path of n rows that are not split any more."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rnd: np.random.Generator) -> None:
        wide = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
        if depth == self.depth or not len(wide):
            self.path[t, node] = depth + self._left(len(x))
            return
        f = int(rnd.choice(wide))
        cut = rnd.uniform(x[:, f].min(), x[:, f].max())
        self.feature[t, node], self.cut[t, node] = f, cut
        below = x[:, f] <= cut
        self._grow(t, 2 * node, depth + 1, x[below], rnd)
        self._grow(t, 2 * node + 1, depth + 1, x[~below], rnd)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 ** -(mean path length / its expectation)."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + (x[row, np.maximum(f, 0)] > cut[node]))
            total += path[node]
        return 2 ** (-total / len(self.path) / max(self._left(self.rows), 1e-9))


def threshold(counts: dict[tuple[int, int], int]) -> float:
    """From (bin, label) counts: the cut that parts the labels best and gives up at most CLEAN_LOSS of the good rows."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for (b, label), n in counts.items():
        (good if label else bad)[b] += n
    lost = np.cumsum(good[::-1])[::-1] / max(1, good.sum())
    caught = np.cumsum(bad[::-1])[::-1] / max(1, bad.sum())
    value = np.where(lost <= CLEAN_LOSS, caught - lost, -1)
    # of the cuts that part equally well, the one in the middle
    best = np.flatnonzero(value == value.max())
    return float(best[len(best) // 2]) / BINS


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, STATS..., base_failed, anomaly, kept) for every row."""

    def count(col: pa.Array) -> list[pa.Array]:
        s = features.by_chunk(col, statistics, len(STATS))
        return [pa.array(s[:, k]) for k in range(len(STATS))]

    stats = scratch.written(features.score_rows(docs, count, ", ".join(f"{s} long" for s in STATS), id_col, text_col), "rule-stats")
    some = stats.where(features.hashed(FIT_ROWS, stats.count(), "id", *STATS))
    fit = some.orderBy(F.xxhash64("id", *STATS), "id", *STATS).limit(FIT_ROWS).select(*STATS).toPandas().to_numpy(np.int64)
    forest = Forest(shape(fit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.column_stack([b.column(k + 1).to_numpy() for k in range(len(STATS))]) if b.num_rows else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(shape(s)), pa.float64())], [*b.schema.names, "anomaly"])

    fields = f"id long, {', '.join(f'{s} long' for s in STATS)}"
    scored = stats.mapInArrow(score, f"{fields}, anomaly double")
    bin_ = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS)).cast("int").alias("bin")
    cut = None
    if labels is not None:
        marked = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
        marked = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
        labelled = stats.join(marked, "id").select("id", *STATS, "label").mapInArrow(score, f"{fields}, label int, anomaly double")
        found = {(r.bin, r.label): r["count"] for r in labelled.groupBy(bin_, "label").count().collect()}
        if {k[1] for k in found} >= {0, 1}:
            cut = threshold(found)
    if cut is None:
        found = {(r.bin, 1): r["count"] for r in scored.groupBy(bin_).count().collect()}
        cut = max(0.5, threshold(found))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < F.lit(cut)))
