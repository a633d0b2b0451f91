"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are hashed character-shape n-grams and repetition counts.  A bounded
labelled sample gives the term weights, the latent axes (truncated SVD) and the
labelled vectors, which are broadcast.  Every document's exact cosines with all
of them are computed in blocks, and the nearest ones vote with their similarity.

Cases: null and empty texts have the zero vector and take the share of label 1
among the labelled rows of empty text, else 0; with no labelled row every score
is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, kernel

#: Most labelled documents of each label.
PER_LABEL = 2500
LATENT = 48
NEIGHBOURS = 15
#: Exponent of the similarity's weight: near neighbours count more.
SHARPNESS = 8
SHAPE_DIMS = 4096
EXTRA = 6

_CLASS = np.full(256, 2, np.uint16)  # letters, all bytes outside ASCII
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch == "\n" else 0 if _c <= 32 else 3 if _ch.isupper() else 2 if _ch.islower() else 4 if _ch.isdigit() else 5 if _ch in ".,;:'\"-()" else 6 if _ch in "#$%&*|<>" else 7


def terms(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Term counts: shapes of four characters, then counts of words that echo the word before or an earlier five-word window."""
    n = len(offs) - 1
    shape = np.zeros((n, SHAPE_DIMS), np.float32)
    extra = np.zeros((n, EXTRA), np.float32)
    if len(buf) >= 4:
        c = _CLASS[buf]
        code = ((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:]
        doc = np.repeat(np.arange(n), np.diff(offs))
        own = doc[:-3] == doc[3:]
        shape = np.bincount((doc[:-3] * SHAPE_DIMS + code)[own], minlength=n * SHAPE_DIMS).reshape(n, SHAPE_DIMS).astype(np.float32)
    starts, ends, doc = kernel.words(buf, offs)
    if len(starts):
        h = kernel.spans(kernel.prefix(buf), starts, ends)
        salt = kernel.mix(np.arange(1, n + 1, dtype=np.uint64))
        words = np.maximum(kernel.counts(doc, n), 1)
        echo = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        extra[:, 0] = kernel.counts(doc[1:][echo], n)
        if len(h) >= 5:
            own = np.flatnonzero(doc[:-4] == doc[4:])
            five = h[own].copy()
            for k in range(1, 5):
                five = kernel.mix(five * np.uint64(0x9E3779B97F4A7C15) + h[own + k])
            _, later = kernel.repeated(five ^ salt[doc[own]])
            extra[:, 1] = kernel.counts(doc[own][later], n)
        extra[:, 2:] = (np.array([8, 32, 128, 512]) > words[:, None]) * 1.0
    return np.concatenate([shape, extra], 1)


class Model:
    """Term weights, latent axes and the labelled vectors with their labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, latent: int = LATENT):
        self.label = label.astype(np.float32)
        self.empty = float(self.label[x.sum(1) == 0].mean()) if (x.sum(1) == 0).any() else 0.0
        df = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.1
        self.axes = np.zeros((x.shape[1], 0), np.float32)
        if len(x):
            t = self._weigh(x)
            rnd = np.random.default_rng(5)
            q = rnd.standard_normal((x.shape[1], min(latent + 8, *x.shape))).astype(np.float32)
            for _ in range(4):
                q, _ = np.linalg.qr(t.T @ (t @ q))
            _, _, vt = np.linalg.svd(t @ q, full_matrices=False)
            self.axes = (q @ vt.T)[:, :latent].astype(np.float32)
        self.vectors = features.unit(self._weigh(x) @ self.axes)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return features.unit(np.log1p(x) * self.idf)

    def score(self, x: np.ndarray, skip_self: bool = False) -> np.ndarray:
        if not len(self.label):
            return np.full(len(x), 0.5)
        out = np.zeros(len(x))
        k = min(NEIGHBOURS + skip_self, len(self.label))
        for a in range(0, len(x), 512):
            cosine = features.unit(self._weigh(x[a : a + 512]) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** SHARPNESS
            out[a : a + 512] = (w * self.label[near]).sum(1) / w.sum(1)
        return np.where(x.sum(1) == 0, self.empty, np.clip(out, 0, 1))


def train(docs: DataFrame, labels: DataFrame, learn: str | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Fit on at most ``per_label`` documents of each label among label rows where ``learn`` holds."""
    rows = labels.where(F.expr(learn)) if learn else labels
    sample = features.per_label(rows.select(F.col(label_id).alias("i"), F.col(label_col).cast("int").alias("l")), "i", "l", {0: per_label, 1: per_label})

    def extract(col: pa.Array) -> list:
        return [r for _, _, buf, offs in kernel.texts(col) for r in features.sparse(terms(buf, offs))]

    def fit(label: list, rows: list) -> Model:
        return Model(features.dense(rows, SHAPE_DIMS + EXTRA), np.array(label, np.float32))

    return features.fitted(docs, sample, extract, fit, id_col, text_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array) -> list[pa.Array]:
        return [pa.array(features.by_chunk(col, lambda buf, offs: shared.value.score(terms(buf, offs))), pa.float64())]

    return features.score_rows(docs, run, "score double", id_col, text_col)
