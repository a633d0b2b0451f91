"""Language identification by error-correcting output codes.

Each language has a codeword; one logistic classifier over hashed byte n-grams
predicts each bit.  Decoding weighs every bit by its logistic loss under each
codeword and takes the codeword with the least total; the share of the softmax
of negative losses is the score.  A decision whose score is below
``AMBIGUOUS`` is flagged.

Cases: null texts and texts without a letter are ``und`` with score 0; with no
labelled row at all every other text is ``und`` too; ties go to the language
first in name order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, kernel

#: Most labelled documents a language gives to training; with more than ``FULL_LANGUAGES`` languages each gives less.
PER_LANGUAGE = 800
FULL_LANGUAGES = 16
DIMS = 4096
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.4

_LETTERS = kernel.LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1 bits: every split of up to five classes, otherwise the random code of the widest rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if c == 0 or k >> (c - 1) & 1 else -1 for c in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    rnd = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rnd.choice([-1.0, 1.0], (n, width))
        m = m[:, np.abs(m.sum(0)) < n]  # a bit that is alike for all says nothing
        d = (m.shape[1] - m @ m.T) / 2 + np.eye(n, dtype=int) * width  # bits in which two words differ
        if d.min() > far:
            best, far = m, d.min()
    return best


def _profile(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return features.unit(np.sqrt(features.grams(_LETTERS[buf], offs, ORDERS, DIMS)))


class Model:
    """Languages, their codewords and the bit classifiers."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        which = np.searchsorted(np.array(names, object), label) if len(names) else np.zeros(0, int)
        share = np.bincount(which, minlength=len(names))
        self.w, self.b = features.logistic(x, (self.code[which] + 1) / 2, l2=1e-5, steps=200, weight=1 / np.maximum(share[which], 1)) if len(names) > 1 else (np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32))
        self.scale = 1.0
        if len(names) > 1:  # sharpness of the scores that fits the training rows best
            loss = self.losses(x)
            fits = []
            for s in (0.25, 0.5, 1, 2, 4, 8):
                z = -s * (loss - loss.min(1, keepdims=True))
                fits.append((np.mean(z[np.arange(len(x)), which] - np.log(np.exp(z).sum(1))), s))
            self.scale = max(fits)[1]

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.w + self.b
        if len(self.names) <= FULL_LANGUAGES:
            return np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        # the same sums as two products: documents x languages x bits would not fit
        plus = (self.code.T > 0).astype(float)
        return np.logaddexp(0, -margin) @ plus + np.logaddexp(0, margin) @ (1 - plus)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss = self.losses(x)
        z = np.exp(-self.scale * (loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), z.max(1) / z.sum(1)


def train(docs: DataFrame, learn: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` documents of every language among rows where ``learn`` holds.

    Above ``FULL_LANGUAGES`` languages the sample keeps its size and is shared evenly; each language gives one document at least.
    """
    rows = docs.where(F.expr(learn)) if learn else docs
    rows = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"))
    sample = features.per_label(rows, "i", "l", lambda n: per_language if n <= FULL_LANGUAGES else max(1, per_language * FULL_LANGUAGES // n))

    def extract(col: pa.Array) -> list:
        return [r for _, _, buf, offs in kernel.texts(col) for r in features.sparse(_profile(buf, offs))]

    def fit(label: list, rows: list) -> Model:
        return Model(sorted(set(label)), features.dense(rows, DIMS), np.array(label, object))

    return features.fitted(docs, sample, extract, fit, id_col, text_col)


FIELDS = "lang_pred string, score double, ambiguous boolean"


def _scorer(model: Model):
    def score(col: pa.Array) -> list[pa.Array]:
        some = np.array([t is not None and any(map(str.isalpha, t)) for t in col.to_pylist()], bool)
        names, p = np.full(len(col), "und", object), np.zeros(len(col))
        if model.names and len(col):
            k, q = (np.concatenate(v) for v in zip(*(model.decide(_profile(buf, offs)) for _, _, buf, offs in kernel.texts(col))))
            names[some] = np.array(model.names, object)[k[some]]
            p[some] = q[some]
        return [pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(p < AMBIGUOUS)]

    return score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row."""
    return features.score_rows(docs, _scorer(model), FIELDS, id_col, text_col)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` that has a language: all columns, whatever their names, neither ``und`` nor ambiguous."""
    lang, score, ambiguous = features.fresh(docs, "own_lang_pred", "own_score", "own_ambiguous")
    told = features.annotated(docs, _scorer(model), f"{lang} string, {score} double, {ambiguous} boolean", text_col)
    return told.where((F.col(lang) != "und") & ~F.col(ambiguous)).select(*docs.columns)
