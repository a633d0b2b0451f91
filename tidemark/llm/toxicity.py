"""Toxicity by weak supervision.

1. Mining: from a bounded labelled sample, terms (whole words and word beginnings)
   that mark toxic texts are mined; a greedy cover turns them into voters: lexicon
   voters (a word) and pattern voters (a word beginning), which vote toxic or abstain.
2. Label model: over the votes on a bounded sample of all documents, labelled or not,
   whose labels are not read, a generative model (one latent label, its toxic class made
   of kinds) estimates by expectation maximisation how often each voter fires on each
   kind.  Correlations enter twice: voters that go together in the toxic class form its
   kinds, and voters that repeat each other within the kinds are merged.  The mining
   sample's rates are a weak prior (``PRIOR_ROWS`` rows), no label of a row.
3. A linear classifier on the presence of the mined terms is trained on the
   posteriors of those documents.  It scores every whole text.

Cases: null and empty texts get the score of a text without any mined term; with no
toxic row to learn from every score is 0; repeated rows get equal scores; ids with
both labels teach nothing; very long texts are read whole, as one chunk.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, graph, kernel

#: Most labelled documents of each label that mining reads, and most documents that the label model reads.
TOXIC_ROWS, CLEAN_ROWS, UNLABELLED = 1000, 1500, 12_000
#: Size of the model: most voters, and most mined terms of the classifier (the strongest are taken).
VOTERS, TERMS = 400, 3000
#: How often the voters cover a toxic document, and what a clean document counts against a voter.
COVER, STRICT = 4, 10
#: Weight of the mining sample's rates in the label model, as rows of each class.
PRIOR_ROWS = 80
#: Voters correlated above this within a kind of toxic rows count as one; those above it in the toxic class form a kind.
CORRELATED, TOGETHER = 0.5, 0.3
BEGINNINGS = (4, 5, 6, 7, 8, 10)
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the whole lower-cased words of letters and of their beginnings; whole words have bit 0 set."""
    low = kernel.LOWER[buf]
    starts, ends, doc = features.runs(low, offs, _LETTER[low])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pre = kernel.prefix(low)
    hashes, docs = [kernel.spans(pre, starts, ends) | _U(1)], [doc]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= k)
        hashes.append(kernel.spans(pre, starts[long], starts[long] + k) & ~_U(1))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term)."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], term[new]


class LabelModel:
    """Posterior of a binary latent label from voters that fire or abstain; no row's own label is used.

    The label has one class of clean rows and one or more kinds of toxic rows (languages, topics), each with firing rates
    of its own: that is how voters correlate over the whole toxic class.  ``rates`` (voters x kinds, clean first) are prior
    rates, ``share`` prior shares of the kinds, ``counts`` how many rows have the votes of each row given.  Voters that are
    still correlated within the kinds repeat each other: they are merged into one that fires when any of them does.
    """

    def __init__(self, votes: np.ndarray, rates: np.ndarray, share: np.ndarray, counts: np.ndarray | None = None, strength: float = PRIOR_ROWS):
        self.group, self.n = np.arange(votes.shape[1]), np.ones(len(votes)) if counts is None else counts.astype(float)
        self.on, self.share = np.clip(rates, 1e-4, 1 - 1e-4), share / share.sum()
        q = self._expect(votes.astype(float), 10, strength)
        self.group = self._groups(votes.astype(float), q)
        names, at = np.unique(self.group, return_inverse=True)
        merged = np.stack([self.on[at == k].max(0) for k in range(len(names))])
        self.on = merged
        self._expect(self._merged(votes), 100, strength)
        self.fitted = self.posterior(votes)

    def _merged(self, votes: np.ndarray) -> np.ndarray:
        return np.column_stack([votes[:, self.group == g].any(1) for g in np.unique(self.group)]).astype(float)

    def _kinds(self, v: np.ndarray) -> np.ndarray:
        """Posterior of each kind."""
        z = np.log(self.share) + v @ np.log(self.on / (1 - self.on)) + np.log(1 - self.on).sum(0)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _expect(self, v: np.ndarray, rounds: int, strength: float) -> np.ndarray:
        prior, share, q = self.on, self.share, self._kinds(v)
        for _ in range(rounds):
            w = q * self.n[:, None]
            self.share = np.clip((w.sum(0) + strength * share) / (self.n.sum() + strength), 1e-6, None)
            self.on = np.clip((v.T @ w + strength * prior) / (w.sum(0) + strength), 1e-4, 1 - 1e-4)
            before, q = q, self._kinds(v)
            if np.abs(q - before).max() < 1e-6:
                break
        return q

    def _groups(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Groups of voters: those chained by a correlation above ``CORRELATED`` within the kinds share one."""
        c, d = np.zeros((v.shape[1],) * 2), np.zeros(v.shape[1])
        for w in (q * self.n[:, None]).T:
            rest = v - (w @ v) / max(w.sum(), 1e-9)
            c += (rest * w[:, None]).T @ rest
            d += w @ rest**2
        d = np.sqrt(np.maximum(d, 1e-9))
        i, j = np.nonzero(np.triu(c / d / d[:, None] > CORRELATED, 1))
        return graph.local_roots(len(d), i, j)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 - self._kinds(self._merged(votes))[:, 0]


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio statistic of presence in a of n1 toxic and b of n0 clean documents."""
    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-9) / n / p) + (n - k) * np.log(np.maximum(n - k, 1e-9) / n / (1 - p))

    p = np.clip((a + b) / (n1 + n0), 1e-9, 1 - 1e-9)
    return 2 * (part(a, n1, p) + part(b, n0, p))


class Voters:
    """Mined terms, which of them vote, and the firing rates of the voters in the mining sample."""

    def __init__(self, lists: list[np.ndarray], label: np.ndarray):
        n1, n0 = int(label.sum()), int((1 - label).sum())
        self.terms, self.voters, self.rates, self.share = np.zeros(0, np.uint64), np.zeros(0, int), np.zeros((0, 1)), np.ones(1)
        if not n1:
            return
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        a, b = np.bincount(at, label[doc], len(names)), np.bincount(at, 1 - label[doc], len(names))
        g2 = _g2(a, b, n1, max(1, n0))
        marks = np.flatnonzero((a >= 3) & (a / n1 > 4 * b / max(1, n0)) & (g2 > 12))
        marks = np.sort(marks[np.argsort(-g2[marks], kind="stable")][:TERMS])
        if not len(marks):
            return
        self.terms = names[marks]
        place = np.full(len(names), -1)
        place[marks] = np.arange(len(marks))
        has = np.zeros((len(lists), len(marks)), bool)
        on = place[at] >= 0
        has[doc[on], place[at[on]]] = True
        self.voters = self._cover(has, label)
        votes = self.votes(has)
        # kinds of toxic rows: voters that go together in them; half a row of each kind is added, so that no voter is taken for sure
        toxic = votes[label > 0].astype(float)
        kind = graph.local_roots(toxic.shape[1], *np.nonzero(np.triu(np.nan_to_num(np.corrcoef(toxic.T)).reshape((toxic.shape[1],) * 2) > TOGETHER, 1)))
        members = [toxic[:, kind == k].any(1) for k in np.unique(kind)]
        sets = [votes[label == 0].astype(float), *(toxic[m] for m in members)]
        self.rates = np.column_stack([(x.sum(0) + 0.5) / (len(x) + 1) for x in sets])
        odds = n1 / max(1, n1 + n0)
        self.share = np.array([1 - odds, *(odds * m.sum() / max(1, sum(x.sum() for x in members)) for m in members)])

    def votes(self, has: np.ndarray) -> np.ndarray:
        return has[:, self.voters] > 0

    def found(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, term number) of the mined terms among the hashes."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << 18, bool)
            self._sieve[(self.terms >> _U(40)).astype(np.int64) & 0x3FFFF] = True
        may = np.flatnonzero(self._sieve[(h >> _U(40)).astype(np.int64) & 0x3FFFF])
        at = np.minimum(np.searchsorted(self.terms, h[may]), len(self.terms) - 1)
        hit = self.terms[at] == h[may]
        return _pairs(doc[may][hit], at[hit])

    @staticmethod
    def _cover(has: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Greedy cover: the term that marks most toxic documents marked fewer than COVER times, less the clean ones it marks."""
        open_, cost = has[label > 0], has[label == 0].sum(0) * (STRICT * label.sum() / max(1, (label == 0).sum()))
        gain, times, out = open_.sum(0).astype(float), np.zeros(len(open_), int), []
        while len(out) < VOTERS:
            k = int(np.argmax(gain - cost))
            if gain[k] - cost[k] < 1:
                break
            out.append(k)
            times += open_[:, k]
            gain -= open_[open_[:, k] & (times == COVER)].sum(0)
            cost[k] = np.inf
        return np.array(out or [0])


class Model:
    """The voters' terms with the classifier's weights; ``lists`` has the term numbers of the unlabelled documents."""

    def __init__(self, voters: Voters, lists: list[np.ndarray]):
        self.voters, self.weights, self.bias = voters, np.zeros(len(voters.terms)), -30.0
        if not len(voters.terms):
            return
        same = Counter(x.tobytes() for x in lists)  # most documents have none or few of the terms: equal ones count once
        rows, counts = [np.frombuffer(k, "<u2") for k in same], np.array(list(same.values()), float)
        has = np.zeros((len(rows), len(voters.terms)), np.float32)
        for i, r in enumerate(rows):
            has[i, r] = 1
        self.label_model = LabelModel(voters.votes(has), voters.rates, voters.share, counts)
        w, b = features.logistic(has, self.label_model.fitted, l2=1e-5, steps=600, weight=counts)
        self.weights, self.bias = w[:, 0].astype(float), float(b[0])

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.full(len(offs) - 1, self.bias)
        d, t = self.voters.found(*term_hashes(buf, offs))
        z += np.bincount(d, self.weights[t], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn: str | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, unlabelled: int = UNLABELLED) -> Model:
    """Mine on a bounded sample of the label rows where ``learn`` holds, then fit on a bounded sample of documents with such ids."""
    rows = labels.where(F.expr(learn)) if learn else labels
    sample = features.per_label(rows.select(F.col(label_id).alias("i"), F.col(label_col).cast("int").alias("l")), "i", "l", {1: toxic_rows, 0: clean_rows})

    def extract(col: pa.Array) -> list:
        out = []
        for _, _, buf, offs in kernel.texts(col):
            h, doc = term_hashes(buf, offs)
            doc, h = _pairs(doc, h)
            cut = np.searchsorted(doc, np.arange(len(offs)))
            out += [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return out

    def mine(label: list, found: list) -> Voters:
        return Voters([np.frombuffer(x, np.uint64) for x in found], np.array(label, float))

    voters = features.fitted(docs, sample, extract, mine, id_col, text_col)
    if not len(voters.terms):
        return Model(voters, [])
    ids = docs.select(F.col(id_col).alias(label_id)).where(F.expr(learn) if learn else F.lit(True)).select(F.col(label_id).alias("i"), F.lit(0).alias("l"))
    others = features.per_label(ids, "i", "l", {0: unlabelled})

    def present(col: pa.Array) -> list:
        out = []
        for _, _, buf, offs in kernel.texts(col):
            d, t = voters.found(*term_hashes(buf, offs))
            cut = np.searchsorted(d, np.arange(len(offs)))
            out += [t[a:b].astype("<u2").tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return out

    return features.fitted(docs, others, present, lambda label, found: Model(voters, [np.frombuffer(x, "<u2") for x in found]), id_col, text_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array) -> list[pa.Array]:
        return [pa.array(features.by_chunk(col, lambda buf, offs: shared.value.score(buf, offs)), pa.float64())]

    return features.score_rows(docs, run, "score double", id_col, text_col)
