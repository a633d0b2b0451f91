"""Document features, bounded training samples and the linear trainer of the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel

_U = np.uint64


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def hashed(n: int, of: int, *keys: str) -> Column:
    """Keeps about 4 ``n`` of ``of`` rows by hash (all, if there are no more), so that a limit of ``n`` moves few rows."""
    return F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(1 << 30)) < F.lit(min(1 << 30, (n << 32) // max(1, of)))


def per_label(rows: DataFrame, id_col: str, label_col: str, bounds: dict | Callable[[int], int]) -> DataFrame:
    """At most ``bounds[c]`` ids of each label c, chosen by hash of the id: a bounded table (sample_id, sample_label).

    ``bounds`` may also be a function of the number of labels that gives the bound of each.
    Rows without id or label say nothing, and ids whose labels differ are left out.  All
    labels are handled in one pass, however many there are.
    """
    slim = rows.select(F.col(id_col).alias("sample_id"), F.col(label_col).alias("sample_label")).where("sample_id is not null and sample_label is not null")
    slim = slim.groupBy("sample_id").agg(F.min("sample_label").alias("sample_label"), F.max("sample_label").alias("other")).where("sample_label = other").drop("other")
    sizes = {r[0]: r[1] for r in slim.groupBy("sample_label").count().collect()}
    if callable(bounds):
        bounds = dict.fromkeys(sizes, bounds(len(sizes)))
    # about four times the bound passes by hash (with a floor, so that small bounds leave no label empty); the window picks among those
    share = [(c, n, min(1 << 30, (max(n, 16) << 32) // max(1, sizes[c]))) for c, n in bounds.items() if c in sizes]
    if not share:
        return slim.limit(0)
    kind = dict(slim.dtypes)["sample_label"]
    table = rows.sparkSession.createDataFrame(share, f"sample_label {kind}, bound long, share long")
    # the bounds, one row a label as collected above, go to the rows: those that the hash leaves out never travel by their label
    some = slim.join(F.broadcast(table), "sample_label").where(F.pmod(F.xxhash64(F.lit(5), "sample_id"), F.lit(1 << 30)) < F.col("share"))
    turn = Window.partitionBy("sample_label").orderBy(F.xxhash64("sample_id"), "sample_id")
    return some.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= F.col("bound")).select("sample_id", "sample_label")


def fitted(docs: DataFrame, sample: DataFrame, extract: Callable[[pa.Array], list], fit: Callable[[list, list], object], id_col: str = "doc_id", text_col: str = "text") -> object:
    """``fit(labels, features)`` over the documents of ``sample``, in order of id; runs in one task, so only the model reaches the driver.

    ``sample`` (sample_id, sample_label) is bounded.  Of an id's texts the one with the least feature is learned.
    """
    slim = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"))
    kind = dict(sample.dtypes)["sample_label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(extract(b.column(2)), pa.binary())], ["sample_id", "label", "feature"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, found = [], []
        for b in batches:
            labels += b.column(1).to_pylist()
            found += b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(labels, found))], pa.binary())], ["model"])

    joined = slim.join(F.broadcast(sample), "sample_id").select("sample_id", "sample_label", "text")
    rows = joined.mapInArrow(run, f"sample_id {dict(slim.dtypes)['sample_id']}, label {kind}, feature binary")
    rows = rows.groupBy("sample_id").agg(F.min("label").alias("label"), F.min("feature").alias("feature"))
    got = rows.repartition(1).sortWithinPartitions("sample_id").mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0][0]) if got else fit([], [])


def sparse(x: np.ndarray) -> list[bytes]:
    """Each row's non-zero places (16 bits) and values (float32)."""
    out = []
    for r in x:
        at = np.flatnonzero(r)
        out.append(at.astype("<u2").tobytes() + r[at].astype("<f4").tobytes())
    return out


def dense(rows: list[bytes], dims: int) -> np.ndarray:
    """The matrix whose rows ``sparse`` wrote."""
    x = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        n = len(r) // 6
        x[i, np.frombuffer(r, "<u2", n)] = np.frombuffer(r, "<f4", n, 2 * n)
    return x


def grams(buf: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts (documents x dims) of hashed byte n-grams; none crosses a document."""
    n_docs = len(offs) - 1
    out = np.zeros(n_docs * dims, np.float32)
    if not len(buf):
        return out.reshape(n_docs, dims)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64) * dims, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))  # bytes up to the document's end
    h = np.zeros(len(buf), np.uint32)
    wide = buf.astype(np.uint32)
    total = np.zeros(n_docs * dims, np.int64)
    for n in range(1, max(orders) + 1):
        h = h[: len(buf) - n + 1] * np.uint32(0x01000193) ^ (wide[n - 1 :] + np.uint32(n))
        if n in orders:
            m = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (dims - 1).bit_length())
            ok = left[: len(m)] >= n
            total += np.bincount((doc[: len(m)] + m)[ok], minlength=n_docs * dims)
    return total.astype(np.float32).reshape(n_docs, dims)


def runs(buf: np.ndarray, offs: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes with ``ink`` set."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    a, z = ink.copy(), ink.copy()
    a[1:] &= ~ink[:-1] | first[1:n]
    z[:-1] &= ~ink[1:] | first[1:n]
    starts, ends = np.flatnonzero(a), np.flatnonzero(z) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x targets) and biases of independent logistic regressions on soft targets in [0, 1].

    Full-batch Nesterov descent with the step that the data's norm allows; deterministic.
    """
    x = x.astype(np.float32, copy=False)
    y = (y if y.ndim == 2 else y[:, None]).astype(np.float32)
    n = max(1, len(x))
    s = np.ones(n, np.float32) if weight is None else (weight * (n / weight.sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32) / np.sqrt(max(1, x.shape[1]))
    for _ in range(12):  # largest curvature by power iteration
        v = x.T @ (s * (x @ v)) / n
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (0.25 * (top + 1) + l2)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    pw, pb = w, b
    for t in range(steps):
        k = t / (t + 3)
        aw, ab = w + k * (w - pw), b + k * (b - pb)
        g = s[:, None] * (1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30))) - y) / n
        pw, pb = w, b
        w, b = aw - rate * (x.T @ g + l2 * aw), ab - rate * g.sum(0)
    return w, b


def score_rows(docs: DataFrame, score: Callable[[pa.Array], list[pa.Array]], fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the columns ``fields`` that ``score`` computes from each batch of whole texts."""
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *score(b.column(1))], ["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, {fields}")


def annotated(docs: DataFrame, score: Callable[[pa.Array], list[pa.Array]], fields: str, text_col: str = "text") -> DataFrame:
    """Every row with all its columns and those that ``score`` computes; their names must be free (see ``fresh``)."""
    names = [f.split()[0] for f in fields.split(",")]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *score(b.column(at))], [*b.schema.names, *names])

    schema = T.StructType(list(docs.schema))
    for f in fields.split(","):
        name, kind = f.split()
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of ``df`` has it (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def by_chunk(col: pa.Array, f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int = 0) -> np.ndarray:
    """``f(bytes, offsets)`` of each chunk of the batch, stacked."""
    got = [f(buf, offs) for _, _, buf, offs in kernel.texts(col)]
    return np.concatenate(got) if got else np.zeros((0, width) if width else 0, np.float32)
