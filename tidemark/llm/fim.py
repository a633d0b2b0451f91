"""Fill-in-middle transformation: texts cut at two places and put together as prefix, suffix and middle.

A text is decoded to an array of UTF-32 code points.  Each code point has a class;
neighbours of different class bound two units (``flatnonzero`` of the comparison), and
the two cuts are boundaries chosen by rank.  The pieces are slices of the array, encoded
again.  Units are code points (classes alternate, so that every neighbour differs), words
with the space that follows them, or lines.

The ranks and the form of each document come from a hash of its id, so that a run again
gives the same rows wherever they lie.

Cases: null texts count as empty; empty texts and texts that contain a marker stay plain;
bytes that are not UTF-8 come back as they were; a null id hashes as the empty text; rows
that repeat an id are cut by the same numbers; texts are taken whole (a task holds some ten
times the longest one); further columns are not read, and the result has only its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: documents that are transformed, and of those the ones that begin with the suffix.
SHARE, SUFFIX_FIRST, SEED = 90, 20, 1
_SPACE = np.array([0x20, 9, 10, 11, 12, 13], np.uint32)


def decoded(text: bytes) -> np.ndarray:
    """Code points of a text; bytes that are not UTF-8 become lone surrogates, which ``encoded`` turns back."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit ends where it changes."""
    if unit == "codepoint":
        return np.arange(len(points)) & 1
    if unit == "word":  # counts the beginnings of words
        space = np.isin(points, _SPACE)
        return np.cumsum(~space & np.r_[True, space[:-1]]) if len(points) else space
    if unit == "line":
        return np.cumsum(np.r_[False, points[:-1] == 10]) if len(points) else points
    raise ValueError(f"no unit {unit!r}: codepoint, word or line")


def boundaries(points: np.ndarray, unit: str = "codepoint") -> np.ndarray:
    """Places between units, 0 and the end included: n + 1 of them for n units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(points)]


def numbers(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers of 32 bits that decide a document's cuts and form."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: bytes, drawn: tuple[int, int, int, int], unit: str = "codepoint", share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text; form is plain, psm or spm."""
    points = decoded(text)
    at = boundaries(points, unit)
    n = len(at) - 1
    one, two, shape, turn = drawn
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or any(m in text for m in marks) or shape % 100 >= share:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    a, b = int(at[a]), int(at[b])
    prefix, middle, suffix = encoded(points[:a]), encoded(points[a:b]), encoded(points[b:])
    if turn % 100 < suffix_first:
        return n, "spm", a, b - a, marks[1] + suffix + marks[0] + prefix + marks[2] + middle
    return n, "psm", a, b - a, marks[0] + prefix + marks[1] + suffix + marks[2] + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transform`` had: no piece contains a marker, so each stands at its first place."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, middle = output.removeprefix(first.encode()).partition(MIDDLE.encode())
    left, _, right = head.partition(second.encode())
    return right + middle + left if form == "spm" else left + middle + right


def fill_in_middle(docs: DataFrame, unit: str = "codepoint", share: int = SHARE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, restored) for every row; ``n`` counts units, the two lengths code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(1).to_pylist(), b.column(2)):
                got = transform(text.as_py() or b"", numbers(key, seed), unit, share, suffix_first)
                rows.append((*got, restored(got[4], got[1])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary(), pa.large_binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns[:4], *(c.cast(pa.binary()) for c in columns[4:])], ["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
