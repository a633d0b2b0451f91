"""Byte-level numpy kernels shared by the text operators.

A batch of texts is one uint8 buffer with document offsets.  Kernels work on
chunks of about ``CHUNK`` bytes (whole documents, so a longer document makes a
longer chunk), which bounds memory whatever the batch size.  Hashes of substrings
come from polynomial prefix sums modulo the prime 2**31 - 1 at two bases, so a hash
of any span costs four lookups and equal bytes always give equal hashes.  Two
different strings of n bytes agree at a share of at most (n / 2**31)**2 of the pairs
of bases, however they are built; modulo a power of two some strings agree at all.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
CHUNK_DOCS = 512
BLOCK = 1 << 14  # elements that a step of a long array takes, so that they stay in the cache
_U = np.uint64
#: Fixed random numbers: two hashes of two bases each, and the values of bytes.
PRIME = np.uint64((1 << 31) - 1)
_BASES = np.random.default_rng(20240229).integers(1 << 20, (1 << 31) - 2, (2, 2))
_BYTES = np.random.default_rng(20240301).integers(1, (1 << 31) - 2, 256, dtype=np.uint64)
_pow: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo PRIME, at least."""
    known = _pow.get(base, np.ones(1, np.uint64))
    while len(known) <= n:
        known = np.append(known, known * _U(pow(base, len(known), int(PRIME))) % PRIME)
    _pow[base] = known
    return known


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME up to one PRIME more or so: below 2**32 for every x below 2**62."""
    high = x >> _U(31)
    x &= PRIME
    x += high
    return x


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, each term folded below 2**32, so that 2**31 of them fit."""
    by, out = powers(base, len(values)), np.zeros(len(values) + 1, np.uint64)
    for a in range(0, len(values), BLOCK):
        part = out[a + 1 : a + 1 + BLOCK]
        np.multiply(values[a : a + BLOCK], by[a : a + len(part)], out=part)
        _fold(part)
        part[0] += out[a]
        np.cumsum(part, out=part)
    return out


def between(sums_: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash (31 bits) of values[start:end] of each span; the same wherever the span lies."""
    h = _fold(sums_[end] - sums_[start])
    h = _fold(h)
    h *= powers(pow(base, -1, int(PRIME)), len(sums_))[start]
    h = _fold(_fold(h))
    h[h >= PRIME] -= PRIME
    return h


def trim() -> None:
    """Give freed memory back to the system: a worker lives on with what its largest block took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of UTF-8 bytes and len+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if n and bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Document ranges [a, b) of about ``size`` bytes and at most CHUNK_DOCS documents, never splitting a document."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(max(b, a + 1), a + CHUNK_DOCS, n)
        yield a, b
        a = b


def texts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first doc, end doc, bytes, offsets) chunk by chunk."""
    buf, offs = flat(col)
    for a, b in chunks(offs):
        o = offs[a : b + 1]
        yield a, b, buf[o[0] : o[-1]], o - o[0]


def prefix(buf: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``spans``.  ``which`` is one of two independent hashes."""
    values = _BYTES[buf]  # below 2**31, as powers are
    return tuple(sums(values, int(b)) for b in _BASES[which])


def spans(pre: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes [start, end) of each span."""
    one, two = (between(p, int(b), start, end) for p, b in zip(pre, _BASES[which]))
    return mix((one << _U(31) | two) + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a document."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    a = ink.copy()
    a[1:] &= ~ink[:-1] | first[1:n]
    z = ink.copy()
    z[:-1] &= ~ink[1:] | first[1:n]
    starts, ends = np.flatnonzero(a), np.flatnonzero(z) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of per-byte values by document (empty documents give 0)."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def counts(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; does it equal an earlier one (by index)."""
    n = len(keys)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        later[order[1:][same]] = True
        many[order[:-1][same]] = True
        many |= later
    return many, later
