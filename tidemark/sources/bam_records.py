"""Decoding of BAM records (public file format): little-endian blocks after the reference list."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
_SEQ = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _tags(data: bytes, at: int, end: int) -> dict[str, str]:
    out = {}
    while at < end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _NUMBERS:
            value = struct.unpack_from(_NUMBERS[kind], data, at)[0]
            at += struct.calcsize(_NUMBERS[kind])
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            width = struct.calcsize(_NUMBERS[sub])
            value = ",".join(str(struct.unpack_from(_NUMBERS[sub], data, at + 5 + k * width)[0]) for k in range(n))
            at += 5 + n * width
        else:
            raise ValueError(f"unknown tag type {kind}")
        out[name] = str(value)
    return out


def records(data: bytes) -> Iterator[dict]:
    """Records of one uncompressed file."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    at = 8 + n
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    names = []
    for _ in range(n_ref):
        (k,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    ref = lambda i: names[i] if i >= 0 else "*"
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        rid, pos, l_name, mapq, _, n_op, flag, l_seq, nrid, npos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p, end = at + 36, at + 4 + size
        qname = data[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_op}I", data, p)
        p += 4 * n_op
        packed = data[p : p + (l_seq + 1) // 2]
        p += (l_seq + 1) // 2
        seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:l_seq]
        raw = data[p : p + l_seq]
        p += l_seq
        qual = "*" if not raw or raw[0] == 255 else "".join(chr(b + 33) for b in raw)
        yield {
            "qname": qname, "flag": flag, "rname": ref(rid), "pos": pos + 1, "mapq": mapq, "cigar": "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*",
            "rnext": ref(nrid), "pnext": npos + 1, "tlen": tlen, "seq": seq or "*", "qual": qual, "tags": _tags(data, p, end),
        }
        at = end


def decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in batches:
        for content in pdf.content:
            rows = []
            for r in records(gzip.decompress(bytes(content))):
                rows.append(r)
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=cols)
