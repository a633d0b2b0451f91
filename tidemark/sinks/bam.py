"""Encoding of BAM records and blocked gzip (public file formats)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import kept

#: Most uncompressed bytes of a block (fixed by the format's 16-bit sizes), and the empty block that ends a file.
BLOCK = 65280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Records that a task puts into files, or one file's if that has more.
TASK = 40_000
_CODE = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
_OPS = "MIDNSHP=X"


def bgzf(data: bytes, level: int = 6) -> bytes:
    """``data`` as blocked gzip, without the end block."""
    out = []
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(piece) + z.flush()
        head = struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


def unbgzf(data: bytes) -> bytes:
    """The bytes of all blocks."""
    from ..sources import bgzf_blocks

    return b"".join(zlib.decompress(data[at + 18 : at + size - 8], -15) for at, size in bgzf_blocks(data))


def _bin(start: int, end: int) -> int:
    """Number of the smallest index bin that holds [start, end) (fixed by the format)."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return base + (start >> shift)
    return 0


def _tag(name: str, value: str) -> bytes:
    if re.fullmatch(r"-?\d{1,9}", value):
        return name.encode() + b"i" + struct.pack("<i", int(value))
    return name.encode() + b"Z" + value.encode() + b"\0"


def record(row: dict, ids: dict[str, int]) -> bytes:
    """One record; ``row`` has the columns that ``sources.bam`` gives."""
    ops = [(int(n), _OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    span = sum(n for n, o in ops if _OPS[o] in "MDN=X")
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [_CODE.get(c.upper(), 15) for c in seq]
    packed = bytes((a << 4) | b for a, b in zip(codes[::2], [*codes[1::2], 0]))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    name, pos = row["qname"].encode() + b"\0", row["pos"] - 1
    ref = lambda n: -1 if n in (None, "*") else ids[row["rname"] if n == "=" else n]
    tags = b"".join(_tag(k, v) for k, v in sorted((row["tags"] or {}).items()))
    head = struct.pack("<iiBBHHHiiii", ref(row["rname"]), pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + max(span, 1)), len(ops), row["flag"], len(seq), ref(row["rnext"]), row["pnext"] - 1, row["tlen"])
    body = head + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def header(references: list[tuple[str, int]], text: str | None = None) -> bytes:
    """File head with the reference list (name, length)."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in references) if text is None else text
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in references)


def encoded(rows: Iterable[dict], references: list[tuple[str, int]]) -> bytes:
    """A whole small file."""
    ids = {n: i for i, (n, _) in enumerate(references)}
    return bgzf(header(references) + b"".join(record(r, ids) for r in rows)) + END


def files(sam: DataFrame, references: list[tuple[str, int]], by: Column, records: int = 1_000_000) -> DataFrame:
    """(name, part, content): BAM files of at most ``records`` records for each value of ``by`` (a chromosome, a cell, a movie), in order of position.

    Rows of one value are split by hash of the read name into parts of about that size, so that reads stay together
    and no task holds a whole hot chromosome; tasks grow in number with the files, some ``TASK`` records each.  ``write`` puts the
    files below a folder.
    """
    named = sam.withColumn("_name", by)
    # written, so that it is known to be small and no name's records meet in one task for it
    sizes = kept(named.groupBy("_name").agg(F.count("*").alias("_rows"), F.ceil(F.count("*") / records).alias("_parts")), "file-sizes")
    rows, parts = sizes.agg(F.sum("_rows"), F.sum("_parts")).first()
    dealt = named.join(sizes.drop("_rows"), "_name").withColumn("_part", F.pmod(F.xxhash64("qname"), F.col("_parts")))
    cols = sam.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rname", "pos", "qname", "flag"], kind="stable")
        rows = ({**r, "tags": dict(r["tags"]) if r["tags"] is not None else {}} for r in pdf[cols].to_dict("records"))
        return pd.DataFrame({"name": [pdf["_name"].iloc[0]], "part": [int(pdf["_part"].iloc[0])], "content": [encoded(rows, references)]})

    dealt = dealt.repartition(max(min(parts or 0, -(-(rows or 0) // TASK)), 1), "_name", "_part")
    return dealt.groupBy("_name", "_part").applyInPandas(run, "name string, part long, content binary")


def write(made: DataFrame, path: str) -> None:
    """Each row of ``files`` as ``path/name.part.bam``, through the file system that Spark uses."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with where.open_output_stream(f"{root}/{r.name}.{r.part}.bam") as f:
                    f.write(r.content)
            yield pd.DataFrame({"n": [len(pdf)]})

    made.mapInPandas(put, "n long").collect()
