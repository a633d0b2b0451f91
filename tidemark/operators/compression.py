"""Coordinates of homopolymer-compressed sequences and the way back to the original ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals as iv
from .running import running


def runs(chunks: DataFrame) -> DataFrame:
    """(name, pos, extra): runs of more than one letter in a chunked reference (name, chunk, seq), as ``functions.seq.chunked`` makes it.

    ``pos`` is the run's place in the compressed sequence and ``extra`` the letters that it has lost.  Runs are cut out chunk by chunk;
    one that goes on over chunks adds up, as its parts get one place.
    """
    parts = F.regexp_extract_all(F.col("seq"), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    cut = chunks.where("seq <> ''").select("name", "chunk", F.transform(parts, F.length).alias("sizes"), F.substring("seq", 1, 1).alias("first"), F.expr("right(seq, 1)").alias("last"))
    order = W.partitionBy("name").orderBy("chunk")  # a row a chunk, without its letters
    place = cut.select("name", "chunk", F.size("sizes").alias("n"), F.coalesce(F.lag("last").over(order) == F.col("first"), F.lit(False)).cast("long").alias("joined"))
    place = place.withColumn("base", F.coalesce(F.sum(F.col("n") - F.col("joined")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("joined"))
    # only what can have lost letters becomes a row: longer runs, and those at the ends of a chunk
    some = F.filter(F.transform("sizes", lambda n, i: F.struct(i.alias("k"), n.alias("size"))), lambda x: (x["size"] > 1) | (x["k"] == 0) | (x["k"] == F.size("sizes") - 1))
    each = cut.select("name", "chunk", some.alias("some")).join(place.select("name", "chunk", "base"), ["name", "chunk"]).select("name", "base", F.explode("some").alias("x")).select("name", "base", "x.*")
    return each.groupBy("name", (F.col("base") + F.col("k")).alias("pos")).agg((F.sum("size") - 1).alias("extra")).where("extra > 0")


def lifted(places: DataFrame, lost: DataFrame, width: int = iv.BIN) -> DataFrame:
    """(name, pos, original): where the letters before each place (name, pos) of the compressed sequence end in the original one.

    That is the place and the letters lost in the runs before it: one running sum over places and runs together.
    """
    marks = places.select("name", "pos").distinct().select("name", "pos", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("extra"))
    rows = lost.select("name", "pos", F.lit(1).alias("kind"), F.col("extra").cast("long").alias("extra")).unionByName(marks).withColumn("_bin", F.floor(F.col("pos") / width))
    told = running(rows, ["name"], "_bin", ["pos", "kind"], "extra", "sum", "before").where("kind = 0")
    return told.select("name", "pos", (F.col("pos") + F.col("before")).alias("original"))


def restored(psl: DataFrame, target: DataFrame, query: DataFrame | None = None, width: int = iv.BIN) -> DataFrame:
    """``psl`` (columns of ``sources.psl``) with its target blocks, and with ``query`` runs its query blocks, in original coordinates.

    A block's sizes may then differ between both sides: ``blockSizes`` are the target's and ``qBlockSizes`` the query's.  Starts are
    on the strand of the file; with a minus strand the query's runs must be those of its reverse complement.
    """
    def ends(name: str, starts: str, lost: DataFrame, out: str) -> DataFrame:
        """The blocks of each distinct (name, starts, sizes), which many rows may share, as array<struct(k, os, oe)>."""
        shape = [name, starts, "blockSizes"]
        rows = psl.select(*shape).distinct().withColumn("_row", F.xxhash64(*shape))
        at = rows.select("_row", F.col(name).alias("name"), F.posexplode(F.arrays_zip(F.col(starts).alias("s"), F.col("blockSizes").alias("n"))).alias("k", "x"))
        at = at.select("_row", "name", "k", F.col("x.s").cast("long").alias("s"), (F.col("x.s") + F.col("x.n")).cast("long").alias("e"))
        spots = lifted(at.select("name", F.explode(F.array("s", "e")).alias("pos")), lost.join(rows.select(F.col(name).alias("name")).distinct(), "name", "left_semi"), width)
        got = at.join(spots.select("name", F.col("pos").alias("s"), F.col("original").alias("os")), ["name", "s"]).join(spots.select("name", F.col("pos").alias("e"), F.col("original").alias("oe")), ["name", "e"])
        by = got.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("k", "os", "oe"))).alias(out))
        return rows.join(by, "_row").drop("_row")

    out = psl.join(ends("tName", "tStarts", target, "_t"), ["tName", "tStarts", "blockSizes"], "left").select(*psl.columns, "_t")
    starts, sizes = lambda c: F.transform(c, lambda x: x["os"]), lambda c: F.transform(c, lambda x: x["oe"] - x["os"])
    new = {"tStarts": starts("_t"), "blockSizes": sizes("_t"), "tStart": F.array_min(starts("_t")), "tEnd": F.array_max(F.transform("_t", lambda x: x["oe"]))}
    if query is not None:
        out = out.join(ends("qName", "qStarts", query, "_q").withColumnsRenamed({"blockSizes": "_sizes", "qStarts": "_starts", "qName": "_name"}), (psl["qName"] == F.col("_name")) & (psl["qStarts"] == F.col("_starts")) & (psl["blockSizes"] == F.col("_sizes")), "left").drop("_name", "_starts", "_sizes")
        new |= {"qStarts": starts("_q"), "qBlockSizes": sizes("_q")}
    return out.withColumns(new).drop("_t", "_q")
