"""Rows in the order of their files: numbers, groups of neighbours and records of several lines, across splits.

A file is read in splits, each a task of its own.  What depends on the order of lines is
computed within each split and carried over one row a split, so no file goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import kept
from .running import running, tasks

#: Lines of one block, in which neighbours are compared.
BLOCK = 1 << 14


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split, at): the lines of text files; ``split`` is the byte where the line's split begins, ``at`` orders lines within it."""
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("at"))


def numbered(rows: DataFrame, out: str = "line") -> DataFrame:
    """``rows`` (file, split, at, ...) with their number in the file, from 0."""
    got = running(rows.withColumn("_one", F.lit(1).cast("long")), ["file"], "split", ["at"], "_one", "sum", out)
    return got.drop("_one").withColumn(out, F.col(out) - 1)


def _placed(rows: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame, int] | None:
    """``rows`` with ``_f``, a number of the file, and ``_line``; the files by that number (_f, file); how many rows there are.

    Ids go up by one within a split, so a line's number needs the first id of its split and the lines of the splits before it, and
    no sort.  None where rows are missing in between.
    """
    spark = rows.sparkSession
    splits = kept(rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")), "splits")
    gaps, n = splits.agg(F.count_if(F.expr("last - first + 1 <> n")), F.sum("n")).first()
    if gaps:
        return None
    files = kept(splits.groupBy("file").agg(F.min("first").alias("_f")), "files")
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first")).alias("_shift")).join(files, "file")
    placed = rows.join(F.broadcast(starts), ["file", "split"]).select("_f", (F.col("at") + F.col("_shift")).alias("_line"), *columns)
    return placed, files, tasks(spark, n or 0)


def records(rows: DataFrame, size: int, names: list[str], value: str = "value", key: Column | None = None) -> DataFrame:
    """(file, record, names...): ``size`` lines make a record, wherever the splits fall; an unfinished last one is left out.

    With ``key`` a file holds several texts, each the lines of one key, which stand together: records are cut and numbered within
    each of them, and the rows are (file, key, record, names...).
    """
    cells = lambda k: [F.max(F.when(k == i, F.struct(F.col(value)))).alias(n) for i, n in enumerate(names)]
    shown = [F.col(n)[value].alias(n) for n in names]
    by = [] if key is None else [key.alias("key")]
    placed = _placed(rows, *by, F.col(value))
    if placed is None:
        got = numbered(rows.select("file", "split", "at", *by, value), "_line")
        files = None
    else:
        got, files, n = placed
    here, own = "file" if files is None else "_f", [] if key is None else ["key"]
    if own:
        first = got.groupBy(F.col(here).alias("_there"), F.col("key").alias("_same")).agg(F.min("_line").alias("_first"))
        got = got.join(first, (F.col(here) == F.col("_there")) & F.col("key").eqNullSafe(F.col("_same"))).withColumn("_line", F.col("_line") - F.col("_first"))
    got = got.withColumn("record", F.floor(F.col("_line") / size))
    if files is not None:  # a record's lines meet before they are folded
        got = got.repartition(n, here, *own, "record")
    made = got.groupBy(here, *own, "record").agg(F.count("*").alias("_n"), *cells(F.col("_line") % size)).where(F.col("_n") == size)
    if files is not None:
        made = made.join(F.broadcast(files), "_f")
    return made.select("file", *own, "record", *shown)


def runs(rows: DataFrame, key: Column, /, **parts: Column) -> DataFrame:
    """(file, run, n, first, last): the runs of ``consecutive`` with how many rows they have and the first and last one's ``parts``.

    Blocks of lines fold their own runs; those that go on from one block to the next are put together over the folded rows.
    """
    placed = _placed(rows, F.struct(key.alias("k")).alias("_key"), F.struct(*(c.alias(n) for n, c in parts.items())).alias("x"))
    if placed is None:
        rows = consecutive(rows.withColumn("_x", F.struct(*(c.alias(n) for n, c in parts.items()))), key)
        at = F.struct("split", "at")
        return rows.groupBy("file", "run").agg(F.count("*").alias("n"), F.min_by("_x", at).alias("first"), F.max_by("_x", at).alias("last"))
    got, files, n = placed
    block = F.floor(F.col("_line") / BLOCK)
    # the line before a block's first one comes along
    with_before = F.when(F.col("_line") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    order = W.partitionBy("_f", "_block").orderBy("_line")
    got = got.withColumn("_block", F.explode(with_before)).repartition(n, "_f", "_block").withColumn("_was", F.lag("_key").over(order))
    new = (F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("_key"))).cast("long")
    got = got.where(block == F.col("_block")).withColumn("_new", new).withColumn("_own", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    folded = got.groupBy("_f", "_block", "_own").agg(F.count("*").alias("n"), F.min_by("x", "_line").alias("first"), F.max_by("x", "_line").alias("last"))
    folded = kept(folded, "block-runs")
    blocks = folded.groupBy("_f", "_block").agg(F.max("_own").alias("_runs"))
    before = F.coalesce(F.sum("_runs").over(W.partitionBy("_f").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = folded.join(blocks.select("_f", "_block", before.alias("_before")), ["_f", "_block"]).withColumn("run", F.col("_own") + F.col("_before"))
    made = told.groupBy("_f", "run").agg(F.sum("n").alias("n"), F.min_by("first", "_block").alias("first"), F.max_by("last", "_block").alias("last"))
    return made.join(F.broadcast(files), "_f").select("file", "run", "n", "first", "last")


def consecutive(rows: DataFrame, key: Column, out: str = "run") -> DataFrame:
    """``rows`` (file, split, at, ...) with the number, from 1, of their run: neighbours in the file whose ``key`` is equal.

    A key that comes back later begins a new run; null keys are equal to one another.
    """
    rows = rows.withColumn("_key", F.struct(key.alias("k")))
    order = W.partitionBy("file", "split").orderBy("at")
    ends = rows.groupBy("file", "split").agg(F.max_by("_key", "at").alias("_last"))
    before = ends.select("file", "split", F.lag("_last").over(W.partitionBy("file").orderBy("split")).alias("_carried"))
    known = rows.join(before, ["file", "split"]).withColumn("_was", F.coalesce(F.lag("_key").over(order), "_carried"))
    known = known.withColumn("_new", (F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("_key"))).cast("long"))
    return running(known.drop("_was", "_carried", "_key"), ["file"], "split", ["at"], "_new", "sum", out).drop("_new")


def grouped(rows: DataFrame, key: Column, /, **parts: Column) -> DataFrame:
    """(file, run, n, rows): each run of ``consecutive`` with its rows in order, as structs of ``parts``."""
    got = consecutive(rows, key)
    packed = F.array_sort(F.collect_list(F.struct("split", "at", F.struct(*(c.alias(n) for n, c in parts.items())).alias("row"))))
    by = got.groupBy("file", "run").agg(F.count("*").alias("n"), packed.alias("x"))
    return by.select("file", "run", "n", F.transform("x", lambda x: x["row"]).alias("rows"))


#: The last integer in a file's name.
NUMBER = r"(\d+)\D*$"


def concatenated(spark: SparkSession, path: str, number: str = NUMBER) -> DataFrame:
    """(line, value): the lines of the files under ``path`` in the order of the integer in their names, numbered from 0.

    ``number`` is the pattern whose first group is that integer.  A name without one, or two files with the same one, are an
    error: their order would be a guess.
    """
    rows = lines(spark, path)
    base = F.url_decode(F.element_at(F.split("file", "/"), -1))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).select("file", F.regexp_extract(base, number, 1).alias("digits"))
    fault = F.when(F.col("digits") == "", F.raise_error(F.concat(F.lit("no number in the name of "), F.col("file"))))
    files = files.select("file", F.coalesce(fault.cast("long"), F.col("digits").cast("long")).alias("_number"))
    twice = files.groupBy("_number").agg(F.count("*").alias("_n"), F.min("file").alias("file"))
    twice = twice.select("file", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("another file has the number of "), F.col("file")))).otherwise(F.col("_number")).alias("_number"))
    # a row a split: what stands in the splits before it
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("_n")).join(twice, "file")
    before = F.sum("_n").over(W.orderBy("_number", "split").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("file", "split").orderBy("at")) - 1
    return rows.withColumn("_own", own).join(splits, ["file", "split"]).select((F.col("_before") + F.col("_own")).alias("line"), "value")
