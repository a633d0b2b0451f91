"""Running aggregates over long ordered groups, in two levels.

A window partitioned by a hot key runs in one task.  Here rows also carry a bin of
the ordering column: the aggregate runs within (key, bin), and a carry from the
earlier bins, computed over one row per bin, is added.  Tasks then hold a bin, not
a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task is given where rows are dealt out by a key.
TASK = 1 << 19


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks share ``rows`` rows: as many as there are cores at least, and more as tables grow, so that a task does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK))


#: Rows of one key up to which a plain window over the key serves.
HOT = 1 << 17


def dealt(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """``df`` dealt out by its keys, so that windows and groups of them need no further shuffle; None if some key is hot.

    Keys are counted by their hashes: 65,536 counts at most, none of them below that of a key.
    """
    counts = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).alias("h")).agg(F.count("*").alias("n"))
    rows, most = counts.agg(F.sum("n"), F.max("n")).first()
    return None if (most or 0) > HOT else df.repartition(tasks(df.sparkSession, rows or 0), *keys)


def running(df: DataFrame, keys: list[str], bin_col: str, order: list[str | Column], value: str, op: str, out: str, inclusive: bool = True) -> DataFrame:
    """``out``: ``op`` of ``value`` over the rows of the keys up to this one (itself included or not).

    Bins must not decrease along ``order``.
    """
    agg = {"sum": F.sum, "max": F.max}[op]
    within = W.partitionBy(*keys, bin_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*keys).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*keys, bin_col).agg(agg(value).alias("_total")).withColumn("_carry", agg("_total").over(before)).drop("_total")
    # greatest skips nulls; a sum starts from nothing
    merged = F.greatest("_own", "_carry") if op == "max" else F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return df.withColumn("_own", agg(value).over(within)).join(carry, [*keys, bin_col]).withColumn(out, merged).drop("_own", "_carry")


def sweep(df: DataFrame, keys: list[str], bin_col: str, pos: str, sums: dict[str, str], ahead: str) -> DataFrame:
    """Running sums of several columns and the next row's ``pos`` (as ``ahead``) at once, with one carry table.

    ``sums`` names the running sum of each column; ``pos`` is unique within the keys and bins follow it.
    """
    own = W.partitionBy(*keys, bin_col).orderBy(pos)
    bins = W.partitionBy(*keys).orderBy(bin_col)
    before = bins.rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*keys, bin_col).agg(F.min(pos).alias("_first"), *(F.sum(v).alias(f"_t_{out}") for v, out in sums.items()))
    carry = carry.select(*keys, bin_col, F.lead("_first").over(bins).alias("_ahead"), *(F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in sums.values()))
    rows = df.join(carry, [*keys, bin_col])
    cols = {out: F.sum(v).over(own.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"_c_{out}") for v, out in sums.items()}
    return rows.withColumns(cols | {ahead: F.coalesce(F.lead(pos).over(own), F.col("_ahead"))}).drop("_ahead", *(f"_c_{out}" for out in sums.values()))


def following(df: DataFrame, keys: list[str], bin_col: str, order: str, out: str) -> DataFrame:
    """``out``: the value of ``order`` in the next row of the keys, across bins."""
    return sweep(df, keys, bin_col, order, {}, out)


def spread(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` as a written table with ``_key`` (the keys as a struct, so that nulls are a key too) and ``_bin``.

    Rows are ranged by keys and order; ``_bin`` is the range and does not decrease along ``order``, so a hot key has many bins.
    """
    from ..tables import kept

    ranged = df.withColumn("_key", F.struct(*keys)).repartitionByRange(*[F.col(k) for k in keys], *order)
    return kept(ranged.withColumn("_bin", F.spark_partition_id()), name)


def sums(df: DataFrame, keys: list[str], bin_col: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Running sums of several columns at once (column -> name of its sum), this row included."""
    own = W.partitionBy(*keys, bin_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*keys, bin_col).agg(*(F.sum(v).alias(f"_t_{out}") for v, out in values.items()))
    carry = carry.select(*keys, bin_col, *(F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in values.values()))
    cols = {out: F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"_c_{out}") for v, out in values.items()}
    return df.join(carry, [*keys, bin_col]).withColumns(cols).drop(*(f"_c_{out}" for out in values.values()))


def places(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``_rank``, each row's number from 1 under ``order`` within its keys, and ``_n``, the rows of the keys."""
    rows = spread(df, keys, order, name).withColumn("_one", F.lit(1).cast("long"))
    size = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    return sums(rows, ["_key"], "_bin", order, {"_one": "_rank"}).join(size, "_key").select(*df.columns, "_rank", "_n")
