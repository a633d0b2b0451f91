"""Alignment records stored for access by name, by place in the file and by coordinates.

``build`` lays records out in parts, ranges of coordinates that hold about as many rows
each, and writes two small tables beside them: the bounds of each part, and for every
record its name, its number and its part, in buckets by name and in ranges by number.
A look-up reads the buckets or ranges of what is asked, then only the parts that they
name; Spark prunes the others by their folder, so it works on any store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of names; an index keeps its own number.
BUCKETS = 64
#: Numbers of records in one folder of the index by number.
ORDINALS = 1 << 20
#: Most names, numbers or parts that one look-up may list; more are joined as a table (``by_table``).
MOST = 10_000


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def build(records: DataFrame, path: str, end: Column, parts: int, name: str = "qname", chrom: str = "rname", pos: str = "pos", ordinal: str = "line", primary: Column | None = None, buckets: int = BUCKETS) -> None:
    """Write ``records`` and their index below ``path`` in ``parts`` parts.

    ``ordinal`` numbers the records (look-ups by name hold where numbers repeat, too), ``end`` is the first base behind one, and ``primary`` tells which of a name's records may stand for it.
    """
    spark, schemas = records.sparkSession, {}

    def put(df: DataFrame, table: str, *by: str) -> DataFrame:
        schemas[table] = df.schema.json()
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{table}")
        return spark.read.schema(df.schema).parquet(f"{path}/{table}")

    rows = records.withColumns({"_end": end.cast("long"), "_primary": primary if primary is not None else F.lit(True)})
    laid = rows.repartitionByRange(parts, F.col(chrom), F.col(pos), F.col(ordinal)).sortWithinPartitions(chrom, pos, ordinal)
    data = put(laid.withColumn("part", F.spark_partition_id()), "data", "part")
    put(data.groupBy("part", F.col(chrom).alias("chrom")).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.max("_end").alias("end"), F.count("*").alias("n")), "parts")
    slim = data.select(F.col(name).alias("name"), F.col(ordinal).alias("ordinal"), "part", F.col("_primary").alias("primary"))
    first = W.partitionBy("name").orderBy(F.desc("primary"), "ordinal")  # a read has few records
    chosen = slim.withColumn("primary", F.col("primary") & (F.row_number().over(first) == 1)).withColumn("bucket", _bucket(F.col("name"), buckets))
    put(chosen.repartition("bucket").sortWithinPartitions("name"), "names", "bucket")
    put(slim.select("ordinal", "part", F.floor(F.col("ordinal") / ORDINALS).alias("span")).repartitionByRange("ordinal"), "ordinals", "span")
    about = [(buckets, name, chrom, pos, ordinal, schemas)]
    spark.createDataFrame(about, "buckets int, name string, chrom string, pos string, ordinal string, schemas map<string,string>").coalesce(1).write.parquet(f"{path}/about")


class Index:
    """Look-ups over what ``build`` wrote; every result has the records' own columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = spark.read.parquet(f"{path}/about").first()
        self.data = self._read("data")

    def _read(self, table: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.about.schemas[table]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _in_parts(self, parts: Iterable[int]) -> DataFrame:
        return self.data.where(F.col("part").isin(sorted(set(parts))))

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(c for c in self.data.columns if c not in ("part", "_end", "_primary")))

    def _at_most(self, asked: list) -> list:
        if len(asked) > MOST:
            raise ValueError(f"more than {MOST} in one look-up: use by_table")
        return asked

    def _found(self, hits: DataFrame) -> list:
        return self._at_most(hits.limit(MOST + 1).collect())

    def by_names(self, names: list[str], primary: bool = False) -> DataFrame:
        """Records of the names; with ``primary`` the one record that stands for each name."""
        wanted = self._at_most(sorted(set(names)))
        asked = self.spark.createDataFrame([(n,) for n in wanted], "name string")
        buckets = [r[0] for r in asked.select(_bucket(F.col("name"), self.about.buckets)).distinct().collect()]
        hits = self._read("names").where(F.col("bucket").isin(buckets) & F.col("name").isin(wanted))
        if primary:
            hits = hits.where("primary")
        found = self._found(hits.select("ordinal", "part"))
        return self._shown(self._in_parts(r.part for r in found).where(F.col(self.about.ordinal).isin([r.ordinal for r in found]) & F.col(self.about.name).isin(wanted)))

    def by_ordinals(self, ordinals: list[int]) -> DataFrame:
        """Records by their numbers."""
        wanted = self._at_most(sorted(set(ordinals)))
        hits = self._read("ordinals").where(F.col("span").isin(sorted({n // ORDINALS for n in wanted})) & F.col("ordinal").isin(wanted))
        return self._shown(self._in_parts(r.part for r in self._found(hits.select("part").distinct())).where(F.col(self.about.ordinal).isin(wanted)))

    def by_range(self, chrom: str, s: int, e: int) -> DataFrame:
        """Records on ``chrom`` that share a base with the 1-based closed range s to e."""
        hits = self._read("parts").where((F.col("chrom") == chrom) & (F.col("first") <= e) & (F.col("end") > s))
        here = (F.col(self.about.chrom) == chrom) & (F.col(self.about.pos) <= e) & (F.col("_end") > s)
        return self._shown(self._in_parts(r.part for r in self._found(hits.select("part"))).where(here))

    def by_table(self, names: DataFrame, primary: bool = False) -> DataFrame:
        """Records of any number of names (a table with a column ``name``): joined, and parts pruned where Spark finds it worth it."""
        hits = self._read("names").join(names.select("name").distinct().withColumn("bucket", _bucket(F.col("name"), self.about.buckets)), ["bucket", "name"])
        if primary:
            hits = hits.where("primary")
        hits = hits.select("part", F.col("ordinal").alias(self.about.ordinal), F.col("name").alias(self.about.name))
        return self._shown(self.data.join(hits, ["part", self.about.ordinal, self.about.name], "left_semi"))
