"""Views that the queries share, as DataFrames and as SQL common table expressions with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Position bins of the queries' short coordinates.
WIDTH = 256
_ACGT = "ACGT" * 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iv(spark: SparkSession, sf_dir: str, chrom: str = "l_suppkey") -> DataFrame:
    """Intervals of order lines: a supplier or part is the chromosome, the ship day the start, the quantity the length."""
    s = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    cols = [F.col(chrom).alias("chrom"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"), F.col("l_linenumber").cast("long").alias("w"), F.col("l_linestatus").alias("strand"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("tx")]
    return table(spark, sf_dir, "lineitem").select(*cols)


def iv_sql(chrom: str = "l_suppkey", name: str = "iv") -> str:
    return f"""{name} AS (SELECT {chrom} AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS s,
      date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT + l_quantity::BIGINT AS e, l_linenumber::BIGINT AS w,
      l_linestatus AS strand, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS tx FROM lineitem)"""


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): letters of documents turned into A, C, G and T."""
    letters = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", _ACGT[:26])
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(letters, "[^ACGT]", "").alias("seq"))


DNA = f"dna AS (SELECT doc_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{_ACGT[:26]}'), '[^ACGT]', '', 'g') AS seq FROM documents)"


def qual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, qual): printable ASCII of documents as quality strings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("qual"))


QUAL = "qual AS (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS qual FROM documents)"
#: The same, a row a character: its position from 1 and its code.
QUAL_CODES = f"{QUAL}, code AS (SELECT doc_id, i, ascii(c)::BIGINT AS code FROM (SELECT doc_id, unnest(string_split(qual, '')) AS c, generate_subscripts(string_split(qual, ''), 1) AS i FROM qual WHERE length(qual) > 0))"


def by_id(rows: DataFrame) -> DataFrame:
    """``rows`` (id, ...) of few lines an id, dealt out by it in tasks that grow in number with the rows."""
    from ..operators.running import tasks

    return rows.repartition(tasks(rows.sparkSession, rows.count()), "id")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, exons): the merged intervals of each order, on one chromosome a hundred orders."""
    from ..operators import transcripts as tr

    rows = iv(spark, sf_dir).select(F.col("tx").alias("id"), F.floor(F.col("tx") / 100).alias("chrom"), "s", "e")
    rows = by_id(rows)
    return tr.from_intervals(rows, ["id", "chrom"])


#: Exons (id, chrom, s, e) of the same transcripts.
TX_EXONS = f"""{iv_sql()}, tx_rows AS (SELECT tx AS id, floor(tx / 100)::BIGINT AS chrom, s, e FROM iv WHERE s < e),
  tx_flag AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM tx_rows),
  tx_isl AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY s, e, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM tx_flag),
  ex AS (SELECT id, chrom, min(s) AS s, max(e) AS e FROM tx_isl GROUP BY id, chrom, k)"""
