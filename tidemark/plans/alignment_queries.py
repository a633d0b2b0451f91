"""Alignment, junction, clustering and read-set queries and their SQL.

Order lines stand in for alignments: a line is a read with one intron whose ends come from its day, quantity and part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import psl, vcf
from ..operators import junctions, nonredundant, reads, transcripts
from .views import TX_EXONS, WIDTH, table, tx


def _sam(spark, d):
    pos = (F.datediff("l_shipdate", F.lit("1992-01-01")) % 50 + 1).cast("int")
    left, gap = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 3 * 40 + 30).cast("int")
    text = F.concat(left.cast("string"), F.lit("M"), gap.cast("string"), F.lit("N"), (F.col("l_linenumber") + 5).cast("string"), F.lit("M"))
    tag = F.map_from_arrays(F.array(F.lit("NH")), F.array(F.struct(F.lit("i").alias("type"), (F.col("l_linenumber") % 2 + 1).cast("string").alias("value"))))
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    return table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), flag.alias("flag"), F.col("l_suppkey").cast("string").alias("rname"), pos.alias("pos"), text.alias("cigar"), tag.alias("tags"))


_SAM = """sam AS (SELECT l_orderkey || '/' || l_linenumber AS qname, l_suppkey::VARCHAR AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 50 AS p0, l_quantity::INT AS a,
 (l_partkey % 3 * 40 + 30)::INT AS gap, (l_linenumber + 5)::INT AS b, l_linenumber % 2 + 1 = 1 AS uniq, l_returnflag = 'R' AS minus FROM lineitem),
 jn AS (SELECT qname, chrom, p0 + a AS l, p0 + a + gap AS r, a AS left_size, b AS right_size, uniq FROM sam WHERE gap >= 68)"""


def junction_table(spark, d):
    return junctions.table(junctions.of_alignments(_sam(spark, d)))


def supported(spark, d):
    return junctions.supported_reads(_sam(spark, d), overhang=8, support=3).select("qname", "rname", "pos").distinct()


def sam_blocks(spark, d):
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("chrom"), F.lit(500).cast("long").alias("length"))
    p = psl.from_sam(_sam(spark, d), lengths)
    return p.select("qName", "tStart", "tEnd", "strand", F.col("blockCount").cast("long").alias("n"), psl.coverage().alias("bp"), F.round(psl.quality(), 6).alias("quality"), psl.valid().alias("valid"))


def consensus(spark, d):
    t = tx(spark, d).withColumn("exons", F.transform("exons", lambda x: F.struct(F.floor(x["s"] / 300).alias("s"), (F.floor(x["e"] / 300) + 1).alias("e"))))
    t = t.withColumn("exons", transcripts.smooth("exons", 1))  # exons that the grid puts together are one
    return nonredundant.consensus(t, 1, 1, width=WIDTH).select("chrom", "locus", "n")


def clusters(spark, d):
    return nonredundant.clustered(tx(spark, d), "any", width=WIDTH)


def votes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("base"), F.col("l_quantity").cast("long").alias("weight"))
    return reads.voted(rows)


def read_tiers(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("m"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("n"), "o_orderstatus")
    return reads.tiered_set([o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], "m", "n", [False, True, True]).select("m", "name")


def variants(spark, d):
    q = F.col("l_quantity").cast("int")
    info = F.concat(F.lit("DP="), (q * 3).cast("string"), F.lit(";DP4="), q.cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(","), (F.col("l_partkey") % 9).cast("string"), F.lit(",4"))
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("qual"), F.lit("A").alias("ref"), F.when(F.col("l_returnflag") == "A", "GT").otherwise("G").alias("alt"), info.alias("info"), F.array(F.lit("GT"), F.when(F.col("l_linestatus") == "O", "0/1").otherwise("1/1")).alias("samples"))
    return vcf.filtered(v, 20000.0, 30, 8, 2, True).select("l_orderkey", "l_linenumber")


def split_alignments(spark, d):
    """Lines as reads whose tags name further alignments in three layouts."""
    x = table(spark, d, "lineitem")
    pos, minus = (F.datediff("l_shipdate", F.lit("1992-01-01")) + 1).cast("string"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    chrom, text = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"))
    bwa, other = F.concat_ws(",", chrom, pos, minus, text, F.lit("60"), F.lit("1")), F.concat_ws(",", chrom, F.concat(minus, pos), text, F.lit("30"))
    sa = F.when(F.col("l_linenumber") % 2 == 0, F.concat(bwa, F.lit(";"), other, F.lit(";"))).otherwise(F.concat(other, F.lit(",2;")))
    xa = F.when(F.col("l_linestatus") == "O", F.concat(F.concat_ws(",", chrom, F.concat(minus, pos), text, F.lit("0")), F.lit(";")))
    return psl.supplementary(x.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), sa.alias("sa"), xa.alias("xa")), F.col("sa"), F.col("xa"))


def best_psl(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qName"), F.col("l_suppkey").alias("tName"), F.col("l_partkey").alias("tStart"), F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")).alias("blockSizes"))
    return psl.best_per_query(rows).select("qName", "tName", "tStart").distinct()


QUERIES = {
    "split_alignments": (split_alignments, """WITH x AS (SELECT l_orderkey || '/' || l_linenumber AS qname, CASE l_returnflag WHEN 'R' THEN 16 ELSE 0 END AS flag, 's' || l_suppkey AS rname, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + 1)::INTEGER AS pos, l_quantity::INT || 'M' AS cigar, l_linenumber % 2 = 0 AS even, l_linestatus = 'O' AS open FROM lineitem)
 SELECT qname, flag, rname, pos, 60 AS mapq, cigar FROM x WHERE even UNION ALL SELECT qname, flag, rname, pos, 30, cigar FROM x UNION ALL SELECT qname, flag, rname, pos, 0, cigar FROM x WHERE open"""),
    "best_psl_per_query": (best_psl, "SELECT DISTINCT l_orderkey AS qName, l_suppkey AS tName, l_partkey AS tStart FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::BIGINT + l_linenumber DESC, l_suppkey, l_partkey) AS k FROM lineitem) WHERE k = 1"),
    "junction_table": (junction_table, f"WITH {_SAM} SELECT chrom, l::BIGINT AS l, r::BIGINT AS r, count(DISTINCT qname) AS reads, count(DISTINCT left_size) AS positions, max(right_size)::BIGINT AS width, count(DISTINCT qname) FILTER (uniq) AS unique_reads, count(DISTINCT qname) FILTER (NOT uniq) AS multi_reads FROM jn GROUP BY 1, 2, 3"),
    "junction_support_filter": (supported, f"WITH {_SAM}, j AS (SELECT * FROM jn WHERE left_size >= 8 AND right_size >= 8), g AS (SELECT chrom, l, r FROM j GROUP BY 1, 2, 3 HAVING count(DISTINCT qname) >= 3), k AS (SELECT DISTINCT qname FROM j JOIN g USING (chrom, l, r)) SELECT DISTINCT qname, chrom AS rname, (p0 + 1)::INTEGER AS pos FROM sam SEMI JOIN k USING (qname)"),
    "alignment_blocks": (sam_blocks, f"WITH {_SAM} SELECT qname AS qName, p0::BIGINT AS tStart, (p0 + a + gap + b)::BIGINT AS tEnd, CASE WHEN minus THEN '-' ELSE '+' END AS strand, 2::BIGINT AS n, (a + b)::BIGINT AS bp, round(1 - CASE WHEN gap < 68 THEN gap ELSE 0 END / (a + b), 6) AS quality, true AS valid FROM sam"),
    "nonredundant_transcripts": (consensus, None),
    "transcript_clusters": (clusters, f"""WITH RECURSIVE {TX_EXONS}, x AS (SELECT * FROM ex), p AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.id <> b.id),
 c AS (SELECT DISTINCT id, id AS r FROM x UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.id) SELECT id, min(r) AS component FROM c GROUP BY id"""),
    "weighted_votes": (votes, "SELECT id, pos, base, weight FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY weight DESC, base) AS k FROM (SELECT l_partkey AS id, l_linenumber AS pos, l_returnflag AS base, sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY 1, 2, 3)) WHERE k = 1"),
    "tiered_read_set": (read_tiers, """WITH o AS (SELECT o_custkey AS m, o_orderkey::VARCHAR AS name, o_totalprice AS n, o_orderstatus AS s FROM orders), p AS (SELECT m, name FROM o WHERE s = 'P'),
 f AS (SELECT m, name FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, name) AS k FROM o WHERE s = 'F') WHERE k = 1 AND m NOT IN (SELECT m FROM p)),
 r AS (SELECT m, name FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, name) AS k FROM o WHERE s = 'O') WHERE k = 1 AND m NOT IN (SELECT m FROM p UNION ALL SELECT m FROM f)) SELECT * FROM p UNION ALL SELECT * FROM f UNION ALL SELECT * FROM r"""),
    "variant_filters": (variants, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 20000 AND l_quantity::INT * 3 >= 30 AND least(l_quantity::INT + l_linenumber, l_partkey % 9 + 4) >= 8 AND least(l_quantity::INT, l_linenumber, l_partkey % 9, 4) >= 2 AND l_returnflag <> 'A' AND l_linestatus = 'O'"),
}
