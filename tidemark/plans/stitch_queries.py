"""Gap repair over order lines as partial alignments of reads (orders) to the documents' sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import stitch
from .views import DNA, dna, table

_CHUNK = 256


def _segments(spark, d):
    s = F.col("l_linenumber").cast("long") * 150 + F.col("l_quantity").cast("long")
    q = (F.col("l_linenumber") - 1).cast("long") * 60 + F.pmod("l_partkey", F.lit(7))
    exons = F.array(F.struct(s.alias("s"), (s + 40 + F.floor(F.col("l_quantity") / 2)).alias("e")))
    strand = F.when(F.col("l_orderkey") % 3 == 0, "-").otherwise("+")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.pmod("l_orderkey", F.lit(50)).cast("string").alias("chrom"), strand.alias("strand"), exons.alias("exons"), q.alias("q_s"), (q + 55 + F.pmod("l_suppkey", F.lit(9))).alias("q_e"))


def _known(spark, d):
    c = F.col("c_custkey")
    left = (c % 6 + 1) * 150 + 60 + c % 25
    return table(spark, d, "customer").select((c % 50).cast("string").alias("chrom"), left.alias("l"), (left + 85 + c % 11).alias("r"))


def _chunks(spark, d):
    return seq.chunked(dna(spark, d).where("doc_id < 50").select(F.col("doc_id").cast("string").alias("name"), "seq"), _CHUNK)


def cuts(spark, d):
    found = stitch.joints(stitch.chained(_segments(spark, d), 200))
    return stitch.cuts(found, _chunks(spark, d), _CHUNK, _known(spark, d)).select("read", F.col("k").cast("long").alias("k"), "cut_l", "cut_r", F.col("signal").cast("long").alias("signal"), "known", F.col("shift").cast("long").alias("shift"))


def stitched(spark, d):
    got = stitch.stitched(_segments(spark, d), _chunks(spark, d), _CHUNK, _known(spark, d), 200)
    shown = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return got.select("read", "part", "n", "q_s", "q_e", shown.alias("exons"))


_ROWS = f"""{DNA}, seg AS (SELECT l_orderkey AS read, l_orderkey % 50 AS chrom, l_orderkey % 3 = 0 AS minus, l_linenumber * 150 + l_quantity::BIGINT AS s, l_linenumber * 150 + l_quantity::BIGINT + 40 + floor(l_quantity / 2)::BIGINT AS e,
   (l_linenumber - 1) * 60 + l_partkey % 7 AS qs, (l_linenumber - 1) * 60 + l_partkey % 7 + 55 + l_suppkey % 9 AS qe FROM lineitem),
 num AS (SELECT *, row_number() OVER o AS k, coalesce(s > lag(e) OVER o + 200, false)::BIGINT AS new FROM seg WINDOW o AS (PARTITION BY read ORDER BY s, e, qs, qe)),
 ch AS (SELECT *, sum(new) OVER (PARTITION BY read ORDER BY k) AS chain FROM num),
 jt AS (SELECT * FROM (SELECT read, chrom, minus, k, s AS left_s, e AS l, qe AS ql, lead(s) OVER o AS r, lead(e) OVER o AS right_e, lead(qs) OVER o AS qr FROM ch WINDOW o AS (PARTITION BY read, chain ORDER BY k)) WHERE qr IS NOT NULL AND ql >= qr - 10),
 ab AS (SELECT a, b FROM (SELECT unnest(range(-10, 11)) AS a), (SELECT unnest(range(-10, 11)) AS b)),
 cand AS (SELECT *, abs(qr + greatest(b, 0) - ql - least(a, 0)) + greatest(a, 0) + greatest(-b, 0) AS shift, l + a AS cut_l, r + b AS cut_r FROM jt, ab),
 few AS (SELECT * FROM cand WHERE shift < 10 AND cut_r - cut_l >= 68 AND cut_l > left_s AND cut_r < right_e),
 lett AS (SELECT few.*, substr(seq, cut_l + 1, 2) || CASE WHEN cut_r >= 2 THEN substr(seq, cut_r - 1, 2) ELSE '' END AS w FROM few JOIN dna ON doc_id = chrom WHERE doc_id < 50),
 sig AS (SELECT *, CASE WHEN minus THEN CASE w WHEN 'CTAC' THEN 0 WHEN 'CTGC' THEN 1 WHEN 'GTAT' THEN 2 END ELSE CASE w WHEN 'GTAG' THEN 0 WHEN 'GCAG' THEN 1 WHEN 'ATAC' THEN 2 END END AS signal FROM lett),
 kn AS (SELECT DISTINCT c_custkey % 50 AS chrom, (c_custkey % 6 + 1) * 150 + 60 + c_custkey % 25 AS kl, (c_custkey % 6 + 1) * 150 + 60 + c_custkey % 25 + 85 + c_custkey % 11 AS kr FROM customer),
 every AS (SELECT read, k, signal, shift, 1 AS given, cut_l, cut_r FROM sig WHERE signal IS NOT NULL UNION ALL SELECT read, k, 0, shift, 0, cut_l, cut_r FROM few JOIN kn ON kn.chrom = few.chrom AND kl = cut_l AND kr = cut_r),
 best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read, k ORDER BY signal, shift, given, cut_l, cut_r) AS i FROM every) WHERE i = 1)"""

QUERIES = {
    "splice_cuts": (cuts, f"WITH {_ROWS} SELECT read, k, cut_l, cut_r, CASE given WHEN 1 THEN signal END::BIGINT AS signal, given = 0 AS known, shift::BIGINT AS shift FROM best"),
    "stitched_alignments": (stitched, f"""WITH {_ROWS}, moved AS (SELECT ch.read, ch.k, coalesce(b.cut_r, s) AS s, coalesce(a.cut_l, e) AS e, qs, qe, (b.cut_r IS NULL)::BIGINT AS new2
   FROM ch LEFT JOIN best a ON a.read = ch.read AND a.k = ch.k LEFT JOIN best b ON b.read = ch.read AND b.k + 1 = ch.k),
 pt AS (SELECT *, sum(new2) OVER (PARTITION BY read ORDER BY k) AS part FROM moved)
 SELECT read, part::BIGINT AS part, count(*) AS n, min(qs) AS q_s, max(qe) AS q_e, coalesce(string_agg(s || '-' || e, ',' ORDER BY k) FILTER (s < e), '') AS exons FROM pt GROUP BY read, part"""),
}
