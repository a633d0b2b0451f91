"""Read assignment over order lines as alignments of reads (orders) to transcripts (parts) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment
from ..operators import intervals as iv
from .views import WIDTH, table


def _alignments(spark, d):
    s = F.col("l_linenumber").cast("long") * 20
    e = s + F.col("l_quantity").cast("long") * 6
    two = F.array(F.struct(s.alias("s"), e.alias("e")), F.struct((e + F.pmod("l_suppkey", F.lit(20))).alias("s"), (e + 150).alias("e")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.pmod("l_partkey", F.lit(40)).alias("tx"), two.alias("exons"))


def _transcripts(spark, d):
    p = F.col("p_partkey")
    cuts = F.transform(F.sequence(F.lit(1), p % 4 + 1), lambda k: k * 70 + p % 13)
    gene = F.when(p % 7 == 0, F.concat(F.lit("MIR"), (p % 12).cast("string"))).when(p % 5 == 0, F.concat(F.lit("A-"), (p % 12).cast("string"))).otherwise(F.concat(F.lit("G"), (p % 12).cast("string")))
    return table(spark, d, "part").where("p_partkey < 40").select(p.alias("tx"), gene.alias("gene"), F.lit(400).cast("long").alias("length"), F.transform(cuts, lambda x: x.cast("long")).alias("cuts"))


def _taken(spark, d):
    reads = table(spark, d, "orders").select(F.col("o_orderkey").alias("read"), (F.col("o_orderkey") % 200 + 120).alias("length"))
    found = assignment.evidence(assignment.longest_blocks(_alignments(spark, d)), reads, _transcripts(spark, d))
    return assignment.chosen(found)


def taken(spark, d):
    return _taken(spark, d).select("read", "tx", "gene", "stage", "length", F.col("junctions").cast("long").alias("junctions"), F.col("seen").cast("long").alias("seen"))


def counts(spark, d):
    return assignment.gene_counts(_taken(spark, d))


def report(spark, d):
    got = assignment.report(_alignments(spark, d), _taken(spark, d))
    return got.withColumn("junctions", F.col("junctions").cast("long")).withColumn("seen", F.col("seen").cast("long"))


def genes_at(spark, d):
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    spots = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.pmod("l_partkey", F.lit(40)).alias("chrom"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e")).distinct()
    c = F.col("c_custkey")
    gene = F.when(c % 7 == 0, F.concat(F.lit("mir"), (c % 30).cast("string"))).when(c % 5 == 0, F.concat(F.lit("A-"), (c % 30).cast("string"))).otherwise(F.concat(F.lit("G"), (c % 30).cast("string")))
    genes = table(spark, d, "customer").select(gene.alias("gene"), (c % 40).alias("chrom"), (c * 37 % 2500).alias("s"), (c * 37 % 2500 + c % 90 + 10).alias("e"))
    return assignment.genes_at(spots, genes, WIDTH).select("id", F.array_join("genes", ",").alias("genes"))


_FOUND = """al AS (SELECT l_orderkey AS read, l_partkey % 40 AS tx, l_linenumber * 20 AS s, l_linenumber * 20 + l_quantity::BIGINT * 6 AS e, l_suppkey % 20 AS gap FROM lineitem),
 bl AS (SELECT read, tx, s, CASE WHEN gap <= 9 THEN e + 150 ELSE e END AS e FROM al UNION ALL SELECT read, tx, e + gap, e + 150 FROM al WHERE gap > 9),
 lb AS (SELECT read, tx, s, e FROM (SELECT *, row_number() OVER (PARTITION BY read, tx ORDER BY e - s DESC, s) AS i FROM bl) WHERE i = 1),
 tr AS (SELECT p_partkey AS tx, CASE WHEN p_partkey % 7 = 0 THEN 'MIR' WHEN p_partkey % 5 = 0 THEN 'A-' ELSE 'G' END || p_partkey % 12 AS gene, list_transform(range(1, p_partkey % 4 + 2), lambda k: k * 70 + p_partkey % 13) AS cuts FROM part WHERE p_partkey < 40),
 fd AS (SELECT read, tx, gene, e - s AS length, o_orderkey % 200 + 120 AS read_length, len(cuts) AS junctions, len(list_filter(cuts, lambda p: s < p AND p < e)) AS seen FROM lb JOIN tr USING (tx) JOIN orders ON o_orderkey = read),
 st AS (SELECT *, CASE WHEN seen = junctions THEN 0 ELSE 1 END AS stage FROM fd WHERE length >= 100 AND length >= 0.8 * read_length),
 m1 AS (SELECT *, max(seen) OVER (PARTITION BY read, stage) AS ms FROM st), m2 AS (SELECT *, max(CASE WHEN seen = ms THEN length END) OVER (PARTITION BY read, stage) AS ml FROM m1),
 m3 AS (SELECT *, min(stage) OVER (PARTITION BY read) AS fs FROM m2 WHERE length = ml AND seen > 0),
 tk AS (SELECT read, tx, gene, CASE stage WHEN 0 THEN 'full' ELSE 'partial' END AS stage, length, junctions, seen FROM m3 WHERE stage = fs)"""

QUERIES = {
    "reads_to_transcripts": (taken, f"WITH {_FOUND} SELECT * FROM tk"),
    "gene_unique_reads": (counts, f"WITH {_FOUND} SELECT gene, count(*) AS reads FROM (SELECT read, min(gene) AS gene FROM tk GROUP BY read HAVING min(gene) = max(gene)) GROUP BY gene"),
    "read_report": (report, f"""WITH {_FOUND}, al2 AS (SELECT read, tx, sum(e - s + greatest(150 - gap, 0)) AS n FROM al GROUP BY read, tx), a3 AS (SELECT read, count(*) AS targets, max(n)::BIGINT AS bases FROM al2 GROUP BY read),
 rk AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY (contains(gene, '-') OR starts_with(gene, 'MIR'))::INT, gene, tx) AS i FROM tk),
 bz AS (SELECT read, any_value(stage) AS stage, min(gene) = max(gene) AS uniq, count(*) AS transcripts, any_value(gene) FILTER (i = 1) AS gene, any_value(tx) FILTER (i = 1) AS best, any_value(junctions) FILTER (i = 1) AS junctions, any_value(seen) FILTER (i = 1) AS seen FROM rk GROUP BY read)
 SELECT a3.read, targets, bases, stage, gene, uniq AS unique, transcripts, best, junctions, seen FROM a3 LEFT JOIN bz ON bz.read = a3.read"""),
    "genes_at_spots": (genes_at, """WITH sp AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey % 40 AS chrom, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e FROM lineitem),
 g AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'mir' WHEN c_custkey % 5 = 0 THEN 'A-' ELSE 'G' END || c_custkey % 30 AS gene, c_custkey % 40 AS chrom, c_custkey * 37 % 2500 AS s, c_custkey * 37 % 2500 + c_custkey % 90 + 10 AS e FROM customer),
 m AS (SELECT id, gene, max(g.e - g.s) AS n FROM sp JOIN g ON g.chrom = sp.chrom AND g.s < sp.e AND sp.s < g.e GROUP BY id, gene),
 o AS (SELECT id, string_agg(gene, ',' ORDER BY (contains(gene, '-') OR starts_with(upper(gene), 'MIR'))::INT, n DESC, gene) AS genes FROM m GROUP BY id) SELECT sp.id, coalesce(genes, '') AS genes FROM (SELECT id FROM sp) sp LEFT JOIN o USING (id)"""),
}
