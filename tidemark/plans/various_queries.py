"""GC bias by depth, k-mer tables, stitched and printed alignments, joined mates and files in numerical order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import psl, seq
from ..operators import coverage as cov
from ..operators import fileorder, kmers, reads
from ..operators import transcripts as tr
from ..tables import folder
from .views import DNA, QUAL, WIDTH, by_id, dna, qual, table

_CHUNK, _PIECE, _KNOWN, _BEST = 256, 40, 20, 50_000


def gc_depth(fragment, best):
    def run(spark, d):
        day = (F.datediff("l_shipdate", F.lit("1992-01-01")) % 997).cast("long")
        rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 1000).cast("string").alias("chrom"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
        chunks = seq.chunked(dna(spark, d).select(F.col("doc_id").cast("string").alias("name"), "seq"), _CHUNK)
        return cov.gc_depth(tr.from_intervals(by_id(rows), ["id", "chrom"]), chunks, _CHUNK, 20, fragment, 60, _KNOWN, best, 1, WIDTH)

    return run


def _gc_sql(fragment: bool, best: bool) -> str:
    cut = f"CASE WHEN substr(md5('1|' || id), 1, 1) < '8' THEN n % {_PIECE} ELSE 0 END" if fragment else "0"
    k, keep = (f"(r - o) // {_PIECE}", f"r >= o AND (r - o) // {_PIECE} < n // {_PIECE}") if fragment else ("0", "n >= 60")
    some = "JOIN top USING (chrom, pos)" if best else ""
    return f"""WITH {DNA}, b0 AS (SELECT DISTINCT id, pos FROM (SELECT l_orderkey AS id, unnest(range(s, s + q)) AS pos FROM (
   SELECT l_orderkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 997 AS s, l_quantity::BIGINT AS q FROM lineitem))),
 b1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY id) AS n FROM b0), b2 AS (SELECT *, {cut} AS o FROM b1),
 f AS MATERIALIZED (SELECT id, id % 1000 AS chrom, pos, {k} AS k FROM b2 WHERE {keep}),
 g AS (SELECT id, k, count(*) FILTER (c IN ('G', 'C')) AS gc, count(*) FILTER (c <> '') AS known FROM (SELECT id, k, substr(seq, pos + 1, 1) AS c FROM f JOIN dna ON doc_id = chrom) GROUP BY id, k HAVING count(*) FILTER (c <> '') >= {_KNOWN}),
 w AS MATERIALIZED (SELECT least(gc * 20 // known, 19) AS bin, chrom, pos FROM f JOIN g USING (id, k)),
 a AS (SELECT chrom, pos, count(*) AS depth FROM w GROUP BY 1, 2), h AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth DESC) AS run FROM a GROUP BY depth),
 top AS (SELECT chrom, pos FROM a JOIN h USING (depth) WHERE run <= {_BEST})
 SELECT bin::BIGINT AS bin, depth, count(*) AS bases FROM (SELECT bin, chrom, pos, count(*) AS depth FROM w GROUP BY 1, 2, 3) {some} GROUP BY 1, 2"""


def kmer_table(spark, d):
    rows = dna(spark, d)
    odd, even = (kmers.count(rows.where(F.col("doc_id") % 2 == k), "seq", 5, True) for k in (1, 0))
    return kmers.merged(kmers.zeros(spark, 5), odd, even)


def _blocks(spark, d):
    """Alignments of orders' lines to a target by ship day: two blocks each, four bases apart on the target and on the query only for even quantities."""
    q, day = F.col("l_quantity").cast("long"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    gap = F.when(q % 2 == 0, 4).otherwise(0).cast("long")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qName"), F.col("l_linestatus").alias("tName"), (day % 200).alias("t"), (day % 200).alias("q"), (q + 10).alias("n"), gap.alias("gap"))
    lines = lines.withColumn("strand", F.lit("+")).withColumn("qSize", F.lit(1000).cast("long"))
    both = lambda c: F.array(F.col(c), F.col(c) + F.col("n") + 4).alias
    return lines.select(
        "qName", "tName", "strand", "qSize", F.col("t").alias("tStart"), (F.col("t") + 2 * F.col("n") + 4).alias("tEnd"), F.col("q").alias("qStart"),
        F.array("n", "n").alias("blockSizes"), F.array(F.col("q"), F.col("q") + F.col("n") + F.col("gap")).alias("qStarts"), both("t")("tStarts"),
    )


def stitched(spark, d):
    got = psl.stitched(_blocks(spark, d).distinct())
    shown = F.transform(F.arrays_zip("tStarts", "qStarts", "blockSizes"), lambda b: F.concat_ws("-", b["tStarts"].cast("string"), b["qStarts"].cast("string"), b["blockSizes"].cast("string")))
    return got.select("qName", "tName", "entries", F.array_join(shown, ",").alias("blocks"))


def mates(spark, d):
    tiles = qual(spark, d).select("doc_id", F.explode(seq.tiles("qual", 80)).alias("t")).select("doc_id", "t.*").where(F.length("piece") == 80)
    joined = tiles.select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(" length=80")).alias("name"), F.expr("repeat('N', 80)").alias("seq"), F.col("piece").alias("qual"))
    got = reads.split_mates(joined, 40)
    return got.groupBy("name", "mate").agg(F.count("*").alias("n"), F.min("qual").alias("least"), F.max("qual").alias("greatest"))


def in_number_order(spark, d):
    path = folder(spark, "numbered")
    rows = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    sinks.write_lines(rows.repartitionByRange(12, "o_orderkey").sortWithinPartitions("o_orderkey").select("value"), path)
    return fileorder.concatenated(spark, path, r"^part-(\d+)-")


def printed(spark, d):
    """Each document against itself less four letters after the first half, in lines of 50 columns."""
    half = F.floor(F.length("seq") / 2).cast("long")
    rows = dna(spark, d).where(F.length("seq") >= 20).withColumn("h", half).withColumn("query", F.concat(F.substr("seq", F.lit(1), F.col("h").cast("int")), F.substr("seq", (F.col("h") + 5).cast("int"))))
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"blockSizes": F.array("h", F.length("seq") - F.col("h") - 4), "qStarts": F.array(zero, F.col("h")), "tStarts": F.array(zero, F.col("h") + 4)})
    lines = psl.printed(psl.alignment_strings(F.col("query"), F.col("seq")), 50)
    return rows.select("doc_id", F.posexplode(lines).alias("line", "x")).select("doc_id", F.col("line").cast("long").alias("line"), "x.q", "x.marks", "x.t")


QUERIES = {
    "gc_depth": (gc_depth(None, None), _gc_sql(False, False)),
    "gc_depth_fragments": (gc_depth(_PIECE, None), _gc_sql(True, False)),
    "gc_depth_best_covered": (gc_depth(_PIECE, _BEST), _gc_sql(True, True)),
    "kmer_table_with_zeros": (kmer_table, f"""WITH {DNA}, l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), z AS (SELECT a.c || b.c || x.c || y.c || v.c AS kmer FROM l a, l b, l x, l y, l v),
 k AS (SELECT substr(seq, i, 5) AS s FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM dna)), b AS (SELECT s AS kmer, count(*) AS n FROM (SELECT s FROM k UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')) FROM k) GROUP BY s)
 SELECT kmer, coalesce(n, 0) AS n FROM z LEFT JOIN b USING (kmer)"""),
    "stitched_query_alignments": (stitched, """WITH a0 AS (SELECT DISTINCT l_orderkey AS q, l_linestatus AS c, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 200 AS s, l_quantity::BIGINT + 10 AS n, CASE WHEN l_quantity::BIGINT % 2 = 0 THEN 4 ELSE 0 END AS gap FROM lineitem),
 a AS (SELECT *, row_number() OVER w AS i, coalesce(max(s + 2 * n + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM a0 WINDOW w AS (PARTITION BY q, c ORDER BY s, s + 2 * n + 4, gap)),
 b AS (SELECT q, c, i, greatest(t, far) AS t, x + greatest(t, far) - t AS x, n - greatest(far - t, 0) AS n FROM (SELECT q, c, i, far, s AS t, s AS x, n FROM a UNION ALL SELECT q, c, i, far, s + n + 4, s + n + gap, n FROM a) WHERE t + n > far),
 f AS (SELECT *, CASE WHEN lag(t + n) OVER w = t AND lag(x + n) OVER w = x THEN 0 ELSE 1 END AS f FROM b WINDOW w AS (PARTITION BY q, c ORDER BY i, t)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY q, c ORDER BY i, t ROWS UNBOUNDED PRECEDING) AS k FROM f), h AS (SELECT q, c, k, min(t) AS t, min(x) AS x, sum(n) AS n FROM g GROUP BY q, c, k)
 SELECT q AS qName, c AS tName, e.n AS entries, string_agg(t || '-' || x || '-' || h.n::BIGINT, ',' ORDER BY k) AS blocks FROM h JOIN (SELECT q, c, count(DISTINCT i) AS n FROM b GROUP BY q, c) e USING (q, c) GROUP BY q, c, e.n"""),
    "split_joined_mates": (mates, f"""WITH {QUAL}, t AS (SELECT doc_id, substr(qual, i::BIGINT * 80 + 1, 80) AS p FROM qual, unnest(range(0, length(qual) // 80)) r(i)),
 m AS (SELECT doc_id, 1 AS mate, substr(p, 1, 40) AS h FROM t UNION ALL SELECT doc_id, 2, substr(p, 41, 40) FROM t)
 SELECT 'r' || doc_id || ' length=40' AS name, mate, count(*) AS n, min(h) AS least, max(h) AS greatest FROM m GROUP BY 1, 2"""),
    "files_by_number": (in_number_order, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey || '|' || o_orderstatus AS value FROM orders"),
    "printed_alignments": (printed, f"""WITH {DNA}, p AS (SELECT doc_id, seq AS t, left(seq, h) || '----' || substr(seq, h + 5) AS q, left(repeat('|', length(seq)), h) || '    ' || repeat('|', length(seq) - h - 4) AS m FROM (SELECT doc_id, seq, length(seq) // 2 AS h FROM dna WHERE length(seq) >= 20))
 SELECT doc_id, i AS line, substr(q, i * 50 + 1, 50) AS q, substr(m, i * 50 + 1, 50) AS marks, substr(t, i * 50 + 1, 50) AS t FROM p, unnest(range(0, (length(t) + 49) // 50)) r(i)"""),
}
