"""Assembly, mappability and depth queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import kmers
from .views import DNA, WIDTH, dna, iv_sql, table
from .views import iv as ivs

_K, _OFTEN, _LEAST = 14, 10, 8


def contigs(spark, d):
    letters = table(spark, d, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return kmers.assembled(kmers.frequent(dna(spark, d), "seq", _K, _OFTEN, letters=letters), _LEAST)


def mappability(strands):
    def run(spark, d):
        return kmers.mappability(dna(spark, d), 20, strands, 512, "doc_id")

    return run


def ladder(spark, d):
    got = cov.ladder(ivs(spark, d, "l_partkey"), 3, 40, WIDTH)
    return got.select("chrom", "level", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("exons"))


def novel(spark, d):
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("chrom"), (F.col("p_size") * 40).cast("long").alias("s"), (F.col("p_size") * 40 + 300).cast("long").alias("e"))
    got = cov.novel(ivs(spark, d, "l_partkey").select("chrom", "s", "e", "id"), known, 3, 40, WIDTH)
    return got.select("chrom", "level", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("exons"))


def thinned(spark, d):
    hits = ivs(spark, d).select("id", "chrom", "s", "e", F.col("w").alias("n"))
    return cov.thinned(hits, 40, 7, WIDTH).select("id", "least", "kept")


_SEG = """ev AS (SELECT chrom, s AS pos, {w} AS d FROM {t} WHERE s < e UNION ALL SELECT chrom, e, -{w} FROM {t} WHERE s < e),
 p AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY 1, 2), r AS (SELECT chrom, pos AS s, lead(pos) OVER c AS e, sum(d) OVER c AS depth FROM p WHERE d <> 0 WINDOW c AS (PARTITION BY chrom ORDER BY pos)),
 seg AS MATERIALIZED (SELECT chrom, s, e, depth::BIGINT AS depth FROM r WHERE e IS NOT NULL AND depth > 0)"""


def _chained(gap: int, far: int) -> str:
    isl = lambda t, keys, g: f"(SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {g} THEN 1 ELSE 0 END AS f FROM {t}))"
    return f"""lv AS (SELECT chrom, s, e, unnest(list_transform(range(0, floor(log2(depth) + 1e-9)::BIGINT + 1), lambda k: (2 ** k)::BIGINT)) AS level FROM seg),
 ex AS (SELECT chrom, level, min(s) AS s, max(e) AS e FROM {isl('lv', 'chrom, level', gap)} GROUP BY chrom, level, k)
 SELECT chrom, level, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM {isl('ex', 'chrom, level', far)} GROUP BY chrom, level, k"""


_RUNS = f"""WITH {DNA}, w AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, substr(seq, i, 20) AS s FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 18)) AS i FROM dna)),
 c AS MATERIALIZED (SELECT s, count(*) AS n FROM w GROUP BY s), g AS (SELECT doc_id, pos, c.n FROM w JOIN c USING (s)),
 f AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM g), k AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, min(n)::BIGINT AS n FROM k GROUP BY doc_id, k"""


_CONTIGS = f"""WITH RECURSIVE {DNA}, km AS MATERIALIZED (SELECT s, count(*) AS n FROM (SELECT substr(seq, i, {_K}) AS s FROM (SELECT seq, unnest(range(1, length(seq) - {_K} + 2)) AS i FROM dna)) GROUP BY s HAVING count(*) >= {_OFTEN}),
 o AS (SELECT unnest(range({_LEAST}, {_K})) AS o), ov AS MATERIALIZED (SELECT a.s AS a, b.s AS b, o FROM (SELECT s, o, right(s, o) AS p FROM km, o) a JOIN (SELECT s, o, left(s, o) AS p FROM km, o) b USING (o, p) WHERE a.s <> b.s),
 ra AS (SELECT a, o, any_value(b) AS b FROM ov JOIN (SELECT a, max(o) AS o FROM ov GROUP BY a) USING (a, o) GROUP BY a, o HAVING count(*) = 1),
 lb AS (SELECT b, o, any_value(a) AS a FROM ov JOIN (SELECT b, max(o) AS o FROM ov GROUP BY b) USING (b, o) GROUP BY b, o HAVING count(*) = 1),
 e AS MATERIALIZED (SELECT a, b, o FROM ra JOIN lb USING (a, b, o)),
 back(x, y) AS (SELECT s, s FROM km UNION SELECT x, a FROM back JOIN e ON e.b = y),
 least AS (SELECT x, min(y) AS low, bool_or(y NOT IN (SELECT b FROM e)) AS headed FROM back GROUP BY x),
 heads AS (SELECT s FROM km WHERE s NOT IN (SELECT b FROM e) UNION SELECT low FROM least WHERE NOT headed),
 walk(head, s, text, i) AS (SELECT s, s, s, 1 FROM heads UNION ALL SELECT head, e.b, text || substr(e.b, e.o + 1), i + 1 FROM walk JOIN e ON e.a = walk.s WHERE e.b <> head)
 SELECT arg_max(text, i) AS contig, count(*) AS kmers, sum(n)::BIGINT AS n FROM walk JOIN km USING (s) GROUP BY head"""

QUERIES = {
    "kmer_contigs": (contigs, _CONTIGS),
    "mappability_runs": (mappability(False), _RUNS),
    "mappability_both_strands": (mappability(True), f"""WITH {DNA}, w AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, substr(seq, i, 20) AS s FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 18)) AS i FROM dna)),
 c0 AS MATERIALIZED (SELECT s, count(*) AS n, reverse(translate(s, 'ACGT', 'TGCA')) AS t FROM w GROUP BY s), c AS MATERIALIZED (SELECT a.s, a.n + CASE WHEN a.s = a.t THEN 0 ELSE coalesce(b.n, 0) END AS n FROM c0 a LEFT JOIN c0 b ON b.s = a.t),
 g AS (SELECT doc_id, pos, n FROM w JOIN c USING (s)), f AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM g),
 k AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, min(n)::BIGINT AS n FROM k GROUP BY doc_id, k"""),
    "depth_ladder": (ladder, f"WITH {iv_sql('l_partkey')}, {_SEG.format(t='iv', w='1')}, {_chained(3, 40)}"),
    "novel_regions": (novel, f"""WITH {iv_sql('l_partkey')}, far AS (SELECT * FROM iv ANTI JOIN (SELECT p_partkey AS pk, (p_size * 40)::BIGINT AS ps, (p_size * 40 + 300)::BIGINT AS pe FROM part WHERE p_size > 10) ON pk = chrom AND ps < e AND s < pe),
 {_SEG.format(t='far', w='1')}, {_chained(3, 40)}"""),
    "thinned_hits": (thinned, f"""WITH {iv_sql()}, {_SEG.format(t='iv', w='w')}, n AS (SELECT *, row_number() OVER () AS i FROM iv), u AS (SELECT i, id, w, min(depth) AS least FROM n LEFT JOIN seg ON seg.chrom = n.chrom AND seg.s < n.e AND n.s < seg.e GROUP BY i, id, w)
 SELECT id, least, CASE WHEN coalesce(least, 0) <= 40 THEN w ELSE len(list_filter(range(1, w + 1), lambda k: ('0x' || substr(md5('7|' || id || '|' || k), 1, 8))::BIGINT * least < 40 * 4294967296)) END::BIGINT AS kept FROM u"""),
}
