"""Interval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranges
from ..operators import coverage as cov
from ..operators import graph
from ..operators import intervals as iv
from ..operators import transcripts as tr
from .views import TX_EXONS, WIDTH, iv_sql, table, tx
from .views import iv as ivs

_SWEEP = """ev AS (SELECT chrom, s AS pos, {w} AS d FROM {t} WHERE s < e UNION ALL SELECT chrom, e, -{w} FROM {t} WHERE s < e),
 p AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY 1, 2), r AS (SELECT chrom, pos AS s, lead(pos) OVER c AS e, sum(d) OVER c AS depth FROM p WHERE d <> 0 WINDOW c AS (PARTITION BY chrom ORDER BY pos)),
 seg AS (SELECT chrom, s, e, depth::BIGINT AS depth FROM r WHERE e IS NOT NULL AND depth > 0)"""


def _islands(t: str, cond: str, keys: str = "chrom") -> str:
    return f"""fl AS (SELECT *, CASE WHEN {cond} THEN 1 ELSE 0 END AS f FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {t})),
 isl AS (SELECT {keys}, s, e, sum(f) OVER (PARTITION BY {keys} ORDER BY s, e, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM fl),
 loci AS (SELECT {keys}, min(s) AS s, max(e) AS e, count(*) AS n FROM isl GROUP BY {keys}, k)"""


def coverage(spark, d):
    return iv.coverage(ivs(spark, d), width=WIDTH)


def weighted_coverage(spark, d):
    return iv.coverage(ivs(spark, d), weight="w", min_depth=3, width=WIDTH)


def merged(gap, touch, chrom="l_partkey", keys=("chrom",)):
    def run(spark, d):
        return iv.merge(ivs(spark, d, chrom), list(keys), gap, touch, WIDTH)

    return run


def locus_of_each(spark, d):
    got = iv.islands(ivs(spark, d, "l_partkey").select("chrom", "s", "e", "id"), ["chrom"], 5, True, WIDTH, ["id"])
    return got.groupBy("chrom", "island").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("e").alias("e")).drop("island")


def _sets(spark, d):
    rows = ivs(spark, d, "l_partkey")
    return rows.where("strand = 'O'"), rows.where("strand = 'F'")


_TWO = f"""{iv_sql('l_partkey')}, ev AS (SELECT chrom, s AS pos, CASE strand WHEN 'O' THEN 1 ELSE 0 END AS a, CASE strand WHEN 'F' THEN 1 ELSE 0 END AS b FROM iv
   UNION ALL SELECT chrom, e, CASE strand WHEN 'O' THEN -1 ELSE 0 END, CASE strand WHEN 'F' THEN -1 ELSE 0 END FROM iv),
 p AS (SELECT chrom, pos, sum(a) AS a, sum(b) AS b FROM ev GROUP BY 1, 2),
 r AS (SELECT chrom, pos AS s, lead(pos) OVER c AS e, sum(a) OVER c AS a, sum(b) OVER c AS b FROM p WINDOW c AS (PARTITION BY chrom ORDER BY pos))"""


def subtract(spark, d):
    return iv.subtract(*_sets(spark, d), width=WIDTH)


def intersect(spark, d):
    return iv.intersect(*_sets(spark, d), width=WIDTH)


def union(spark, d):
    return iv.union(*_sets(spark, d), width=WIDTH)


def complement(spark, d):
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chrom"), F.lit(4000).cast("long").alias("length"))
    return iv.complement(ivs(spark, d), lengths, WIDTH)


def pad(spark, d):
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chrom"), F.lit(2500).cast("long").alias("length"))
    return iv.pad(ivs(spark, d), 1200, lengths).select("id", "chrom", "s", "e")


def tiles(spark, d):
    return iv.tile(ivs(spark, d).select("id", "s", "e"), 8)


def overlap_pairs(spark, d):
    a, b = _sets(spark, d)
    return iv.overlap_join(a.select("chrom", "s", "e", "id"), b.select("chrom", "s", "e", "id"), width=WIDTH).select("a_id", "b_id", "bp")


def reciprocal(spark, d):
    a, b = _sets(spark, d)
    both = (F.col("bp") >= 0.5 * (F.col("a_e") - F.col("a_s"))) & (F.col("bp") >= 0.5 * (F.col("b_e") - F.col("b_s")))
    return iv.overlap_join(a.select("chrom", "s", "e", "id"), b.select("chrom", "s", "e", "id"), width=WIDTH, where=both).select("a_id", "b_id", "bp")


def overlap_how(how, slack=0):
    def run(spark, d):
        a, b = _sets(spark, d)
        return iv.overlap_join(a.select("chrom", "s", "e", "id"), b.select("chrom", "s", "e", "id"), how=how, slack=slack, width=WIDTH).select("id", "s", "e")

    return run


def overlap_left(spark, d):
    a, b = _sets(spark, d)
    return iv.overlap_join(a.select("chrom", "s", "e", "id"), b.select("chrom", "s", "e", "id"), how="left", width=WIDTH).groupBy("a_id").agg(F.count("b_id").alias("n"), F.coalesce(F.sum("bp"), F.lit(0)).alias("bp"))


def nearest(spark, d):
    a, b = _sets(spark, d)
    return iv.nearest(a.select("chrom", "s", "e", "id").distinct(), b.select("chrom", "s", "e", "id"), width=WIDTH).select("a_id", "b_id", F.col("distance").cast("long"))


def cogroup(spark, d):
    a, b = _sets(spark, d)
    return iv.cogroup_loci({"open": a, "done": b}, width=WIDTH)


def scalar_functions(spark, d):
    rows = ivs(spark, d)
    a = rows.where("w = 1").select("tx", F.col("chrom").alias("c1"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = rows.where("w = 2").select("tx", F.floor(F.col("chrom") / 3).alias("c2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    x = a.withColumn("c1", F.floor(F.col("c1") / 3)).join(b, "tx")
    args = [F.col(c) for c in ("c1", "s1", "e1", "c2", "s2", "e2")]
    return x.select("tx", ranges.overlaps(*args, 5).alias("near"), ranges.overlap_size(*args).cast("long").alias("bp"), ranges.adjacent(*args).alias("adjacent"), ranges.distance(*args).cast("long").alias("distance"), ranges.compare(*args).cast("long").alias("cmp"), F.size(iv.multi_subtract_one(*args[1:3], *args[4:])).cast("long").alias("pieces"))


def transcript_depth(spark, d):
    depth = iv.coverage(tx(spark, d).select("chrom", F.explode("exons").alias("x")).select("chrom", "x.s", "x.e"), width=WIDTH)
    exons = tx(spark, d).select(F.col("id").alias("tx"), "chrom", F.explode("exons").alias("x")).select("tx", "chrom", "x.s", "x.e")
    return cov.transcript_depth(exons, depth, 2, WIDTH)


def overlap_bias(spark, d):
    a, b = _sets(spark, d)
    cut = lambda x: iv.coverage(x.withColumn("chrom", F.pmod("chrom", F.lit(50))), width=WIDTH)
    return cov.overlap_bias(cut(a), cut(b), [1, 2, 4, 8], WIDTH)


def background(spark, d):
    regions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chrom"), F.lit(0).cast("long").alias("s"), F.lit(4000).cast("long").alias("e"))
    a, b = _sets(spark, d)
    genes = ivs(spark, d).where("strand = 'F'").select("chrom", "s", "e")
    depth = iv.coverage(ivs(spark, d).where("strand = 'O'"), width=WIDTH)
    return cov.background(regions, genes, depth, 10, 50, WIDTH)


def annotate(spark, d):
    t = tx(spark, d)
    return tr.annotate(t.where("id % 10 <> 0"), t.where("id % 10 = 0"), width=WIDTH).select("a_id", "b_id", "bp", F.col("consecutive").cast("long"), F.col("n_match").cast("long"), "full")


def compatible(spark, d):
    t = tx(spark, d)
    return tr.compatible(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 40)


def merge_isoforms(spark, d):
    t = tx(spark, d)
    snapped = F.transform("exons", lambda x: F.struct(F.floor(x["s"] / 500).alias("s"), (F.floor(x["e"] / 500) + 1).alias("e")))
    return tr.merge_by_junctions(t.select(F.pmod("chrom", F.lit(3)).alias("chrom"), snapped.alias("exons")))


def smooth_exons(spark, d):
    t = tx(spark, d).select("id", tr.smooth("exons", 100).alias("x"), tr.size("exons").alias("bp"))
    return t.select("id", "bp", F.size("x").cast("long").alias("n"), tr.size("x").alias("smooth_bp"))


def smooth_sql() -> str:
    return f"""WITH {TX_EXONS}, sf AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY id ORDER BY s) >= 100 THEN 1 ELSE 0 END AS f FROM ex),
 sk AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM sf), sm AS (SELECT id, k, max(e) - min(s) AS n FROM sk GROUP BY 1, 2)
 SELECT a.id, bp::BIGINT AS bp, n::BIGINT AS n, smooth_bp::BIGINT AS smooth_bp FROM (SELECT id, sum(e - s) AS bp FROM ex GROUP BY 1) a JOIN (SELECT id, count(*) AS n, sum(n) AS smooth_bp FROM sm GROUP BY 1) b USING (id)"""


def consensus(spark, d):
    """Order lines by part as a group, their line number as the junction: the most frequent day and length class."""
    rows = ivs(spark, d, "l_partkey").select(F.col("chrom").alias("grp"), F.col("w").alias("j"), F.floor(F.col("s") / 300).alias("l"), F.floor(F.col("e") / 300).alias("r"))
    return tr.consensus(rows)


def correct_junctions(spark, d):
    rows = ivs(spark, d, "l_partkey")
    long = rows.where("strand = 'O'").select("id", "chrom", F.col("s").alias("l"), F.col("e").alias("r"))
    short = rows.where("strand = 'F'").groupBy("chrom", F.col("s").alias("l"), F.col("e").alias("r")).agg(F.count("*").alias("n"))
    return tr.correct_junctions(long, short, 60)


def unsupported(spark, d):
    t = tx(spark, d)
    snapped = F.transform("exons", lambda x: F.struct(F.floor(x["s"] / 150).alias("s"), F.floor(x["e"] / 150).alias("e")))
    t = t.select("id", F.pmod("id", F.lit(2)).alias("chrom"), snapped.alias("exons"))
    return tr.unsupported_pairs(t.where("id % 10 > 1"), t.where("id % 10 <= 1")).select("id", "l1", "r1", "l2", "r2")


def components(spark, d):
    o = table(spark, d, "orders")
    return graph.connected_components(o.select(F.col("o_custkey").alias("a"), (F.pmod("o_custkey", F.lit(37)) + F.col("o_orderkey") % 11 + 1000000).alias("b")))


def roots(spark, d):
    o = table(spark, d, "orders")
    return graph.roots(o.select(F.col("o_custkey").alias("a"), (2 * F.floor(F.col("o_orderkey") / 7)).alias("b")))


_OVER = "a.chrom = b.chrom AND a.s < b.e AND b.s < a.e"
_AB = f"{iv_sql('l_partkey')}, a AS (SELECT * FROM iv WHERE strand = 'O'), b AS (SELECT * FROM iv WHERE strand = 'F')"
_BP = "least(a.e, b.e) - greatest(a.s, b.s)"
_SNAP = "sum(f) OVER (PARTITION BY id ORDER BY s ROWS UNBOUNDED PRECEDING)"
_JUNC = """jx AS (SELECT id, chrom, s, e, row_number() OVER (PARTITION BY id ORDER BY s) AS i, count(*) OVER (PARTITION BY id) AS nx FROM {t}),
 jn AS (SELECT x.id, x.chrom, x.i, x.nx, x.e AS l, y.s AS r FROM jx x JOIN jx y ON x.id = y.id AND y.i = x.i + 1)"""

QUERIES = {
    "interval_coverage": (coverage, f"WITH {iv_sql()}, {_SWEEP.format(t='iv', w='1')} SELECT * FROM seg"),
    "weighted_coverage": (weighted_coverage, f"WITH {iv_sql()}, {_SWEEP.format(t='iv', w='w')} SELECT * FROM seg WHERE depth >= 3"),
    "interval_merge": (merged(0, True), f"WITH {iv_sql('l_partkey')}, {_islands('iv', 's > far')} SELECT chrom, s, e, n FROM loci"),
    "locus_groups_overlap_only": (merged(0, False), f"WITH {iv_sql('l_partkey')}, {_islands('iv', 's >= far')} SELECT chrom, s, e, n FROM loci"),
    "loci_min_distance": (merged(30, True), f"WITH {iv_sql('l_partkey')}, {_islands('iv', 's > far + 30')} SELECT chrom, s, e, n FROM loci"),
    "loci_stranded": (merged(10, True, keys=("chrom", "strand")), f"WITH {iv_sql('l_partkey')}, {_islands('iv', 's > far + 10', 'chrom, strand')} SELECT chrom, strand, s, e, n FROM loci"),
    "locus_assignment": (locus_of_each, f"""WITH {iv_sql('l_partkey')}, fl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1 ELSE 0 END AS f FROM iv),
 k AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY s, e, id, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM fl) SELECT chrom, count(*) AS n, min(id) AS first_id, max(e) AS e FROM k GROUP BY chrom, k"""),
    "interval_subtract": (subtract, f"WITH {_TWO}, t AS (SELECT * FROM r WHERE e IS NOT NULL AND a > 0 AND b = 0), {_islands('t', 's > far')} SELECT chrom, s, e FROM loci"),
    "interval_intersect": (intersect, f"WITH {_TWO}, t AS (SELECT * FROM r WHERE e IS NOT NULL AND a > 0 AND b > 0), {_islands('t', 's > far')} SELECT chrom, s, e FROM loci"),
    "interval_union": (union, f"WITH {_TWO}, t AS (SELECT * FROM r WHERE e IS NOT NULL AND (a > 0 OR b > 0)), {_islands('t', 's > far')} SELECT chrom, s, e FROM loci"),
    "interval_complement": (complement, f"""WITH {iv_sql()}, {_islands('iv', 's > far')}, edges AS (SELECT s_suppkey AS chrom, 0::BIGINT AS e FROM supplier UNION ALL SELECT chrom, e FROM loci),
 ends AS (SELECT s_suppkey AS chrom, 4000::BIGINT AS s FROM supplier UNION ALL SELECT chrom, s FROM loci),
 x AS (SELECT chrom, e, row_number() OVER (PARTITION BY chrom ORDER BY e) AS k FROM edges), y AS (SELECT chrom, s, row_number() OVER (PARTITION BY chrom ORDER BY s) AS k FROM ends)
 SELECT x.chrom, x.e AS s, y.s AS e FROM x JOIN y USING (chrom, k) WHERE x.e < y.s"""),
    "interval_pad": (pad, f"WITH {iv_sql()} SELECT id, chrom, greatest(s - 1200, 0)::BIGINT AS s, least(e + 1200, 2500)::BIGINT AS e FROM iv"),
    "window_tiles": (tiles, f"WITH {iv_sql()} SELECT id, s + k * 8 AS s, s + k * 8 + 8 AS e FROM iv, generate_series(0, 10) g(k) WHERE s + k * 8 + 8 <= e"),
    "overlap_join_bp": (overlap_pairs, f"WITH {_AB} SELECT a.id AS a_id, b.id AS b_id, {_BP} AS bp FROM a JOIN b ON {_OVER}"),
    "reciprocal_overlap": (reciprocal, f"WITH {_AB} SELECT a.id AS a_id, b.id AS b_id, {_BP} AS bp FROM a JOIN b ON {_OVER} AND {_BP} >= 0.5 * (a.e - a.s) AND {_BP} >= 0.5 * (b.e - b.s)"),
    "overlap_semi": (overlap_how("left_semi"), f"WITH {_AB} SELECT id, s, e FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_OVER})"),
    "overlap_anti": (overlap_how("left_anti", 15), f"WITH {_AB} SELECT id, s, e FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.s - 15 < b.e AND b.s < a.e + 15)"),
    "overlap_left_outer": (overlap_left, f"WITH {_AB} SELECT a.id AS a_id, count(b.id) AS n, coalesce(sum({_BP}) FILTER (b.id IS NOT NULL), 0)::BIGINT AS bp FROM a LEFT JOIN b ON {_OVER} GROUP BY a.id"),
    "nearest_interval": (nearest, f"""WITH {_AB}, q AS (SELECT DISTINCT chrom, s, e, id FROM a), m AS (SELECT q.id AS a_id, q.chrom, q.s, q.e, b.id AS b_id, b.s AS bs,
 CASE WHEN q.s < b.e AND b.s < q.e THEN 0 WHEN b.s >= q.e THEN b.s - q.e + 1 ELSE q.s - b.e + 1 END AS distance FROM q LEFT JOIN b ON q.chrom = b.chrom)
 SELECT a_id, b_id, distance::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id, chrom, s, e ORDER BY distance, bs, b_id) AS k FROM m) WHERE k = 1"""),
    "multiway_locus_cogroup": (cogroup, f"""WITH {iv_sql('l_partkey')}, fl AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY chrom ORDER BY s, e, strand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM iv),
 k AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY s, e, strand, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM fl)
 SELECT chrom, min(s) AS s, max(e) AS e, count(*) FILTER (strand = 'O') AS n_open, count(*) FILTER (strand = 'F') AS n_done FROM k GROUP BY chrom, k"""),
    "range_functions": (scalar_functions, f"""WITH {iv_sql()}, x AS (SELECT a.tx, floor(a.chrom / 3) AS c1, a.s AS s1, a.e AS e1, floor(b.chrom / 3) AS c2, b.s AS s2, b.e AS e2 FROM iv a JOIN iv b ON a.tx = b.tx AND a.w = 1 AND b.w = 2)
 SELECT tx, c1 = c2 AND s1 < e2 + 5 AND greatest(s2 - 5, 0) < e1 AS near, CASE WHEN c1 = c2 THEN greatest(least(e1, e2) - greatest(s1, s2), 0) ELSE 0 END::BIGINT AS bp, c1 = c2 AND (e1 = s2 OR e2 = s1) AS adjacent,
 CASE WHEN c1 <> c2 THEN -1 WHEN s1 < e2 AND s2 < e1 THEN 0 WHEN e1 <= s2 THEN s2 - e1 + 1 ELSE s1 - e2 + 1 END::BIGINT AS distance,
 CASE WHEN c1 = c2 AND s1 < e2 AND s2 < e1 THEN 0 WHEN c1 < c2 OR (c1 = c2 AND s1 < s2) THEN -1 ELSE 1 END::BIGINT AS cmp,
 CASE WHEN s2 >= e1 OR e2 <= s1 THEN 1 ELSE (CASE WHEN s1 < s2 THEN 1 ELSE 0 END) + (CASE WHEN e2 < e1 THEN 1 ELSE 0 END) END::BIGINT AS pieces FROM x"""),
    "transcript_depth": (transcript_depth, f"""WITH {TX_EXONS}, {_SWEEP.format(t='ex', w='1')}, m AS (SELECT a.id, least(a.e, b.e) - greatest(a.s, b.s) AS bp, b.depth FROM ex a JOIN seg b ON {_OVER})
 SELECT x.id AS tx, x.n::BIGINT AS length, coalesce(sum(bp), 0)::BIGINT AS covered, round(coalesce(sum(bp * depth), 0) / x.n, 6) AS mean_depth, round(coalesce(sum(bp) FILTER (depth >= 2), 0) / x.n, 6) AS fraction
 FROM (SELECT id, sum(e - s) AS n FROM ex GROUP BY 1) x LEFT JOIN m USING (id) GROUP BY x.id, x.n"""),
    "overlap_bias_by_threshold": (overlap_bias, f"""WITH {iv_sql('l_partkey')}, o AS (SELECT chrom % 50 AS chrom, s, e FROM iv WHERE strand = 'O'), f AS (SELECT chrom % 50 AS chrom, s, e FROM iv WHERE strand = 'F'),
 oe AS (SELECT chrom, s AS pos, 1 AS d FROM o UNION ALL SELECT chrom, e, -1 FROM o), op AS (SELECT chrom, pos, sum(d) AS d FROM oe GROUP BY 1, 2), a AS (SELECT chrom, pos AS s, lead(pos) OVER c AS e, sum(d) OVER c AS depth FROM op WINDOW c AS (PARTITION BY chrom ORDER BY pos)),
 fe AS (SELECT chrom, s AS pos, 1 AS d FROM f UNION ALL SELECT chrom, e, -1 FROM f), fp AS (SELECT chrom, pos, sum(d) AS d FROM fe GROUP BY 1, 2), b AS (SELECT chrom, pos AS s, lead(pos) OVER c AS e, sum(d) OVER c AS depth FROM fp WINDOW c AS (PARTITION BY chrom ORDER BY pos)),
 t AS (SELECT unnest([1, 2, 4, 8])::INTEGER AS t), g AS (SELECT x.t AS ta, y.t AS tb FROM t x, t y WHERE y.t <= x.t),
 sz AS (SELECT t AS ta, sum(e - s) AS size_a FROM a, t WHERE depth >= t GROUP BY 1), c AS (SELECT a.depth AS da, b.depth AS db, sum({_BP}) AS bp FROM a JOIN b ON {_OVER} AND a.depth > 0 AND b.depth > 0 GROUP BY 1, 2)
 SELECT g.ta, g.tb, sz.size_a::BIGINT AS size_a, coalesce(sum(bp), 0)::BIGINT AS overlap, round(1 - coalesce(sum(bp), 0) / sz.size_a, 6) AS bias FROM g JOIN sz USING (ta) LEFT JOIN c ON c.da >= g.ta AND c.db >= g.tb GROUP BY g.ta, g.tb, sz.size_a"""),
    "background_windows": (background, f"""WITH {iv_sql()}, g AS (SELECT chrom, greatest(s - 10, 0) AS s, e + 10 AS e FROM iv WHERE strand = 'F'), {_islands('g', 's > far')}, edges AS (SELECT s_suppkey AS chrom, 0::BIGINT AS e FROM supplier UNION ALL SELECT chrom, e FROM loci),
 ends AS (SELECT s_suppkey AS chrom, 4000::BIGINT AS s FROM supplier UNION ALL SELECT chrom, s FROM loci),
 x AS (SELECT chrom, e, row_number() OVER (PARTITION BY chrom ORDER BY e) AS k FROM edges), y AS (SELECT chrom, s, row_number() OVER (PARTITION BY chrom ORDER BY s) AS k FROM ends),
 free AS (SELECT x.chrom, x.e AS s, y.s AS e FROM x JOIN y USING (chrom, k) WHERE x.e < y.s), a AS (SELECT chrom, s + k * 50 AS s, s + k * 50 + 50 AS e FROM free, generate_series(0, 100) t(k) WHERE s + k * 50 + 50 <= e),
 o AS (SELECT * FROM iv WHERE strand = 'O') SELECT a.chrom, a.s, a.e, round(coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) FILTER (b.s IS NOT NULL), 0) / 50, 6) AS mean_depth FROM a LEFT JOIN o b ON {_OVER} GROUP BY 1, 2, 3"""),
    "annotate_reads": (annotate, f"""WITH {TX_EXONS}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS i FROM ex WHERE id % 10 <> 0), t AS (SELECT * FROM ex WHERE id % 10 = 0),
 p AS (SELECT a.id AS a_id, b.id AS b_id, sum({_BP}) AS bp FROM q a JOIN t b ON {_OVER} GROUP BY 1, 2), na AS (SELECT id, count(*) AS n FROM ex GROUP BY 1),
 fl AS (SELECT p.a_id, p.b_id, p.bp, a.i, EXISTS (SELECT 1 FROM t b WHERE b.id = p.b_id AND a.s < b.e AND b.s < a.e) AS hit FROM p JOIN q a ON a.id = p.a_id),
 rn AS (SELECT *, i - row_number() OVER (PARTITION BY a_id, b_id, hit ORDER BY i) AS run FROM fl), rl AS (SELECT a_id, b_id, bp, hit, run, count(*) AS n FROM rn GROUP BY ALL),
 s AS (SELECT a_id, b_id, bp, max(n) FILTER (hit) AS consecutive, sum(n) FILTER (hit) AS n_match FROM rl GROUP BY 1, 2, 3),
 f AS (SELECT s.*, x.n = y.n AND n_match = x.n AS "full" FROM s JOIN na x ON x.id = s.a_id JOIN na y ON y.id = s.b_id)
 SELECT a_id, b_id, bp::BIGINT AS bp, consecutive::BIGINT AS consecutive, n_match::BIGINT AS n_match, "full" FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY "full" DESC, consecutive DESC, n_match DESC, bp DESC, b_id) AS k FROM f) WHERE k = 1"""),
    "compatible_junction_join": (compatible, f"""WITH {TX_EXONS}, {_JUNC.format(t='ex')}, ju AS (SELECT * FROM jn)
 SELECT a.id AS a_id, b.id AS b_id FROM ju a JOIN ju b ON a.chrom = b.chrom AND a.nx = b.nx AND a.i = b.i AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.l - b.l) <= 40 AND abs(a.r - b.r) <= 40 GROUP BY 1, 2 HAVING count(*) = max(a.nx) - 1"""),
    "merge_isoforms": (merge_isoforms, f"""WITH {TX_EXONS}, sn AS (SELECT id, chrom % 3 AS chrom, s AS o, floor(s / 500)::BIGINT AS s, floor(e / 500)::BIGINT + 1 AS e FROM ex), j AS (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY o) AS nx FROM sn),
 t AS (SELECT id, chrom, string_agg(chrom || ':' || e || '-' || nx, ',' ORDER BY o) FILTER (nx IS NOT NULL) AS junctions, arg_min(s, o) AS s, arg_max(e, o) AS e FROM j GROUP BY 1, 2)
 SELECT chrom, junctions, min(s) AS s, max(e) AS e, count(*) AS n FROM t WHERE junctions IS NOT NULL GROUP BY 1, 2"""),
    "smooth_exons": (smooth_exons, smooth_sql()),
    "consensus_mode": (consensus, f"""WITH {iv_sql('l_partkey')}, m AS (SELECT chrom AS grp, w AS j, floor(s / 300)::BIGINT AS l, floor(e / 300)::BIGINT AS r FROM iv),
 a AS (SELECT grp, j, l, row_number() OVER (PARTITION BY grp, j ORDER BY count(*) DESC, l) AS k FROM m GROUP BY 1, 2, 3), b AS (SELECT grp, j, r, row_number() OVER (PARTITION BY grp, j ORDER BY count(*) DESC, r) AS k FROM m GROUP BY 1, 2, 3)
 SELECT a.grp, a.j, a.l, b.r FROM a JOIN b USING (grp, j) WHERE a.k = 1 AND b.k = 1"""),
    "correct_junctions": (correct_junctions, f"""WITH {iv_sql('l_partkey')}, a AS (SELECT id, chrom, s AS l, e AS r FROM iv WHERE strand = 'O'), b AS (SELECT chrom, s AS nl, e AS nr, count(*) AS n FROM iv WHERE strand = 'F' GROUP BY 1, 2, 3),
 m AS (SELECT DISTINCT a.*, nl, nr, n, abs(l - nl) + abs(r - nr) AS o FROM a LEFT JOIN b ON a.chrom = b.chrom AND abs(l - nl) <= 60 AND abs(r - nr) <= 60), k AS (SELECT *, row_number() OVER (PARTITION BY id, chrom, l, r ORDER BY n DESC, o, nl, nr) AS k FROM m),
 u AS (SELECT id, chrom, l, r FROM a) SELECT u.id, u.chrom, u.l, u.r, k.nl, k.nr FROM u JOIN k USING (id, chrom, l, r) WHERE k.k = 1"""),
    "unsupported_junction_pairs": (unsupported, f"""WITH {TX_EXONS}, sx AS (SELECT id, id % 2 AS chrom, floor(s / 150)::BIGINT AS s, floor(e / 150)::BIGINT AS e, s AS o FROM ex), jx AS (SELECT *, lead(s) OVER w AS r1, lead(e) OVER w AS l2, lead(s, 2) OVER w AS r2 FROM sx WINDOW w AS (PARTITION BY id ORDER BY o)),
 p AS (SELECT id, chrom, e AS l1, r1, l2, r2 FROM jx WHERE r2 IS NOT NULL) SELECT DISTINCT id, l1, r1, l2, r2 FROM p a WHERE id % 10 > 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id % 10 <= 1 AND (a.chrom, a.l1, a.r1, a.l2, a.r2) = (b.chrom, b.l1, b.r1, b.l2, b.r2))"""),
    "connected_components": (components, """WITH RECURSIVE e0 AS (SELECT o_custkey AS a, o_custkey % 37 + o_orderkey % 11 + 1000000 AS b FROM orders), e AS MATERIALIZED (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
 c AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id) SELECT id, min(r) AS component FROM c GROUP BY id"""),
    "graph_roots": (roots, "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT 2 * floor(o_orderkey / 7)::BIGINT FROM orders)"),
}
