"""Transcript reduction queries and their SQL.

Orders stand in for transcripts: an exon for each fortnight in which they ship, its ends shifted a little by quantities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reduction
from .views import by_id, table

_TOLERANCE = 2


def slot_tx(spark, d):
    """(id, chrom, exons) of all orders."""
    day, q = F.datediff("l_shipdate", F.lit("1992-01-01")), F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.floor(day / 14).alias("slot"), q.alias("q"))
    rows = by_id(rows)
    ex = rows.groupBy("id", "slot").agg((F.col("slot") * 100 + F.min("q") % 5).alias("s"), (F.col("slot") * 100 + 50 + F.max("q") % 5).alias("e"))
    return ex.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons")).select("id", F.floor(F.col("id") / 4000).alias("chrom"), "exons")


SLOT_TX = """sx AS (SELECT id, slot * 100 + min(q) % 5 AS s, slot * 100 + 50 + max(q) % 5 AS e FROM (
   SELECT l_orderkey AS id, floor(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 14)::BIGINT AS slot, l_quantity::BIGINT AS q FROM lineitem) GROUP BY id, slot),
 jx AS (SELECT id, s, e, lead(s) OVER (PARTITION BY id ORDER BY s) AS r FROM sx),
 tx AS (SELECT id, floor(id / 4000)::BIGINT AS chrom, list({'l': e, 'r': r} ORDER BY s) FILTER (r IS NOT NULL) AS js, min(s) AS s, max(e) AS e FROM jx GROUP BY id HAVING count(*) > 1)"""

_CHAINS = "c0 AS MATERIALIZED (SELECT min(id) AS chain, chrom, js, len(js) AS m, count(*) AS n, min(s) AS s, max(e) AS e FROM tx GROUP BY chrom, js)"


def _met(c: str, name: str, cond: str) -> str:
    """Chains of table ``c`` whose junction k matches the first one of another, and those after it."""
    t = _TOLERANCE
    return f"""{name} AS MATERIALIZED (SELECT a.chain AS big, a.k AS ofs, b.chain AS small, a.m AS mb, b.m AS ms
   FROM (SELECT chain, chrom, m, js, unnest(range(0, m)) AS k, unnest(js) AS j FROM {c}) a JOIN {c} b ON a.chrom = b.chrom AND a.chain <> b.chain AND {cond}
   AND abs(a.j.l - b.js[1].l) <= {t} AND abs(a.j.r - b.js[1].r) <= {t}
   WHERE len(list_filter(list_zip(a.js[a.k + 1:a.k + least(a.m - a.k, b.m)], b.js[1:least(a.m - a.k, b.m)]), lambda p: abs(p[1].l - p[2].l) > {t} OR abs(p[1].r - p[2].r) > {t})) = 0)"""


_FAMILIES = f"""{_met('c0', 'ins', 'a.m - a.k >= b.m')},
 eq(x, y) AS (SELECT chain, chain FROM c0 UNION SELECT eq.x, ins.small FROM eq JOIN ins ON ins.big = eq.y AND mb = ms),
 nm AS MATERIALIZED (SELECT x AS chain, min(y) AS node FROM eq GROUP BY x),
 up AS MATERIALIZED (SELECT a.node AS above, b.node AS below, min(ofs) AS ofs FROM ins JOIN nm a ON a.chain = big JOIN nm b ON b.chain = small WHERE mb > ms GROUP BY 1, 2),
 reach(family, node, ofs, depth) AS (SELECT DISTINCT node, node, 0, 0 FROM nm WHERE node NOT IN (SELECT below FROM up)
   UNION SELECT family, below, reach.ofs + up.ofs, depth + 1 FROM reach JOIN up ON above = node),
 near AS (SELECT family, node, arg_min(ofs, depth * 1000 + ofs) AS ofs FROM reach GROUP BY family, node)"""
_EXHAUSTIVE = "placed AS MATERIALIZED (SELECT family, chain, ofs FROM near JOIN nm USING (node))"
_GREEDY = """size AS (SELECT node AS family, max(m) AS m, sum(n) AS n FROM nm JOIN c0 USING (chain) GROUP BY node),
 placed AS MATERIALIZED (SELECT family, chain, ofs FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY m DESC, n DESC, family) AS i FROM near JOIN size USING (family)) JOIN nm USING (node) WHERE i = 1)"""


def _consensus(c: str, placed: str, out: str) -> str:
    """Families of ``placed`` as chains: modes of the junction ends, widest bounds."""
    side = lambda x: f"(SELECT family, pos, arg_min(v, (-w, v)) AS {x} FROM (SELECT family, pos, j.{x} AS v, sum(n) AS w FROM {out}_j GROUP BY 1, 2, 3) GROUP BY family, pos)"
    return f"""{out}_r AS (SELECT * FROM {placed} JOIN {c} USING (chain)),
 {out}_t AS (SELECT family, chrom, max(ofs + m) AS m, sum(n) AS n, arg_min(js, (ofs, -m, chain)) AS own FROM {out}_r GROUP BY family, chrom),
 {out}_b AS (SELECT family, min(r.s) FILTER (r.ofs = 0) AS s, max(r.e) FILTER (r.ofs + r.m = t.m) AS e FROM {out}_r r JOIN {out}_t t USING (family) GROUP BY family),
 {out}_j AS (SELECT family, n, ofs + unnest(range(0, m)) AS pos, unnest(js) AS j FROM {out}_r),
 {out}_a AS (SELECT family, list({{'l': l, 'r': r}} ORDER BY pos) AS x FROM {side('l')} JOIN {side('r')} USING (family, pos) GROUP BY family),
 {out} AS MATERIALIZED (SELECT family AS chain, chrom, CASE WHEN len(own) < m OR (s < x[1].l AND x[-1].r < e AND len(list_filter(x, lambda q: q.l > q.r)) = 0
   AND len(list_filter(list_zip(x[1:-2], x[2:]), lambda p: p[1].r >= p[2].l)) = 0) THEN x ELSE own END AS js, m, n::BIGINT AS n, s, e FROM {out}_t JOIN {out}_b USING (family) JOIN {out}_a USING (family))"""


_OUT = """SELECT chain, chrom, m::INTEGER AS m, n, array_to_string(list_transform(list_zip(list_concat([s], list_transform(js, lambda j: j.r)), list_concat(list_transform(js, lambda j: j.l), [e])), lambda p: p[1] || '-' || p[2]), ',') AS exons FROM """


def _shown(rows):
    return rows.select("chain", "chrom", "m", "n", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("exons"))


def reduced(how):
    def run(spark, d):
        return _shown(reduction.reduced(slot_tx(spark, d), _TOLERANCE, how))

    return run


def predicted(spark, d):
    return _shown(reduction.predicted(slot_tx(spark, d), _TOLERANCE, 1, rounds=1))


def evidence(spark, d):
    """Families with the number of chains and of transcripts under them, and how far they reach into the root."""
    c = reduction.chains(slot_tx(spark, d))
    return reduction.families(c, _TOLERANCE).join(c, "chain").groupBy("family").agg(F.count("*").alias("chains"), F.sum("n").alias("transcripts"), F.max("at").alias("last_at"))


_ONE_ROUND = f"""{_consensus('c0', 'placed', 'c1')}, {_met('c1', 'go', 'a.k > 0 AND b.m > a.m - a.k')},
 best AS (SELECT big AS a, small AS b, ofs, row_number() OVER (PARTITION BY big ORDER BY mb - ofs DESC, small, ofs) AS i, row_number() OVER (PARTITION BY small ORDER BY mb - ofs DESC, big, ofs) AS j FROM go),
 e1 AS MATERIALIZED (SELECT a, b, ofs FROM best WHERE i = 1 AND j = 1),
 walk(head, id, ofs) AS (SELECT chain, chain, 0::BIGINT FROM c1 WHERE chain NOT IN (SELECT b FROM e1) UNION ALL SELECT head, b, walk.ofs + e1.ofs FROM walk JOIN e1 ON e1.a = walk.id),
 placed1 AS MATERIALIZED (SELECT head AS family, id AS chain, ofs FROM walk)"""

QUERIES = {
    "reduced_transcripts": (reduced("exhaustive"), f"WITH RECURSIVE {SLOT_TX}, {_CHAINS}, {_FAMILIES}, {_EXHAUSTIVE}, {_consensus('c0', 'placed', 'c1')} {_OUT} c1"),
    "reduced_transcripts_greedy": (reduced("greedy"), f"WITH RECURSIVE {SLOT_TX}, {_CHAINS}, {_FAMILIES}, {_GREEDY}, {_consensus('c0', 'placed', 'c1')} {_OUT} c1"),
    "predicted_transcripts": (predicted, f"WITH RECURSIVE {SLOT_TX}, {_CHAINS}, {_FAMILIES}, {_GREEDY}, {_ONE_ROUND}, {_consensus('c1', 'placed1', 'c2')} {_OUT} c2"),
    "transcript_families": (evidence, f"WITH RECURSIVE {SLOT_TX}, {_CHAINS}, {_FAMILIES}, {_EXHAUSTIVE} SELECT family, count(*) AS chains, sum(n)::BIGINT AS transcripts, max(ofs)::INTEGER AS last_at FROM placed JOIN c0 USING (chain) GROUP BY family"),
}
