"""Errors of reads made from the documents' sequences by known changes, so that SQL can tell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors, reads
from .views import DNA, dna


def _aligned(spark, d):
    """Reads with letter 21 exchanged, two letters inserted behind 40 and letters 61 to 63 left out."""
    rows = dna(spark, d).where("length(seq) >= 80")
    swap = F.when(F.col("doc_id") % 3 == 0, "N").otherwise("T")
    more = F.when(F.col("doc_id") % 5 == 0, "NN").otherwise("AC")
    query = F.concat(F.substring("seq", 1, 20), swap, F.substring("seq", 22, 19), more, F.substring("seq", 41, 20), F.expr("substring(seq, 64)"))
    text = F.concat(F.lit("40M2I20M3D"), (F.length("seq") - 63).cast("string"), F.lit("M"))
    return rows.select(F.col("doc_id").alias("id"), text.alias("cigar"), query.alias("query"), F.col("seq").alias("target"), F.lit(0).alias("qs"), F.lit(0).alias("ts"))


def kinds(spark, d):
    return errors.known(errors.counts(_aligned(spark, d)))


def contexts(spark, d):
    return errors.profile(_aligned(spark, d))


def rates(spark, d):
    return reads.error_rates(errors.known(errors.counts(_aligned(spark, d))), True)


def lists(spark, d):
    return errors.differences(_aligned(spark, d), 5)


_COLS = f"""{DNA}, r AS (SELECT doc_id AS id, seq, CASE WHEN doc_id % 3 = 0 THEN 'N' ELSE 'T' END AS swap, CASE WHEN doc_id % 5 = 0 THEN 'NN' ELSE 'AC' END AS more FROM dna WHERE length(seq) >= 80),
 p AS (SELECT id, seq, swap, unnest(range(1, length(seq) + 1)) AS i FROM r), c0 AS (SELECT id, i * 10 AS i, CASE WHEN i BETWEEN 61 AND 63 THEN '' WHEN i = 21 THEN swap ELSE substr(seq, i, 1) END AS base, substr(seq, i, 1) AS ref FROM p
   UNION ALL SELECT id, 401, substr(more, 1, 1), '' FROM r UNION ALL SELECT id, 402, substr(more, 2, 1), '' FROM r),
 c AS (SELECT *, CASE WHEN ref = '' THEN 'insertion' WHEN base = '' THEN 'deletion' WHEN base = ref THEN 'match' ELSE 'mismatch' END AS kind FROM c0 WHERE base <> 'N')"""

QUERIES = {
    "error_kinds": (kinds, f"WITH {_COLS} SELECT kind, base, ref, count(*) AS n FROM c GROUP BY ALL"),
    "error_contexts": (contexts, f"""WITH {_COLS}, w AS (SELECT base, ref, lag(ref) OVER (PARTITION BY id ORDER BY i) AS before, lead(ref) OVER (PARTITION BY id ORDER BY i) AS after FROM c WHERE ref <> '')
 SELECT before, after, ref, base, count(*) AS n FROM w WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL"""),
    "error_rates": (rates, f"WITH {_COLS} SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM c GROUP BY kind"),
    "difference_lists": (lists, f"""WITH {_COLS}, d AS (SELECT id, CASE WHEN swap <> 'N' AND substr(seq, 21, 1) <> 'T' THEN '21' || substr(seq, 21, 1) || '>T ' ELSE '' END || CASE WHEN more = 'AC' THEN '41+AC ' ELSE '' END
   || '61-' || substr(seq, 61, 1) || ' 62-' || substr(seq, 62, 1) || ' 63-' || substr(seq, 63, 1) AS differences, (5 + CASE WHEN swap <> substr(seq, 21, 1) THEN 1 ELSE 0 END)::BIGINT AS errors, length(seq) - 1 AS n FROM r)
 SELECT id, differences, errors, (100 * errors // n)::BIGINT AS rate FROM d WHERE 100 * errors // n <= 5"""),
}
