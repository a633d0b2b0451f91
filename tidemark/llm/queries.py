"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, ego, features, fim, langid, mixing, packing, quality, rules, simhash, substring, suffix, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    held, s = features.fold("id", 5) == 0, F.col("score")
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), s, (s >= 0.5).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    held = features.fold("id", 4) == 2
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    held, s = features.fold("id", 4) == 2, F.col("score")
    return quality.score(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), s, (s >= 0.7).cast("int").alias("predicted"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ego.near_duplicates(_table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), "mix_order")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS n FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / sqrt(a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)
),
least AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (
  SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(k, k + 50)) AS p FROM win JOIN least USING (h) WHERE f < doc_id) GROUP BY r
),
kept AS (SELECT r, array_to_string(list(x ORDER BY k), ' ') AS t FROM (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d
) JOIN gone USING (r) WHERE NOT list_contains(gone, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


def _op12_sql() -> str:
    """Rounds as chained tables: distances to every centroid, the nearest one, floors of the sums' quotients."""
    sql = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, e FROM v QUALIFY k < 40
)"""
    for n in range(6):
        sql += f""", a{n} AS MATERIALIZED (
  SELECT r, vec_id, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT r, vec_id, k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n} c
  ) GROUP BY r, vec_id
)"""
        if n < 5:
            sql += f""", c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
      SELECT best.k AS k, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT r, unnest(e) AS x, unnest(range(1, 65)) AS i FROM v) JOIN a{n} USING (r) GROUP BY best.k, i
    ) GROUP BY k
  ) m ON m.k = c.k
)"""
    return sql + """
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.e, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.k = best.k
"""


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
d AS (
  SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS p, ('0x' || s[9:16])::BIGINT % (n + 1) AS q, ('0x' || s[17:24])::BIGINT % 100 AS shape, ('0x' || s[25:32])::BIGINT % 100 AS turn FROM h
), f AS (
  SELECT *, least(p, q) AS a, greatest(p, q) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR shape >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), g AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1, n - b) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_best_fit_packing, op3_toxicity, op4_language_id, op5_url_filter, op6_quality_classifier, op7_embedding_near_dedup, op8_quality_rules, op9_source_mixing, op10_simhash_near_dedup, op11_substring_dedup, op12_centroid_clustering, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op7_embedding_near_dedup": OP7_SQL, "op11_substring_dedup": OP11_SQL, "op12_centroid_clustering": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
