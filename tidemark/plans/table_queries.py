"""Selection, statistics, survival and streaming-shaped queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import seq
from ..operators import select, stats
from .views import DNA, dna, iv, iv_sql, table


def _hits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def best_hit(spark, d):
    return select.best(_hits(spark, d), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


def top_hits(spark, d):
    return select.top(_hits(spark, d), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def tiered_best(spark, d):
    return select.tiered(_hits(spark, d), ["o_custkey"], [F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def dup_cap(spark, d):
    return select.cap(iv(spark, d).select("chrom", "s", "e", "id", "w").distinct(), ["chrom", "s"], [F.col("id"), F.col("e")], 2).select("chrom", "s", "id")


def drop_shortest(spark, d):
    return select.drop_shortest(_hits(spark, d), ["o_custkey"], "o_totalprice", [F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


def names_semi(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return select.in_list(_hits(spark, d), c, "o_custkey").select("o_orderkey")


def names_anti(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return select.in_list(_hits(spark, d), c, "o_custkey", True).select("o_orderkey")


def modulo_rows(spark, d):
    return select.modulo(_hits(spark, d), ["o_orderkey"], 5, 2).select("o_orderkey")


def exact_sample(spark, d):
    return select.exact_sample(_hits(spark, d).select("o_orderkey"), 500, ["o_orderkey"], 4)


def share_sample(spark, d):
    return select.share_sample(_hits(spark, d).select("o_orderkey"), 0.1, ["o_orderkey"], 4)


def sample_names(spark, d):
    return select.sample_names(_hits(spark, d), "o_custkey", 40, 2).select("o_orderkey", "o_custkey")


def rename_duplicates(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"))
    return select.rename_duplicates(x, "name", [F.col("s_suppkey")], "unique_name")


def overrepresented(spark, d):
    return select.overrepresented(dna(spark, d), "seq", 2, 0.08)


def _mates(spark, d):
    """Customers as one file and suppliers as the other: they meet on their numbers."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a, table(spark, d, "supplier").select((3 * F.col("s_suppkey")).alias("k"))


def pair_mates(spark, d):
    return select.pairs(*_mates(spark, d), F.col("k")).select(F.col("left_k").alias("a"), F.col("right_k").alias("b"))


def single_mates(spark, d):
    return select.pairs(*_mates(spark, d), F.col("k"), "single").select(F.col("left_k").alias("a"), F.col("right_k").alias("b"))


def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_reads"), F.count("*").alias("n_rows"), F.round(100 * F.count("*") / F.count_distinct("l_orderkey"), 2).alias("pct"), F.max("l_quantity").alias("top"))


def mean_sd(spark, d):
    return stats.summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], 3)


def n50(spark, d):
    return stats.n50(table(spark, d, "documents").select("source", "n_chars"), "n_chars", ["source"])


def running(spark, d):
    rows = _hits(spark, d).withColumn("v", F.col("o_totalprice").cast("long"))
    return stats.running_mean_sd(rows, ["o_custkey"], ["o_orderkey"], "v", 4).select("o_custkey", "o_orderkey", "running_mean", "running_sd")


def window_scores(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("c"))
    return stats.window_scores(x, ["user_id"], "event_id", "c", 5).select("user_id", "event_id", "mean_score", "median_score", "geometric_score")


def strata(spark, d):
    return stats.strata(table(spark, d, "documents").select("n_chars"), "n_chars", "n_chars", 10).select("n_chars", "weight", "stratum")


def strata_cut(spark, d):
    return stats.strata_by_cut(table(spark, d, "documents").select("n_chars"), "n_chars", "n_chars", 10000).select("n_chars", "weight", "cut")


def length_bins(spark, d):
    return stats.length_bins(table(spark, d, "documents"), "n_chars", 500, 10, F.col("lang") == "en")


def percentiles(spark, d):
    return stats.percentile_table(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), "o_totalprice", [0, 1, 5, 25, 50, 75, 95, 99, 100], ["o_orderstatus"])


def gene_share(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return stats.group_share(x, ["o_custkey"], "n").select("o_custkey", "o_orderstatus", "group_total", "share")


def pivot(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return stats.transpose(x, "l_returnflag", "l_suppkey", "q", ["A", "N", "R"])


def rarefaction(spark, d):
    x = table(spark, d, "events").select("event_id", "user_id")
    return stats.rarefaction(x, "event_id", "user_id", [1, 10, 50, 100, 500, 1000, 5000], 5, 2)


def _survival(spark, d):
    return table(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("t"), (F.col("o_orderstatus") == "F").cast("long").alias("ev"), "o_totalprice", (F.col("o_custkey") % 2).alias("g"))


def log_rank(spark, d):
    return stats.log_rank(_survival(spark, d), "t", "ev", "g")


def survival_curve(spark, d):
    return stats.kaplan_meier(_survival(spark, d), "t", "ev", "g")


def field_sort(spark, d):
    x = table(spark, d, "customer").select(F.col("c_mktsegment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_custkey").cast("string").alias("key"))
    from pyspark.sql import Window as W

    return x.withColumn("place", F.row_number().over(W.partitionBy("c_mktsegment").orderBy(*select.field_order("2ni,3n", x.columns))).cast("long"))


def max_cut(spark, d):
    return stats.max_cut(_survival(spark, d), "t", "ev", "o_totalprice", [50000, 100000, 150000, 200000, 250000])


def gene_filter(spark, d):
    """Parts sold at a high price, with the sizes of their qualifying lines."""
    x = table(spark, d, "lineitem").where("l_extendedprice >= 40000")
    by = x.groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.col("l_quantity").cast("long"))).alias("sizes"))
    return by.where(F.exists("sizes", lambda v: (v >= 20) & (v <= 30))).select("l_partkey", F.concat_ws(",", F.transform("sizes", lambda v: v.cast("string"))).alias("sizes"))


def genotypes(spark, d):
    gt = F.concat_ws("|", (F.col("l_linenumber") % 3).cast("string"), F.when(F.col("l_quantity") > 25, "1").otherwise("."))
    return table(spark, d, "lineitem").groupBy(seq.genotype_count(gt).cast("long").alias("alleles")).agg(F.count("*").alias("n"))


def collapse(spark, d):
    x = iv(spark, d).groupBy("chrom").agg(F.collect_set("s").alias("xs"))
    return x.select("chrom", seq.collapse_coordinates("xs").alias("runs"))


def majority(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return select.best(by, ["l_partkey"], [F.desc("n"), F.col("l_returnflag")])


def merge_tables(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("reads"), F.max(F.col("l_quantity").cast("long")).alias("width"), F.count_distinct("l_partkey").alias("positions"))
    return x.select("l_suppkey", "l_linestatus", "reads", "width", F.greatest(F.floor(F.col("reads") * 0.1), "positions").alias("nnr"))


def sessions(spark, d):
    got = streaming.sessions(table(spark, d, "events"), "30 minutes", ["user_id"])
    return got.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


def tumbling(spark, d):
    got = streaming.windows(table(spark, d, "events"), "1 hour", None, ["event_type"], "value")
    return got.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


def ordinals(spark, d):
    return select.ordinal(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "n").select("c_custkey", "n")


def read_names(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("movie"), (F.col("o_custkey") % 9).cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/ccs")).alias("name"), F.col("o_totalprice").cast("long").alias("n"))
    x = x.withColumn("molecule", select.molecule(F.col("name")))
    return select.best(x, ["molecule"], [F.desc("n"), F.col("o_orderkey")]).select("molecule", "o_orderkey", "n")


_RN = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn FROM {t}) WHERE rn {w}"
_SURV = "x AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS t, (o_orderstatus = 'F')::INT AS ev, o_totalprice, {g} AS g FROM orders{more})"

QUERIES = {
    "best_hit_per_key": (best_hit, _RN.format(c="o_orderkey, o_custkey, o_orderstatus, o_totalprice", k="o_custkey", o="o_totalprice DESC, o_orderkey", t="orders", w="= 1")),
    "topk_per_key": (top_hits, _RN.format(c="o_custkey, o_orderkey", k="o_custkey", o="o_totalprice DESC, o_orderkey", t="orders", w="<= 3")),
    "tiered_best": (tiered_best, _RN.format(c="o_custkey, o_orderkey, o_orderstatus", k="o_custkey", o="CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey", t="orders", w="= 1")),
    "positional_duplicate_cap": (dup_cap, f"WITH {iv_sql()} " + _RN.format(c="chrom, s, id", k="chrom, s", o="id, e", t="(SELECT DISTINCT chrom, s, e, id, w FROM iv)", w="<= 2")),
    "drop_shortest_of_group": (drop_shortest, "SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE n <= 1 OR rn > 1"),
    "name_list_semi": (names_semi, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "name_list_anti": (names_anti, "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "modulo_rows": (modulo_rows, "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 5 = 2"),
    "exact_sample": (exact_sample, "SELECT o_orderkey FROM orders ORDER BY md5('4|' || o_orderkey), o_orderkey LIMIT 500"),
    "share_sample": (share_sample, "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('4|' || o_orderkey), 1, 8))::BIGINT < 429496729"),
    "sample_read_names": (sample_names, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('2|' || o_custkey), o_custkey LIMIT 40)"),
    "rename_duplicates": (rename_duplicates, "SELECT s_suppkey, 'n' || s_nationkey AS name, CASE WHEN count(*) OVER w > 1 THEN 'n' || s_nationkey || '[' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) || '/' || count(*) OVER w || ']' ELSE 'n' || s_nationkey END AS unique_name FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    "overrepresented_prefix": (overrepresented, f"""WITH RECURSIVE {DNA}, p AS MATERIALIZED (SELECT substr(seq, 1, 2) AS prefix, count(*) AS n FROM dna GROUP BY 1),
 f(round, gone, total, last) AS (SELECT -1, []::VARCHAR[], (SELECT sum(n) FROM p), 1 UNION ALL SELECT round + 1, list_concat(gone, h), total - t, len(h) FROM (SELECT f.round, f.gone, f.total,
   coalesce((SELECT list(prefix) FROM p WHERE NOT list_contains(f.gone, prefix) AND n > 0.08 * f.total), []) AS h, coalesce((SELECT sum(n) FROM p WHERE NOT list_contains(f.gone, prefix) AND n > 0.08 * f.total), 0) AS t FROM f WHERE f.last > 0))
 SELECT p.prefix, p.n, min(f.round)::INTEGER AS round FROM p JOIN f ON list_contains(f.gone, p.prefix) GROUP BY 1, 2"""),
    "pair_mates": (pair_mates, "SELECT c_custkey AS a, 3 * s_suppkey AS b FROM customer JOIN supplier ON c_custkey = 3 * s_suppkey"),
    "single_mates": (single_mates, "SELECT c_custkey AS a, 3 * s_suppkey AS b FROM customer FULL JOIN supplier ON c_custkey = 3 * s_suppkey WHERE c_custkey IS NULL OR s_suppkey IS NULL"),
    "distinct_read_count": (distinct_counts, "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_reads, count(*) AS n_rows, round(100 * count(*) / count(DISTINCT l_orderkey), 2) AS pct, max(l_quantity) AS top FROM lineitem GROUP BY 1"),
    "mean_median_sd": (mean_sd, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(median(l_extendedprice), 3) AS median, round(stddev_samp(l_extendedprice), 3) AS sd, round(stddev_pop(l_extendedprice), 3) AS sd_pop, round(exp(avg(ln(l_extendedprice))), 3) AS geometric_mean FROM lineitem GROUP BY 1, 2"),
    "n50": (n50, "SELECT source, min(n_chars) AS n50 FROM (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars) AS r, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents) WHERE 2 * r > t GROUP BY 1"),
    "running_mean_sd": (running, """WITH m AS (SELECT o_custkey, o_orderkey, trunc(o_totalprice)::BIGINT AS v, avg(trunc(o_totalprice)::BIGINT) OVER w AS m, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
 SELECT o_custkey, o_orderkey, round(m, 4) AS running_mean, CASE WHEN n > 1 THEN round(sqrt(sum((v - m) * (v - m)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) / (n - 1)), 4) END AS running_sd FROM m"""),
    "mappability_window": (window_scores, """WITH x AS (SELECT user_id, event_id, 1 / CASE WHEN floor(value) = 0 THEN 1e7 ELSE floor(value) END AS v FROM events),
 w AS (SELECT user_id, event_id, avg(v) OVER w AS a, median(v) OVER w AS m, pow(10, avg(log10(v)) OVER w) AS g, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)) SELECT user_id, event_id, round(a, 4) AS mean_score, round(m, 4) AS median_score, round(g, 4) AS geometric_score FROM w WHERE n = 5"""),
    "strata_by_bp": (strata, "WITH b AS (SELECT n_chars, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY 1) SELECT n_chars, weight, least(ceil(sum(weight) OVER (ORDER BY n_chars) * 10 / sum(weight) OVER ()), 10)::INTEGER AS stratum FROM b"),
    "strata_cutpoints": (strata_cut, """WITH b AS (SELECT n_chars, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY 1), r AS (SELECT *, sum(weight) OVER (ORDER BY n_chars DESC) AS run FROM b),
 c AS (SELECT (10000 * m * pow(10, k))::BIGINT AS c FROM range(0, 9) t(k), (SELECT unnest([1, 5]) AS m)) SELECT n_chars, weight, (SELECT min(c) FROM c WHERE c >= run) AS cut FROM r"""),
    "length_bins_rate": (length_bins, "SELECT least(n_chars // 500, 10) AS bin, count(*) AS n, count(*) FILTER (lang = 'en') AS n_hit, round(count(*) FILTER (lang = 'en') / count(*), 6) AS rate FROM documents GROUP BY 1"),
    "rpkm_percentiles": (percentiles, """WITH r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), p AS (SELECT unnest([0, 1, 5, 25, 50, 75, 95, 99, 100])::INTEGER AS percent)
 SELECT o_orderstatus, percent, o_totalprice AS value FROM r, p WHERE k = least(floor(n * percent / 100), n - 1)"""),
    "gene_share": (gene_share, "WITH x AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderstatus, (sum(n) OVER w)::BIGINT AS group_total, round(n / sum(n) OVER w, 6) AS share FROM x WINDOW w AS (PARTITION BY o_custkey)"),
    "expression_pivot": (pivot, "SELECT l_suppkey, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A')::BIGINT AS A, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'N')::BIGINT AS N, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R')::BIGINT AS R FROM lineitem GROUP BY 1"),
    "rarefaction": (rarefaction, """WITH t AS (SELECT event_id, user_id, k::BIGINT AS k FROM (SELECT DISTINCT event_id, user_id FROM events), range(0, 5) r(k)), r AS (SELECT k, user_id, row_number() OVER (PARTITION BY k ORDER BY md5(event_id || '|' || k), event_id) AS n FROM t),
 h AS (SELECT k, n, row_number() OVER (PARTITION BY k, user_id ORDER BY n) AS c FROM r), d AS (SELECT unnest([1, 10, 50, 100, 500, 1000, 5000])::INTEGER AS depth)
 SELECT depth, round(count(n) / 5, 6) AS mean_found FROM d LEFT JOIN (SELECT n FROM h WHERE c = 2) ON n <= depth GROUP BY 1"""),
    "survival_logrank": (log_rank, f"""WITH {_SURV.format(g='o_custkey % 2', more='')}, b AS (SELECT t, count(*) AS n, sum(g) AS n1, sum(ev) AS d, sum(ev * g) AS d1 FROM x GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM b WINDOW w AS (ORDER BY t DESC)),
 s AS (SELECT sum(d1) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0) SELECT o::BIGINT AS observed, round(e, 4) AS expected, round(v, 4) AS variance, round((o - e) * (o - e) / v, 4) AS chi2 FROM s"""),
    "survival_curve": (survival_curve, f"""WITH {_SURV.format(g='o_custkey % 2', more='')}, b AS (SELECT g, t, count(*) AS n, sum(ev)::BIGINT AS events FROM x GROUP BY 1, 2), r AS (SELECT *, (sum(n) OVER (PARTITION BY g ORDER BY t DESC))::BIGINT AS at_risk FROM b)
 SELECT g, t, at_risk, events, round(product(1 - events / at_risk) OVER (PARTITION BY g ORDER BY t), 6) AS survival FROM r WHERE events > 0"""),
    "field_sort": (field_sort, "SELECT c_mktsegment, c_nationkey::VARCHAR AS nation, c_custkey::VARCHAR AS \"key\", row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, c_custkey) AS place FROM customer"),
    "max_cut_scan": (max_cut, f"""WITH c AS (SELECT unnest([50000.0, 100000.0, 150000.0, 200000.0, 250000.0])::DOUBLE AS cut), {_SURV.format(g='(o_totalprice > cut)::INT', more=', c').replace('AS g FROM', 'AS g, cut FROM')},
 b AS (SELECT cut, t, count(*) AS n, sum(g) AS n1, sum(ev) AS d, sum(ev * g) AS d1 FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM b WINDOW w AS (PARTITION BY cut ORDER BY t DESC)),
 s AS (SELECT cut, sum(d1) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0 GROUP BY 1) SELECT cut, round((o - e) * (o - e) / v, 4) AS chi2 FROM s WHERE v > 0 ORDER BY chi2 DESC, cut LIMIT 1"""),
    "best_isoform_filter": (gene_filter, "WITH b AS (SELECT l_partkey, list_sort(list(DISTINCT l_quantity::BIGINT)) AS x FROM lineitem WHERE l_extendedprice >= 40000 GROUP BY 1) SELECT l_partkey, array_to_string(x, ',') AS sizes FROM b WHERE len(list_filter(x, lambda v: v >= 20 AND v <= 30)) > 0"),
    "genotype_counts": (genotypes, "SELECT (CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS alleles, count(*) AS n FROM lineitem GROUP BY 1"),
    "collapse_coordinates": (collapse, f"""WITH {iv_sql()}, x AS (SELECT DISTINCT chrom, s FROM iv), g AS (SELECT chrom, s, s - row_number() OVER (PARTITION BY chrom ORDER BY s) AS k FROM x), r AS (SELECT chrom, min(s) AS a, max(s) AS b FROM g GROUP BY chrom, k)
 SELECT chrom, string_agg(a || '-' || b, ',' ORDER BY a) AS runs FROM r GROUP BY 1"""),
    "majority_vote": (majority, "WITH b AS (SELECT l_partkey, l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY 1, 2) " + _RN.format(c="l_partkey, l_returnflag, n", k="l_partkey", o="n DESC, l_returnflag", t="b", w="= 1")),
    "merge_junction_tables": (merge_tables, "SELECT l_suppkey, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS reads, max(l_quantity::BIGINT) AS width, greatest(floor(sum(l_quantity::BIGINT) * 0.1)::BIGINT, count(DISTINCT l_partkey)) AS nnr FROM lineitem GROUP BY 1, 2"),
    "session_windows": (sessions, """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 30 MINUTE))::BIGINT AS "end", count(*) AS n FROM k GROUP BY user_id, k"""),
    "tumbling_windows": (tumbling, "SELECT event_type, floor(epoch(date_trunc('hour', ts)))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "ordinals": (ordinals, "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS n FROM customer"),
    "best_read_per_molecule": (read_names, "WITH x AS (SELECT o_orderkey, 'movie' || o_custkey % 9 || '/' || o_custkey AS molecule, trunc(o_totalprice)::BIGINT AS n FROM orders) " + _RN.format(c="molecule, o_orderkey, n", k="molecule", o="n DESC, o_orderkey", t="x", w="= 1")),
}
