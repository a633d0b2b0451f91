"""Sequence, quality and k-mer queries and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import align, cigar, quality, seq
from ..operators import coverage as cov
from ..operators import errors, kmers, select, simulate, stats
from ..sinks import bam
from .views import DNA, QUAL, QUAL_CODES, dna, qual, table

_TURN = "reverse(translate({s}, 'ACTGUNXactgunx', 'TGACANXtgacanx'))"


def revcomp(spark, d):
    return dna(spark, d).select("doc_id", seq.reverse_complement("seq").alias("rc"))


def gc(spark, d):
    return dna(spark, d).select("doc_id", F.round(seq.gc_content("seq"), 6).alias("gc"), seq.n_count("seq").cast("long").alias("n"), F.length("seq").cast("long").alias("length"))


def gc_bins(spark, d):
    tiles = dna(spark, d).select("doc_id", F.explode(seq.tiles("seq", 100)).alias("t")).select("doc_id", "t.piece")
    return cov.gc_bins(tiles, seq.gc_content("piece"), 20, F.pmod("doc_id", F.lit(4)), F.length("piece").cast("long"))


def homopolymer(spark, d):
    c = seq.homopolymer_compress("seq")
    return dna(spark, d).select("doc_id", F.md5(c).alias("compressed"), F.length(c).cast("long").alias("n"), seq.compressed_usable("seq").alias("usable"))


def runs(spark, d):
    r = dna(spark, d).select("doc_id", F.explode(seq.homopolymer_runs("seq")).alias("r"))
    return r.groupBy(F.col("r.length").cast("long").alias("length")).agg(F.count("*").alias("n"), F.sum("r.position").alias("positions"))


def tiles(spark, d):
    return dna(spark, d).select("doc_id", F.explode(seq.tiles("seq", 500)).alias("t")).select(F.concat_ws("_", "doc_id", "t.i").alias("name"), "t.piece")


def trims(spark, d):
    s = dna(spark, d)
    return s.select("doc_id", seq.trim("seq", 50, "left").alias("l"), seq.trim("seq", 50, "right").alias("r"), seq.pad_to("seq", 450).alias("p"), seq.extend("seq", 3).alias("x"), seq.slice_of("seq", F.lit(3), F.lit(9), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+")).alias("s"))


def bwt(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.burrows_wheeler("p_name").alias("bwt"))


def kmer_count(spark, d):
    return kmers.count(dna(spark, d), "seq", 6, True)


def kmer_canonical(spark, d):
    return kmers.canonical(dna(spark, d), "seq", 7)


def kmer_overlap(spark, d):
    x = dna(spark, d)
    return kmers.overlap(kmers.count(x.where("doc_id % 2 = 0"), "seq", 8), kmers.count(x.where("doc_id % 2 = 1"), "seq", 8))


def kmer_heavy(spark, d):
    return kmers.heavy(dna(spark, d), "seq", 8, 60, 40, 2)


def phred_error(spark, d):
    return qual(spark, d).where("length(qual) > 0").select("doc_id", F.round(quality.mean_error("qual"), 6).alias("mean_error"))


def low_quality(spark, d):
    return qual(spark, d).where(quality.low_count("qual", 60) < 10).select("doc_id")


def encoding(spark, d):
    c = quality.codes("qual")
    by = qual(spark, d).where("length(qual) > 0").select("doc_id", F.array_min(c).cast("long").alias("lo"), F.array_max(c).cast("long").alias("hi"))
    return by.select("doc_id", "lo", "hi", F.concat_ws(",", quality.encodings(F.col("lo"), F.col("hi"))).alias("names"))


def encoding_by_counts(spark, d):
    return quality.called(qual(spark, d), "qual", ["doc_id"])


def reads_with_low(spark, d):
    return stats.low_quality_shares(qual(spark, d), "qual", [35, 45, 60, 75], [1, 5, 20])


def quality_by_position(spark, d):
    return stats.percentile_table(stats.quality_profile(qual(spark, d), "qual"), "code", [0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100], ["position"], "n")


def quality_profile(spark, d):
    return stats.quality_profile(qual(spark, d), "qual")


def cigar_spans(spark, d):
    n = F.col("l_linenumber")
    text = F.concat(n.cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_partkey") % 150 + 1).cast("string"), F.lit("N"), (n + 4).cast("string"), F.lit("M2I3D"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cigar"))
    return x.select("l_orderkey", "l_linenumber", cigar.coverage("cigar").cast("long").alias("coverage"), cigar.reference_span("cigar").cast("long").alias("span"), cigar.query_length("cigar").cast("long").alias("query"), F.size(cigar.exons(F.lit(1), "cigar")).cast("long").alias("exons"))


def names_codec(spark, d):
    return table(spark, d, "customer").select("c_custkey", seq.decode_name(seq.encode_name("c_name")).alias("name"), seq.encode_name("c_name").startswith("SZ_").alias("safe"))


def global_alignment(spark, d):
    x = dna(spark, d).select("doc_id", F.col("seq").alias("a"), F.expr("substring(seq, 6)").alias("b"))
    return align.global_alignments(x, "a", "b").select("doc_id", "nw.score", "nw.matches", "nw.mismatches", "nw.insertions", "nw.deletions")


def local_alignment(spark, d):
    x = dna(spark, d).select("doc_id", F.expr("substring(seq, 20)").alias("q"), F.col("seq").alias("t"))
    return align.local_alignments(x, "q", "t").select("doc_id", "sw.score", "sw.qs", "sw.qe", "sw.ts", "sw.te", "sw.cigar", "sw.strand")


def error_classes(spark, d):
    x = dna(spark, d).select("doc_id", F.concat(F.substring("seq", 1, 20), F.lit("T"), F.expr("substring(seq, 22)")).alias("q"), F.col("seq").alias("t"))
    got = align.local_alignments(x, "q", "t", False)
    return errors.known(errors.counts(got.select("sw.cigar", F.col("q").alias("query"), F.col("t").alias("target"), "sw.qs", "sw.ts")))


def simulated_reads(spark, d):
    x = dna(spark, d).withColumnRenamed("doc_id", "id")
    return simulate.with_errors(simulate.tiled_reads(x, 100, 0.5, 3), 0.05, 9)


def emitted(spark, d):
    return simulate.emit(dna(spark, d).select(F.col("doc_id").alias("id"), F.length("seq").alias("w")), "w", 5000, 11)


def reference_slices(spark, d):
    """Order lines as regions of the documents' sequences, which are read in chunks of 256 letters."""
    chunks = seq.chunked(dna(spark, d).select(F.col("doc_id").cast("string").alias("name"), "seq"), 256)
    start = F.col("l_quantity").cast("long") * 20
    regions = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.pmod("l_partkey", F.lit(250)).cast("string").alias("name"), start.alias("s"), (start + F.col("l_linenumber") * 100).alias("e"))
    return seq.slices(chunks, regions.distinct(), 256).select("id", "name", "s", "e", F.md5("seq").alias("seq"))


def length_filter(spark, d):
    return select.by_length(dna(spark, d), "seq", 100, 2000).select("doc_id", F.length("seq").cast("long").alias("n"))


def quality_errors(spark, d):
    x = table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]), "[^ACGT]", "").alias("seq"))
    x = x.withColumn("qual", F.rpad(F.lit(""), F.length("seq"), F.lit("!&+05:")))
    return simulate.quality_errors(x, "seq", "qual", "item_id", 3).select("item_id", "seq")


def bgzf_round_trip(spark, d):
    @F.pandas_udf("binary")
    def there_and_back(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else bam.unbgzf(bam.bgzf(t.encode())) for t in texts], dtype=object)

    return table(spark, d, "documents").select("doc_id", F.md5(there_and_back("text")).alias("sum"))


def bam_round_trip(spark, d):
    """Lines as alignment records, written to BAM files by supplier group and read again."""
    from ..sources.bam_records import SCHEMA, records

    x = table(spark, d, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_partkey") % 90 + 1).cast("string"), F.lit("N5M"))
    sam = x.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"), F.concat(F.lit("c"), (F.col("l_suppkey") % 7).cast("string")).alias("rname"), (F.datediff("l_shipdate", F.lit("1992-01-01")) + 1).alias("pos"), F.lit(9).alias("mapq"), text.alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.rpad(F.lit(""), F.col("l_quantity").cast("int") + 5, F.lit("ACGTN")).alias("seq"), F.lit("*").alias("qual"), F.create_map(F.lit("NM"), F.col("l_linenumber").cast("string")).alias("tags"),
    )
    made = bam.files(sam, [(f"c{i}", 100_000) for i in range(7)], F.col("rname"), 20_000)

    def read(batches):
        for pdf in batches:
            for content in pdf.content:
                yield pd.DataFrame(list(records(bam.unbgzf(bytes(content)))), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return made.mapInPandas(read, SCHEMA).select("qname", "flag", "rname", "pos", "cigar", F.length("seq").cast("long").alias("n"), F.col("tags")["NM"].alias("nm"))


_DOCS = f"WITH {DNA}"
_KM = "km AS (SELECT doc_id, substr(seq, i::BIGINT, {k}) AS kmer FROM dna, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) r(i))"
_COMP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')"

QUERIES = {
    "reverse_complement": (revcomp, f"{_DOCS} SELECT doc_id, {_TURN.format(s='seq')} AS rc FROM dna"),
    "gc_content": (gc, f"{_DOCS} SELECT doc_id, CASE WHEN length(seq) > 0 THEN round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 6) END AS gc, 0::BIGINT AS n, length(seq) AS length FROM dna"),
    "gc_bins": (gc_bins, f"""{_DOCS}, t AS (SELECT doc_id, substr(seq, i::BIGINT * 100 + 1, 100) AS p FROM dna, unnest(range(0, (length(seq) + 99) // 100)) r(i))
 SELECT least(floor((length(p) - length(translate(p, 'GC', ''))) / length(p) * 20), 19)::BIGINT AS bin, doc_id % 4 AS depth, sum(length(p))::BIGINT AS bases FROM t GROUP BY 1, 2"""),
    "homopolymer_compress": (homopolymer, f"{_DOCS}, c AS (SELECT doc_id, {_COMP.format(s='seq')} AS c FROM dna) SELECT doc_id, md5(c) AS compressed, length(c) AS n, length(c) >= 40 AS usable FROM c"),
    "homopolymer_runs": (runs, f"""{_DOCS}, c AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM dna WHERE length(seq) > 0),
 b AS (SELECT doc_id, i, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM c), r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
 n AS (SELECT doc_id, k, count(*) AS length FROM r GROUP BY 1, 2) SELECT length, count(*) AS n, sum(k - 1)::BIGINT AS positions FROM n WHERE length > 1 GROUP BY 1"""),
    "tile_sequences": (tiles, f"{_DOCS} SELECT doc_id || '_' || i AS name, substr(seq, i::BIGINT * 500 + 1, 500) AS piece FROM dna, unnest(range(0, (length(seq) + 499) // 500)) r(i)"),
    "trim_pad_slice": (trims, f"""{_DOCS} SELECT doc_id, CASE WHEN length(seq) >= 50 THEN substr(seq, 51) END AS l, CASE WHEN length(seq) >= 50 THEN substr(seq, 1, length(seq) - 50) END AS r,
 CASE WHEN length(seq) < 450 THEN rpad(seq, 450, 'N') ELSE seq END AS p, seq || 'NNN' AS x, CASE WHEN doc_id % 2 = 0 THEN {_TURN.format(s='substr(seq, 4, 6)')} ELSE substr(seq, 4, 6) END AS s FROM dna"""),
    "burrows_wheeler": (bwt, """WITH s AS (SELECT p_partkey, p_name || '|' AS s FROM part), r AS (SELECT p_partkey, substr(s, i) || substr(s, 1, i - 1) AS t FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS i FROM s))
 SELECT p_partkey, string_agg(right(t, 1), '' ORDER BY t) AS bwt FROM r GROUP BY 1"""),
    "kmer_count": (kmer_count, f"{_DOCS}, {_KM.format(k=6)}, b AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1) SELECT kmer, sum(n)::BIGINT AS n FROM (SELECT kmer, n FROM b UNION ALL SELECT {_TURN.format(s='kmer')}, n FROM b) GROUP BY 1"),
    "kmer_canonical": (kmer_canonical, f"{_DOCS}, {_KM.format(k=7)} SELECT least(kmer, {_TURN.format(s='kmer')}) AS kmer, count(*) AS n FROM km GROUP BY 1"),
    "kmer_overlap": (kmer_overlap, f"{_DOCS}, {_KM.format(k=8)} SELECT kmer, count(*) FILTER (doc_id % 2 = 0) AS n_a, count(*) FILTER (doc_id % 2 = 1) AS n_b FROM km GROUP BY 1 HAVING n_a > 0 AND n_b > 0"),
    "kmer_heavy_hitters": (kmer_heavy, f"""{_DOCS}, e AS (SELECT substr(seq, 1, 60) AS p FROM dna UNION ALL SELECT right(seq, 60) FROM dna), km AS (SELECT substr(p, i::BIGINT, 8) AS kmer FROM e, range(1, 54) r(i) WHERE i <= length(p) - 7)
 SELECT kmer, count(*) AS n FROM km WHERE NOT regexp_matches(kmer, '[AT]{{3}}$') AND NOT regexp_matches(kmer, '^[AT]{{3}}') GROUP BY 1 ORDER BY n DESC, kmer LIMIT 40"""),
    "phred_mean_error": (phred_error, f"WITH {QUAL} SELECT doc_id, round(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) / length(qual), 6) AS mean_error FROM qual WHERE length(qual) > 0"),
    "low_quality_filter": (low_quality, f"WITH {QUAL} SELECT doc_id FROM qual WHERE len(list_filter(string_split(qual, ''), lambda c: c <> '' AND ascii(c) <= 60)) < 10"),
    "encoding_guess": (encoding, f"""WITH {QUAL_CODES}, b AS (SELECT doc_id, min(code) AS lo, max(code) AS hi FROM code GROUP BY 1)
 SELECT doc_id, lo, hi, array_to_string(list_filter([CASE WHEN lo >= 64 AND hi <= 104 THEN 'Illumina-1.3' END, CASE WHEN lo >= 67 AND hi <= 104 THEN 'Illumina-1.5' END, CASE WHEN lo >= 33 AND hi <= 93 THEN 'Sanger' END, CASE WHEN lo >= 59 AND hi <= 104 THEN 'Solexa' END], lambda x: x IS NOT NULL), ',') AS names FROM b"""),
    "quality_percentiles_by_position": (quality_by_position, f"""WITH {QUAL_CODES}, c AS (SELECT i - 1 AS position, code FROM code),
 r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY code) - 1 AS k, count(*) OVER (PARTITION BY position) AS n FROM c), p AS (SELECT unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100])::INTEGER AS percent)
 SELECT position::BIGINT AS position, percent, code AS value FROM r, p WHERE k = least(floor(n * percent / 100), n - 1)"""),
    "encoding_by_counts": (encoding_by_counts, f"""WITH {QUAL_CODES}, n AS (SELECT doc_id, count(*) FILTER (code BETWEEN 105 AND 113) AS pacbio, count(*) FILTER (code BETWEEN 64 AND 65) AS a, count(*) FILTER (code BETWEEN 76 AND 104) AS high, count(*) FILTER (code BETWEEN 59 AND 63) AS solexa,
 count(*) FILTER (code BETWEEN 64 AND 66) AS b, count(*) FILTER (code BETWEEN 67 AND 72) AS c, count(*) FILTER (code BETWEEN 33 AND 58) AS low FROM code GROUP BY 1)
 SELECT doc_id, CASE WHEN pacbio > 2 AND low > 2 THEN 'P' WHEN low > 2 THEN 'S' WHEN solexa > 2 AND high > 2 THEN NULL WHEN c > 2 AND high > 2 AND a = 0 THEN 'J' WHEN b > 2 AND high > 2 THEN 'I' END AS kind FROM n"""),
    "low_quality_read_share": (reads_with_low, f"""WITH {QUAL_CODES}, q AS (SELECT unnest([35, 45, 60, 75])::INTEGER AS quality), l AS (SELECT unnest([1, 5, 20])::INTEGER AS least), n AS (SELECT doc_id, quality, count(*) AS n FROM code JOIN q ON code <= quality GROUP BY 1, 2)
 SELECT q.quality, l.least, round(count(n.n) FILTER (n.n >= l.least) / (SELECT count(*) FROM qual), 6) AS share FROM q CROSS JOIN l LEFT JOIN n ON n.quality = q.quality GROUP BY 1, 2"""),
    "quality_profile": (quality_profile, f"WITH {QUAL_CODES} SELECT i - 1 AS position, code, count(*) AS n FROM code GROUP BY 1, 2"),
    "cigar_spans": (cigar_spans, """SELECT l_orderkey, l_linenumber, (l_quantity::INT + l_linenumber + 4)::BIGINT AS coverage, (l_quantity::INT + l_partkey % 150 + 1 + l_linenumber + 4 + 3)::BIGINT AS span,
 (2 * l_linenumber + l_quantity::INT + 4 + 2)::BIGINT AS query, CASE WHEN l_partkey % 150 + 1 >= 68 THEN 2 ELSE 1 END::BIGINT AS exons FROM lineitem"""),
    "safe_names": (names_codec, "SELECT c_custkey, c_name AS name, true AS safe FROM customer"),
    "reference_slices": (reference_slices, f"""{_DOCS}, r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey % 250 AS k, l_quantity::BIGINT * 20 AS s, l_quantity::BIGINT * 20 + l_linenumber * 100 AS e FROM lineitem)
 SELECT r.id, r.k::VARCHAR AS name, r.s, r.e, md5(coalesce(substr(dna.seq, r.s + 1, r.e - r.s), '')) AS seq FROM r LEFT JOIN dna ON dna.doc_id = r.k"""),
    "length_filter": (length_filter, f"{_DOCS} SELECT doc_id, length(seq) AS n FROM dna WHERE length(seq) BETWEEN 100 AND 2000"),
    "quality_errors": (quality_errors, f"""WITH b AS (SELECT item_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{("ACGT" * 7)[:26]}'), '[^ACGT]', '', 'g') AS seq FROM benchmark),
 x AS (SELECT item_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM b WHERE length(seq) > 0), h AS (SELECT *, md5('3|' || item_id || '|' || i) AS h, ascii(substr('!&+05:', (i % 6 + 1)::BIGINT, 1)) - 33 AS q, replace('ACGT', c, '') AS o FROM x),
 e AS (SELECT item_id, i, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0 < pow(10.0, -q / 10.0) THEN substr(o, (('0x' || substr(h, 9, 4))::BIGINT % 3) + 1, 1) ELSE c END AS c FROM h) SELECT item_id, string_agg(c, '' ORDER BY i) AS seq FROM e GROUP BY 1"""),
    "bgzf_round_trip": (bgzf_round_trip, "SELECT doc_id, md5(text) AS sum FROM documents"),
    "bam_round_trip": (bam_round_trip, """SELECT l_orderkey || '/' || l_linenumber AS qname, CASE l_returnflag WHEN 'R' THEN 16 ELSE 0 END AS flag, 'c' || l_suppkey % 7 AS rname, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + 1)::INTEGER AS pos,
 l_quantity::INT || 'M' || (l_partkey % 90 + 1) || 'N5M' AS cigar, l_quantity::BIGINT + 5 AS n, l_linenumber::VARCHAR AS nm FROM lineitem"""),
    "needleman_wunsch": (global_alignment, None),
    "smith_waterman": (local_alignment, f"""{_DOCS}, q AS (SELECT doc_id, seq, substr(seq, 20) AS q FROM dna) SELECT doc_id, (10 * length(q))::BIGINT AS score, 0::BIGINT AS qs, length(q)::BIGINT AS qe,
 CASE WHEN q = '' THEN 0 ELSE strpos(seq, q) - 1 END::BIGINT AS ts, (CASE WHEN q = '' THEN 0 ELSE strpos(seq, q) - 1 END + length(q))::BIGINT AS te, CASE WHEN q = '' THEN '' ELSE length(q) || 'M' END AS cigar, '+' AS strand FROM q"""),
    "error_classes": (error_classes, None),
    "simulated_reads": (simulated_reads, None),
    "emitted_transcripts": (emitted, None),
}
