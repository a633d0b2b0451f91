"""Statistics: averages, N50, running and windowed statistics, strata, rarefaction, survival, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import places, spread, sums


def summary(df: DataFrame, value: str, keys: list[str] = [], digits: int = 6) -> DataFrame:
    """n, mean, median, sd (sample and population) and geometric mean of positive values, rounded."""
    v = F.col(value)
    r = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.median(v)).alias("median"), r(F.stddev_samp(v)).alias("sd"), r(F.stddev_pop(v)).alias("sd_pop"), r(F.exp(F.avg(F.when(v > 0, F.ln(v))))).alias("geometric_mean")
    )


def n50(df: DataFrame, size: str, keys: list[str] = []) -> DataFrame:
    """The first size, ascending, at which the running total passes half of all; sizes are counted before they are ordered."""
    by = df.groupBy(*keys, size).agg((F.count("*") * F.first(size)).alias("_bp"))
    w = W.partitionBy(*keys)
    run = by.withColumn("_run", F.sum("_bp").over(w.orderBy(size))).withColumn("_all", F.sum("_bp").over(w))
    return run.where(2 * F.col("_run") > F.col("_all")).groupBy(*keys).agg(F.min(size).alias("n50"))


def running_mean_sd(df: DataFrame, keys: list[str], order: list[str], value: str, digits: int = 6) -> DataFrame:
    """Per prefix: the mean, and sqrt(sum of squared distances to the mean at each step / (n - 1)), null for the first."""
    by = [F.col(c) for c in order]
    rows = spread(df, keys, by, "in-order").withColumns({"_one": F.lit(1).cast("long"), "_some": F.col(value).isNotNull().cast("long")})
    rows = sums(rows, ["_key"], "_bin", by, {"_one": "_count", "_some": "_c", value: "_sum"}).withColumn("_m", F.when(F.col("_c") > 0, F.col("_sum") / F.col("_c")))
    out = sums(rows.withColumn("_d", F.pow(F.col(value) - F.col("_m"), 2)), ["_key"], "_bin", by, {"_d": "_ss"})
    sd = F.when(F.col("_count") > 1, F.sqrt(F.col("_ss") / (F.col("_count") - 1)))
    return out.select(*df.columns, F.round("_m", digits).alias("running_mean"), F.round(sd, digits).alias("running_sd"))


#: Rows of one key that a window of ``window_scores`` holds, besides those that go before them.
RUN = 1 << 16


def window_scores(df: DataFrame, keys: list[str], order: str, count: str, k: int, digits: int = 4) -> DataFrame:
    """Mean, median and geometric mean of 1/count over each full window of ``k`` rows; a count of 0 is taken as 10,000,000."""
    # each stretch of a key's rows also gets the k - 1 rows before it
    run = max(RUN, k)
    rows = places(df, keys, [F.col(order)], "in-order").withColumn("_at", F.col("_rank") - 1)
    own = F.floor(F.col("_at") / run)
    both = F.when(F.col("_at") % run > run - k, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select(*df.columns, "_at", F.explode(both).alias("_run"))
    w = W.partitionBy(*keys, "_run").orderBy("_at").rowsBetween(-(k - 1), 0)
    inv = 1 / F.when(F.col(count) == 0, F.lit(1e7)).otherwise(F.col(count))
    out = rows.withColumn("_inv", inv).withColumn("_n", F.count("*").over(w)).withColumn("_xs", F.collect_list("_inv").over(w))
    out = out.withColumns({"mean_score": F.round(F.avg("_inv").over(w), digits), "geometric_score": F.round(F.pow(F.lit(10.0), F.avg(F.log10("_inv")).over(w)), digits)})
    xs, half = F.sort_array("_xs"), k // 2
    middle = xs[half] if k % 2 else (xs[half - 1] + xs[half]) / 2
    full = out.where((F.col("_n") == k) & (F.col("_run") == F.floor(F.col("_at") / run)))
    return full.withColumn("median_score", F.round(middle, digits)).drop("_inv", "_n", "_xs", "_at", "_run")


def strata(df: DataFrame, value: str, weight: str, n: int) -> DataFrame:
    """(value, weight, stratum 1..n): equal shares of the total weight by ascending value; a value lies in one stratum."""
    by = df.groupBy(value).agg(F.sum(weight).alias("weight"))
    run = F.sum("weight").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    everything = F.sum("weight").over(W.partitionBy())
    return by.withColumn("stratum", F.least(F.ceil(run * n / everything), F.lit(n)).cast("int"))


def strata_by_cut(df: DataFrame, value: str, weight: str, first: int) -> DataFrame:
    """(value, weight, cut): by descending value, the first of the cut points first, 5 first, 10 first, 50 first ... that holds the running weight."""
    by = df.groupBy(value).agg(F.sum(weight).alias("weight"))
    run = F.sum("weight").over(W.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0))
    cuts = [first * m * 10**k for k in range(12) for m in (1, 5)]
    cut = F.lit(cuts[-1]).cast("long")
    for c in reversed(cuts[:-1]):
        cut = F.when(F.col("_run") <= F.lit(c).cast("long"), F.lit(c).cast("long")).otherwise(cut)
    return by.withColumn("_run", run).withColumn("cut", cut).drop("_run")


def length_bins(df: DataFrame, size: str, width: int, last: int, hit: Column) -> DataFrame:
    """(bin, n, n_hit, rate): bins of ``width``, those from ``last`` on together."""
    b = F.least(F.floor(F.col(size) / width), F.lit(last)).alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


def percentile_table(df: DataFrame, value: str, percents: list[int], keys: list[str] = [], count: str | None = None) -> DataFrame:
    """(keys, percent, value): the value at index int(n * p / 100), the last one at most, of the ascending values.

    ``count`` names a column that tells how many values a row stands for.
    """
    by = df.groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("_c"))
    w = W.partitionBy(*keys)
    run = by.withColumn("_hi", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    marks = run.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    at = F.least(F.floor(F.col("_n") * F.col("percent") / 100), F.col("_n") - 1)
    return marks.where((at >= F.col("_hi") - F.col("_c")) & (at < F.col("_hi"))).select(*keys, "percent", F.col(value).alias("value"))


def poisson_threshold(rate: float, prob: float) -> int:
    """Least k with P(X <= k) >= prob; the terms are taken from their logarithms, so large rates do not vanish."""
    import math

    if rate <= 0 or prob <= 0:
        return 0
    if prob >= 1:
        raise ValueError("no k has the probability 1")
    k = max(0, int(rate - 40 * math.sqrt(rate) - 40))  # less than 1e-300 lies below
    total = 0.0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total >= prob or k > rate and total + 1e-15 >= 1:
            return k
        k += 1


def rarefaction(df: DataFrame, unit: str, group: str, depths: list[int], trials: int, least: int = 1) -> DataFrame:
    """(depth, mean_found): groups with at least ``least`` units among the first ``depth`` of each hash-ordered trial, averaged.

    A trial orders units by md5(unit|trial); a unit's rank within the trial decides all depths at once.  All trials are
    ranged and numbered together, so no task holds a whole trial.
    """
    from .select import ordinal

    tries = df.select(unit, group).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    tries = tries.withColumn("_key", F.md5(F.concat_ws("|", F.col(unit).cast("string"), F.col("trial").cast("string"))))
    numbered = ordinal(tries, ["trial", "_key", unit, group], "_ord")
    first = numbered.groupBy("trial").agg(F.min("_ord").alias("_first"))
    ranked = numbered.join(F.broadcast(first), "trial").withColumn("_rank", F.col("_ord") - F.col("_first") + 1)  # one row a trial
    # the rank at which a group reaches the least count
    by = W.partitionBy("trial", group).orderBy("_rank")
    reach = ranked.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= least).where(F.col("_k") == least).select("trial", "_rank")
    at = reach.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).where("_rank <= depth")
    every = df.sparkSession.createDataFrame([(d,) for d in depths], "depth int")
    found = at.groupBy("depth").agg(F.count("*").alias("_n"))
    return every.join(F.broadcast(found), "depth", "left").select("depth", F.round(F.coalesce("_n", F.lit(0)) / trials, 6).alias("mean_found"))


def low_quality_shares(reads: DataFrame, qual: str, levels: list[int], least: list[int]) -> DataFrame:
    """(quality, least, share): share of the reads with at least ``least`` characters of a code at most ``quality``."""
    from ..functions import quality

    counts = F.array(*(F.struct(F.lit(q).alias("quality"), quality.low_count(qual, q).alias("n")) for q in levels))
    pairs = reads.select(F.explode(counts).alias("x")).select("x.*").withColumn("least", F.explode(F.array(*[F.lit(k) for k in least])))
    return pairs.groupBy("quality", "least").agg(F.round(F.count_if(F.col("n") >= F.col("least")) / F.count("*"), 6).alias("share"))


def kaplan_meier(df: DataFrame, time: str, event: str, group: str, digits: int = 6) -> DataFrame:
    """(group, time, at_risk, events, survival): the product-limit curve of each group at its event times."""
    by = df.groupBy(group, time).agg(F.count("*").alias("_n"), F.sum(event).alias("events"))
    back = W.partitionBy(group).orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, 0)
    risk = by.withColumn("at_risk", F.sum("_n").over(back)).where("events > 0")
    upto = W.partitionBy(group).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    # the logarithms of the factors are summed; a factor of 0 ends the curve
    alive = F.when(F.max((left == 0).cast("int")).over(upto) == 0, F.exp(F.sum(F.ln(F.when(left > 0, left))).over(upto))).otherwise(0.0)
    return risk.select(group, time, "at_risk", "events", F.round(alive, digits).alias("survival"))


def chi2_p_value(chi2: float) -> float:
    """Share of the chi-squared distribution with one degree of freedom beyond ``chi2``."""
    import math

    return math.erfc(math.sqrt(max(0.0, chi2) / 2))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(observed, expected, variance, chi2) of group 1 against group 0 over the distinct event times."""
    by = df.groupBy(time).agg(F.count("*").alias("n"), F.sum(F.col(group)).alias("n1"), F.sum(F.col(event)).alias("d"), F.sum(F.col(event) * F.col(group)).alias("d1"))
    w = W.orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, 0)
    risk = by.withColumn("r", F.sum("n").over(w)).withColumn("r1", F.sum("n1").over(w)).where("d > 0")
    e = F.col("d") * F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * (F.col("r1") / F.col("r")) * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    out = risk.agg(F.sum("d1").alias("observed"), F.sum(e).alias("_e"), F.sum(v).alias("_v"))
    return out.select(F.col("observed").cast("long"), F.round("_e", 4).alias("expected"), F.round("_v", 4).alias("variance"), F.round(F.pow(F.col("observed") - F.col("_e"), 2) / F.col("_v"), 4).alias("chi2"))


def max_cut(df: DataFrame, time: str, event: str, exposure: str, cuts: list[float]) -> DataFrame:
    """(cut, chi2) of the exposure cut-off that parts survival most, over all ``cuts`` at once; ties to the least cut."""
    rows = df.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).withColumn("g", (F.col(exposure) > F.col("cut")).cast("int"))
    by = rows.groupBy("cut", time).agg(F.count("*").alias("n"), F.sum("g").alias("n1"), F.sum(event).alias("d"), F.sum(F.col(event) * F.col("g")).alias("d1"))
    w = W.partitionBy("cut").orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, 0)
    risk = by.withColumn("r", F.sum("n").over(w)).withColumn("r1", F.sum("n1").over(w)).where("d > 0")
    v = F.when(F.col("r") > 1, F.col("d") * (F.col("r1") / F.col("r")) * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    out = risk.groupBy("cut").agg(F.sum("d1").alias("o"), F.sum(F.col("d") * F.col("r1") / F.col("r")).alias("e"), F.sum(v).alias("v")).where("v > 0")
    return out.select("cut", F.round(F.pow(F.col("o") - F.col("e"), 2) / F.col("v"), 4).alias("chi2")).orderBy(F.desc("chi2"), "cut").limit(1)


def group_share(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """``group_total`` and ``share`` of each row within its keys; totals are pre-aggregated, not windowed."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("group_total"))
    return df.join(totals, keys).withColumn("share", F.round(F.col(value) / F.col("group_total"), digits))


def transpose(cells: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """Long cells (row, col, value) to one row per ``col`` value with the given row names as columns."""
    return cells.groupBy(col).pivot(row, columns).agg(F.first(value))


#: Letters of which one step of ``quality_profile`` makes a table.
LETTERS = 1 << 20


def quality_profile(reads: DataFrame, qual: str) -> DataFrame:
    """(position from 0, code, n) over the characters of all quality strings.

    Each Arrow batch is counted by position and code before anything is shuffled, about a million letters at a time, so
    that no row a letter is made.
    """

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        def table(texts: list[str], size: int):
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            place = np.arange(size) - np.repeat(np.cumsum(lens) - lens, lens)
            cells, n = np.unique(place << 21 | code, return_counts=True)
            return pa.record_batch([pa.array(cells >> 21), pa.array(cells & (1 << 21) - 1), pa.array(n.astype(np.int64))], ["position", "code", "n"])

        texts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                one = text.as_py()
                if one:
                    texts.append(one)
                    size += len(one)
                if size >= LETTERS:
                    yield table(texts, size)
                    texts, size = [], 0
        if texts:
            yield table(texts, size)

    parts = reads.select(qual).mapInArrow(counted, "position long, code long, n long")
    return parts.groupBy("position", "code").agg(F.sum("n").alias("n"))


def svd_entropy(m) -> float:
    """Entropy of the squared singular values' shares, over log of their number."""
    import numpy as np

    s = np.linalg.svd(m, compute_uv=False) ** 2
    p = s[s > 0] / s.sum() if s.sum() else s[:0]
    return float(-(p * np.log(p)).sum() / np.log(max(2, len(s)))) if len(p) else 0.0


def entropy_reduce(rows: DataFrame, row: str, columns: list[str], tolerance: float = 0.1, most_rows: int = 2000) -> DataFrame:
    """Rows that stay when those that change the SVD entropy least go one by one until it leaves +-tolerance.

    The matrix is bounded (``most_rows``), so the elimination runs in one place.
    """
    import numpy as np

    got = rows.select(row, *columns).orderBy(row).limit(most_rows + 1).toPandas()
    if len(got) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    m, left = got[columns].to_numpy(float), list(range(len(got)))
    start = svd_entropy(m)
    while len(left) > 2:
        e = [svd_entropy(m[[j for j in left if j != i]]) for i in left]
        now = svd_entropy(m[left])
        k = int(np.argmin([abs(x - now) for x in e]))
        if abs(e[k] - start) > tolerance * abs(start):
            break
        left.pop(k)
    names = [(got[row].iloc[i].item() if hasattr(got[row].iloc[i], "item") else got[row].iloc[i],) for i in left]
    return rows.sparkSession.createDataFrame(names, f"{row} {dict(rows.dtypes)[row]}")
