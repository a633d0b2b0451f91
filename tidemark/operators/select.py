"""Best-of-group selection, filters by name lists, sampling and renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import kept
from .running import places


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under ``order`` (end it with a unique column, so ties are settled).

    Spark cuts the groups to their first row before the shuffle: each task sends one row a group, hot or not.
    """
    return top(df, keys, order, 1)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups to k rows before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def tiered(df: DataFrame, keys: list[str], tiers: list[Column], order: list[Column]) -> DataFrame:
    """The best row of each group, earlier ``tiers`` conditions before later ones, rows in none last."""
    rank = F.lit(len(tiers))
    for i, cond in reversed(list(enumerate(tiers))):
        rank = F.when(cond, F.lit(i)).otherwise(rank)
    return top(df, keys, [rank, *order], 1)


def cap(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each combination of keys (positional duplicates)."""
    return top(df, keys, order, n)


def drop_shortest(df: DataFrame, keys: list[str], size: str, order: list[Column], n: int) -> DataFrame:
    """Groups of more than ``n`` rows lose their ``n`` shortest; smaller groups stay."""
    rows = places(df, keys, [F.col(size), *order], "by-size")
    return rows.where((F.col("_n") <= n) | (F.col("_rank") > n)).drop("_n", "_rank")


def in_list(df: DataFrame, names: DataFrame, on: str | list[str], invert: bool = False) -> DataFrame:
    return df.join(names.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_anti" if invert else "left_semi")


def molecule(name: Column) -> Column:
    """``movie/hole`` of a read name ``movie/hole/...``; null otherwise."""
    m = F.regexp_extract(name, r"^([^/]+/\d+)(?:/|$)", 1)
    return F.when(m != "", m)


def modulo(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """Rows whose ordinal (from 0, under ``order``) leaves ``k`` modulo ``n``.

    Ordinals come from range-partitioned rows and one count a partition, not from a single sorted task.
    """
    return ordinal(df, order, "_ord").where(F.col("_ord") % n == k).drop("_ord")


def running_total(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals (``sums``: expression to name) over all rows under ``order``, which must be unique.

    The rows are dealt into ranges once and written, so that the ranges' totals and the rows come from the
    same partitions, also when a task is run again; one row a range is then summed up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("_part").agg(*(F.sum(F.expr(v)).alias(f"_t_{out}") for v, out in sums.items()))
    before = before.select("_part", *(F.coalesce(F.sum(f"_t_{out}").over(ahead), F.lit(0)).alias(f"_c_{out}") for out in sums.values()))
    rows = rows.join(F.broadcast(before), "_part")  # one row a partition
    return rows.withColumns({out: F.sum(F.expr(v)).over(own) + F.col(f"_c_{out}") for v, out in sums.items()}).drop("_part", *(f"_c_{out}" for out in sums.values()))


def ordinal(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: each row's number from 0 under ``order`` (which must be unique)."""
    return running_total(df, order, {"1": out}).withColumn(out, F.col(out) - 1)


def field_order(spec: str, columns: list[str]) -> list[Column]:
    """Sort columns of a field list such as ``1,2n,3ni``: fields from 1, ``n`` by number, ``i`` from the greatest."""
    out = []
    for field in spec.split(","):
        digits = field.rstrip("ni")
        if not digits.isdigit() or not 1 <= int(digits) <= len(columns) or sorted(field[len(digits) :]) not in ([], ["i"], ["n"], ["i", "n"]):
            raise ValueError(f"not a sort field: {field!r}")
        c = F.col(columns[int(digits) - 1])
        c = F.expr(f"try_cast(`{columns[int(digits) - 1]}` AS double)") if "n" in field else c.cast("string")
        out.append(c.desc() if "i" in field[len(digits) :] else c.asc())
    return out


#: Columns that order tables by location and by name.
LOCATION = {"genepred": ["chrom", "txStart", "txEnd", "name"], "bed": ["chrom", "s", "e"], "psl": ["tName", "tStart", "tEnd", "qName"], "sam": ["rname", "pos", "qname"]}
NAME = {"genepred": ["name", "chrom", "txStart"], "bed": ["name", "chrom", "s"], "psl": ["qName", "tName", "tStart"], "sam": ["qname", "rname", "pos"]}


def in_order(df: DataFrame, kind: str, by: str = "location") -> DataFrame:
    """Rows of a genepred, bed, psl or sam table in order of location or name."""
    return df.orderBy(*{"location": LOCATION, "name": NAME}[by][kind])


def by_length(df: DataFrame, text: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows whose ``text`` has at least ``least`` and at most ``most`` letters."""
    n = F.length(text)
    return df.where((n >= least) & (F.lit(True) if most is None else n <= most))


def exact_sample(df: DataFrame, n: int, key: list[str], seed: int = 1) -> DataFrame:
    """``n`` rows in pseudo-random order of md5(seed, key)."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def share_sample(df: DataFrame, share: float, key: list[str], seed: int = 1) -> DataFrame:
    """Rows whose hash of (seed, key) falls in the first ``share`` of 2**32."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("bigint")
    return df.where(h < int(share * 2**32))


def sample_names(df: DataFrame, name: str, n: int, seed: int = 1) -> DataFrame:
    """All rows of ``n`` distinct names chosen by hash."""
    return in_list(df, exact_sample(df.select(name).distinct(), n, [name], seed), name)


def rename_duplicates(df: DataFrame, name: str, order: list[Column], out: str, style: str = "[i/n]") -> DataFrame:
    """Names that repeat become ``name[i/n]`` (or ``name.i``), in ``order``; unique names stay."""
    rows = places(df, [name], order, "by-name")
    i, n = F.col("_rank").cast("string"), F.col("_n")
    mark = F.concat(F.lit("["), i, F.lit("/"), n.cast("string"), F.lit("]")) if style == "[i/n]" else F.concat(F.lit("."), i)
    return rows.withColumn(out, F.when(n > 1, F.concat(F.col(name), mark)).otherwise(F.col(name))).drop("_rank", "_n")


def overrepresented(df: DataFrame, text: str, size: int, share: float) -> DataFrame:
    """Prefixes of ``size`` letters that are taken out: again and again those above ``share`` of what is left.

    (prefix, n, round); prefixes are counted once, and each round works on the table of counts.
    """
    left = kept(df.groupBy(F.substring(text, 1, size).alias("prefix")).agg(F.count("*").alias("n")), "prefixes")
    # A prefix above the share can be no more than 1/share of them: the heads are few, and the total is one number.
    total = left.agg(F.sum("n")).first()[0] or 0
    bound = int(1 / share) + 1
    out: list[tuple] = []
    r = -1
    while True:
        r += 1
        gone = [p for p, _, _ in out]
        rest = left.where(~F.col("prefix").isin(gone)) if gone else left
        heads = rest.where(F.col("n") > F.lit(share) * total).orderBy(F.desc("n"), "prefix").limit(bound).collect()
        if not heads:
            break
        out += [(h.prefix, h.n, r) for h in heads]
        total -= sum(h.n for h in heads)
    return df.sparkSession.createDataFrame(out, "prefix string, n long, round int")


def pairs(left: DataFrame, right: DataFrame, key: Column, how: str = "inner") -> DataFrame:
    """Mates met on ``key`` (an expression on both): left_*, right_*; how ``inner``, or ``single`` for mates without one."""
    a = left.select(key.alias("key"), *[F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.select(key.alias("key"), *[F.col(c).alias(f"right_{c}") for c in right.columns])
    if how == "inner":
        return a.join(b, "key")
    return a.join(b, "key", "full_outer").where(F.col(f"left_{left.columns[0]}").isNull() | F.col(f"right_{right.columns[0]}").isNull())
