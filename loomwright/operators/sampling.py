"""Stratified allocation and sampling, seeded splits: exact sizes, reproducible, no global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def permuted(key: Column, seed: int) -> Column:
    """A reproducible pseudo-random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def allocate(df: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """(stratum, n, quota): proportional quotas, each at least 1, that sum to max(1, fraction) of all rows.

    Surplus is shaved off the largest quotas (to 1 at least), a gap filled where most rows are
    left. Works on the counts alone. Ties by label.
    """
    c = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    c = c.withColumn("total", F.sum("n").over(all_)).withColumn("k", F.count("*").over(all_))
    goal = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(fraction)), F.col("k")).cast("long")
    c = c.withColumn("goal", goal).withColumn("a", F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.col("n") / F.col("total") * F.col("goal")))).cast("long"))
    c = c.withColumn("sum_a", F.sum("a").over(all_))
    over = all_.orderBy(F.desc("a"), stratum).rowsBetween(Window.unboundedPreceding, -1)
    under = all_.orderBy(F.desc(F.col("n") - F.col("a")), stratum).rowsBetween(Window.unboundedPreceding, -1)
    shaved = F.col("a") - F.greatest(F.lit(0), F.least(F.col("a") - 1, F.col("sum_a") - F.col("goal") - F.coalesce(F.sum(F.col("a") - 1).over(over), F.lit(0))))
    given = F.col("a") + F.greatest(F.lit(0), F.least(F.col("n") - F.col("a"), F.col("goal") - F.col("sum_a") - F.coalesce(F.sum(F.col("n") - F.col("a")).over(under), F.lit(0))))
    quota = F.when(F.col("total") <= F.col("goal"), F.col("n")).when(F.col("sum_a") > F.col("goal"), shaved).otherwise(given)
    return c.select(stratum, "n", quota.cast("long").alias("quota"))


#: Hexadecimal digits of the permuted key that name a range of it.
RANGE_DIGITS = 4


def ranked(df: DataFrame, groups: list[str], key: str, seed: int, name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in its group by the permuted key.

    Two levels: rows fall into 65,536 ranges of the permuted key, ranked within (group, range); the
    sizes of the ranges before give the offset. So the largest part ranked by itself is that share of a group.
    """
    p = permuted(F.col(key), seed)
    t = df.withColumns({"__p": p, "__b": F.substring(p, 1, RANGE_DIGITS)})
    sizes = t.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    # offsets in two steps as well: ranges within their first digits, then the first digits
    coarse = F.substring("__b", 1, 1)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.groupBy(*groups, coarse.alias("__c")).agg(F.sum("__n").alias("__m"))
    heads = heads.withColumn("__far", F.coalesce(F.sum("__m").over(up_to(Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__c"))), F.lit(0))).drop("__m")
    near = F.sum("__n").over(up_to(Window.partitionBy(*groups, "__c").orderBy("__b")))
    sizes = sizes.withColumn("__c", coarse).withColumn("__near", F.coalesce(near, F.lit(0))).join(heads, [*groups, "__c"])
    sizes = sizes.select(*groups, "__b", (F.col("__near") + F.col("__far")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__p", key))
    return t.join(sizes, [*groups, "__b"]).withColumn(name, F.col("__before") + inner).drop("__p", "__b", "__before")


def stratified_sample(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows of each stratum up to its quota, in permuted order. Rows without a stratum are not drawn."""
    r = ranked(df.where(F.col(stratum).isNotNull()), [stratum], key, seed, "__rank")
    return r.join(allocate(df, stratum, fraction).select(stratum, "quota"), stratum).where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def seeded_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42, name: str = "part") -> DataFrame:
    """df with train, val or test: disjoint, complete, and of exactly floor(share * n) rows."""
    n = df.agg(F.count("*").alias("__n"))
    r = ranked(df, [], key, seed, "__rank").crossJoin(F.broadcast(n))
    a, b = F.floor(F.col("__n") * F.lit(train)), F.floor(F.col("__n") * F.lit(val))
    return r.withColumn(name, F.when(F.col("__rank") <= a, "train").when(F.col("__rank") <= a + b, "val").otherwise("test")).drop("__rank", "__n")


def take_share(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """floor(fraction * n) rows in permuted order; all of them for a fraction of 1 or more."""
    n = df.agg(F.count("*").alias("__n"))
    r = ranked(df, [], key, seed, "__rank").crossJoin(F.broadcast(n))
    return r.where((F.lit(fraction) >= 1) | (F.col("__rank") <= F.floor(F.col("__n") * F.lit(fraction)))).drop("__rank", "__n")
