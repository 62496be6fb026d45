"""Row identity, filters, deduplication, set operations and partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text as tx


def range_bounds(df: DataFrame, order: str, parts: int, per_part: int = 60) -> list:
    """At most parts - 1 values that divide the column into ranges of nearly equal size.

    They come from the parts * per_part rows of the least hashed value: a sample that is the same
    each time it is drawn and of a bounded size. Only the ranges' sizes depend on it, never a result.
    """
    drawn = df.where(F.col(order).isNotNull()).select(F.col(order).alias("v")).orderBy(F.xxhash64("v"), "v").limit(parts * per_part)
    return [r.v for r in drawn.groupBy().agg(F.array_sort(F.collect_set("v")).alias("v")).selectExpr(f"explode(filter(v, (x, i) -> i > 0 and (i * {parts}) div size(v) > ((i - 1) * {parts}) div size(v))) as v").collect()]


def range_of(c: Column, bounds: list) -> Column:
    """The number of the range a value falls into, by a balanced tree of comparisons; null falls into the first."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def with_row_position(df: DataFrame, order: str, name: str = "row_pos") -> DataFrame:
    """df with a 0-based position in the order of a unique column; null comes first.

    No global sort in one task: rows fall into ranges of the column between fixed bounds, a range's
    first position is the sum of the sizes before it, and rows are numbered within their range. The
    range is a function of the value alone, so both readings of df agree on it.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = df.withColumn("__p", range_of(F.col(order), range_bounds(df, order, parts)))
    sizes = tagged.groupBy("__p").agg(F.count("*").alias("__n"))  # a row a range
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return tagged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + inner - 1).drop("__p", "__start")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in input order. Only (key, least order) is aggregated, then joined back."""
    first = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(order).alias("__first"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(first, on & (F.col(order) == F.col("__first")), "left_semi")


def last_wins(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(key, value): of repeated keys the value of the last row; rows without a key are dropped."""
    return df.select(key.alias("key"), value, order).where("key is not null").groupBy("key").agg(F.max_by(value, order).alias("value"))


def keep_filled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose columns (all, if none are named) are neither null, blank nor '-'."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    ok = [F.coalesce(~tx.blank_trim(F.col(c).cast("string")).isin("", "-"), F.lit(False)) for c in cols]
    return df.where(reduce(lambda a, b: a & b, ok)) if ok else df


def drop_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is a mere number."""
    bad = [F.coalesce(tx.blank_trim(F.col(c)).rlike(r"(?U)^\d+\z"), F.lit(False)) for c in columns if c in df.columns]
    return df.where(~reduce(lambda a, b: a | b, bad)) if bad else df


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, n_removed, n_left): rows lost at each filter, all counted in one pass."""
    kept: Column = F.lit(True)
    counts = [F.count("*").alias("s0")]
    for i, (_, ok) in enumerate(steps, 1):
        kept = kept & F.coalesce(ok, F.lit(False))
        counts.append(F.coalesce(F.sum(kept.cast("long")), F.lit(0)).alias(f"s{i}"))
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), (F.col(f"s{i - 1}") - F.col(f"s{i}")).alias("n_removed"), F.col(f"s{i}").alias("n_left")) for i, (name, _) in enumerate(steps, 1)]
    return df.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def ensure_columns(df: DataFrame, names: list[str], value: str = "") -> DataFrame:
    """df with the missing columns added."""
    return df.withColumns({c: F.lit(value) for c in names if c not in df.columns})


def select_available(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def rename_or_fill(df: DataFrame, wrong: str, right: str) -> DataFrame:
    """A misspelt column renamed, or used to fill blanks of the right one and dropped."""
    if wrong not in df.columns:
        return df
    if right not in df.columns:
        return df.withColumnRenamed(wrong, right)
    return df.withColumn(right, F.when(tx.is_blank(F.col(right)), F.col(wrong)).otherwise(F.col(right))).drop(wrong)


def route(df: DataFrame, column: str, routes: dict[str, str], name: str = "route") -> DataFrame:
    """df with the route of a type code ('1' or '1.0'); rows of other codes are dropped."""
    code = tx.sub(tx.blank_trim(F.col(column).cast("string")), r"\.0$", "")
    target = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])[code]
    return df.withColumn(name, target).where(F.col(name).isNotNull())


def partition_label(c: Column, sole: str) -> Column:
    """'none' for blank values, 'sole' for one value, else 'rest': three parts without overlap."""
    return F.when(tx.is_blank(c), "none").when(c == sole, "sole").otherwise("rest")


def positional_lookup(keys: DataFrame, key: str, order: str, df: DataFrame, position: str) -> DataFrame:
    """The rows at the positions given, in their order, repeated as often as asked for."""
    return keys.select(F.col(order).alias("ask_order"), F.col(key).alias(position)).join(df, position)


def semi_first(df: DataFrame, key: str, order: str, wanted: DataFrame) -> DataFrame:
    """Of each wanted key its first row."""
    return keep_first(df.join(wanted.select(key).distinct(), key, "left_semi"), [key], order)


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in input order (None: all), those of least position."""
    return df if n is None else df.orderBy(order).limit(n)
