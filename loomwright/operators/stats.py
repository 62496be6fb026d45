"""Counts, shares and summaries."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text as tx
from loomwright.functions import vectors as vx
from loomwright.operators.rows import range_bounds, range_of


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, label, n) of all columns in one pass; null is not counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("label")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("label is not null").groupBy("column_name", "label").agg(F.count("*").alias("n"))


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n): values that are neither null nor blank, all columns in one aggregation."""
    one = df.agg(*[F.count(F.when(~tx.is_blank(F.col(c).cast("string")), 1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """(tag, n): split at ';', or at '；' where there is no ';'; blank tags don't count."""
    c = F.col(column)
    parts = F.when(c.contains(";"), F.split(c, ";")).when(c.contains("；"), F.split(c, "；")).otherwise(F.array(c))
    return df.select(F.explode(parts).alias("x")).select(tx.non_blank(F.col("x")).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, column: str, separators: str = "[;；]+") -> DataFrame:
    """(tag): distinct trimmed entries of a list column."""
    return df.select(F.explode(F.split(F.col(column), separators)).alias("x")).select(tx.non_blank(F.col("x")).alias("tag")).where("tag is not null").distinct()


def top_and_other(df: DataFrame, column: str, top: int = 5, other: str = "其他") -> DataFrame:
    """(label, n, share): the most frequent labels, the rest in one: the best `top` counts and the total, no ranking of all labels."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "label").limit(top)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rest = total.crossJoin(best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("known"))).select(F.lit(other).alias("label"), (F.col("total") - F.col("known")).alias("n")).where("n > 0")
    merged = best.unionByName(rest).groupBy("label").agg(F.sum("n").alias("n"))
    return merged.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def ema_by_key(df: DataFrame, key: str, order: str, value: str, beta: float) -> DataFrame:
    """(key, ema): exponential mean of a key's values in order, from its first; nulls are left out.

    A key's history is cut into ranges of the order, each is one partial result (factor, sum), and these are
    combined in order: no array holds all of a hot key's values.
    """
    d = df.where(F.col(value).isNotNull())
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.select(key, order, value, range_of(F.col(order), range_bounds(d, order, parts)).alias("__p"))
    h = d.groupBy(key, "__p").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("h"))
    values = F.transform("h", lambda x: x["v"])
    part = F.struct(F.col("__p").alias("p"), F.pow(F.lit(beta), F.size("h")).alias("factor"), F.aggregate(values, F.lit(0.0), lambda a, x: beta * a + (1 - beta) * x).alias("sum"), vx.ema(values, beta).alias("own"))
    per = h.select(key, part.alias("part")).groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return per.select(key, F.aggregate(F.slice("parts", 2, 2_000_000_000), F.get("parts", F.lit(0))["own"], lambda a, x: x["factor"] * a + x["sum"]).alias("ema"))


def metric_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the mean of each metric over the records that have it; null where none has."""
    return df.agg(*[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in metrics])


def sequence_perplexity(tokens: DataFrame, key: str, position: str, loss: str, prompt_length: int | Column, label: str | None = None) -> DataFrame:
    """(key, ppl): exp of the mean loss of the tokens behind the prompt; null for a blank label, or a sequence shorter than its prompt or ending with it."""
    n = F.lit(prompt_length) if isinstance(prompt_length, int) else prompt_length
    t = tokens.withColumn("__own", F.when(F.col(position) > n, F.col(loss)))
    has = F.lit(True) if label is None else ~tx.is_blank(F.first(F.col(label)))
    return t.groupBy(key).agg(F.when(has, F.round(F.exp(F.avg("__own")), 6)).alias("ppl"))


def percent(n: Column, d: Column) -> Column:
    """n of d in per cent; 0 where d is 0."""
    return F.when(d > 0, n / d * 100).otherwise(0.0)


def match_score_stats(pairs: DataFrame, query: str, score: str, high: float, low: float) -> DataFrame:
    """One row: pairs, pairs above two scores, and queries with any above them."""
    per = pairs.groupBy(query).agg(F.count(score).alias("p"), F.count_if(F.col(score) > high).alias("h"), F.count_if(F.col(score) > low).alias("l"))
    s = per.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_high"), F.coalesce(F.sum("l"), F.lit(0)).alias("n_low"), F.count_if(F.col("h") > 0).alias("q_high"), F.count_if(F.col("l") > 0).alias("q_low"))
    return s.withColumn("pct_high", F.round(percent(F.col("q_high"), F.col("n_queries")), 4)).withColumn("pct_low", F.round(percent(F.col("q_low"), F.col("n_queries")), 4))


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right, in either; null keys are ignored."""
    a = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("in_left", F.lit(1))
    b = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("in_right", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("n_both"), F.count_if(F.col("in_right").isNull()).alias("n_left_only"), F.count_if(F.col("in_left").isNull()).alias("n_right_only"), F.count("*").alias("n_any"))


def token_stats(df: DataFrame, input_tokens: str, output_tokens: str) -> DataFrame:
    """One row: count, sum, least and most of input, output and total tokens; 0 where there are none."""
    cols = {"input": F.col(input_tokens), "output": F.col(output_tokens), "total": F.col(input_tokens) + F.col(output_tokens)}
    aggs = [F.count("*").alias("n")]
    for name, c in cols.items():
        aggs += [F.coalesce(f(c), F.lit(0)).cast("long").alias(f"{label}_{name}") for label, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    return df.agg(*aggs)


def cost_estimate(stats: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """cost of a token_stats row at prices per thousand tokens, and the mean cost of a record."""
    cost = F.col("sum_input") / 1000 * F.lit(price_in) + F.col("sum_output") / 1000 * F.lit(price_out)
    return stats.select("n", F.round(cost, 6).alias("cost"), F.round(F.when(F.col("n") > 0, cost / F.col("n")).otherwise(0.0), 9).alias("cost_per_record"))


def simple_tokens(c: Column) -> Column:
    """Tokens of a text without a vocabulary: Latin words and numbers, each other letter by itself; 0 for blank."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), 0)), F.lit(0))


def bpe_tokens(c: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of a text by a byte-level BPE vocabulary file, without special tokens; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return count(c)


@lru_cache(4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def group_means(df: DataFrame, group: str, batch: str, value: str) -> DataFrame:
    """(group, mean_of_means): the mean of batch means, which is not the mean of rows."""
    per = df.groupBy(group, batch).agg(F.avg(value).alias("m"))
    return per.groupBy(group).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


def success_rate(df: DataFrame, group: str, score: str, threshold: float, queries: str | None = None) -> DataFrame:
    """(group, n, rate, avg_score, avg_queries): share of attacks that end below a similarity, and the mean of their queries if given."""
    more = [F.round(F.avg(queries), 6).alias("avg_queries")] if queries else []
    return df.groupBy(group).agg(*more, F.count("*").alias("n"), F.round(F.avg((F.col(score) < threshold).cast("double")), 6).alias("rate"), F.round(F.avg(score), 6).alias("avg_score"))


def deltas(pre: DataFrame, post: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pre, post, delta): a metric before and after; a missing one counts as 0."""
    a, b = pre.select(key, F.col(value).alias("pre")), post.select(key, F.col(value).alias("post"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.coalesce("pre", F.lit(0.0)).alias("pre"), F.coalesce("post", F.lit(0.0)).alias("post")).withColumn("delta", F.round(F.col("post") - F.col("pre"), 6))


def running_best(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """df with best_before (least value of earlier rows of the group) and is_best."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("best_before", F.min(value).over(w))
    return out.withColumn("is_best", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))
