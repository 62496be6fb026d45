"""Venue ranks, code translation and enrichment by dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as tx


Source = tuple[DataFrame, str, str, str]


def venue_rank(papers: DataFrame, venue: str, ranks: list[Source | list[Source]], missing: str = "未找到") -> DataFrame:
    """papers with venue_rank: the distinct ranks found by upper-case name, joined by ';', in the order of the tables.

    ranks are (table, key column, rank column, order column), or a list of them of which the first that has the name counts;
    of a repeated key the last row's rank counts.
    """
    out = papers.withColumn("__v", tx.upper_key(F.col(venue)))
    names, found = [], []
    for group in ranks:
        own = []
        for dim, key, rank, order in group if isinstance(group, list) else [group]:
            name = f"__r{len(names)}"
            d = dim.select(tx.upper_key(F.col(key)).alias("__v"), F.struct(F.col(order).alias("o"), F.col(rank).alias("r")).alias("x")).where("__v is not null and __v <> ''")
            d = d.groupBy("__v").agg(F.max("x").alias("x")).select("__v", F.col("x.r").alias(name))
            out = out.join(d, "__v", "left")
            names.append(name)
            own.append(F.col(name))
        found.append(F.coalesce(*own))
    ranked = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ";")
    return out.withColumn("venue_rank", F.when(ranked != "", ranked).otherwise(missing)).drop("__v", *names)


def translate_codes(df: DataFrame, key: str, column: str, names: DataFrame, code: str, name: str, sep: str = ";") -> DataFrame:
    """(key, translated): a list of codes as names in order, unknown codes kept; null for an empty list."""
    codes = F.filter(F.transform(F.split(F.col(column), sep), tx.blank_trim), lambda x: x != "")
    parts = df.select(key, F.posexplode_outer(codes).alias("pos", "code"))
    j = parts.join(names.select(F.col(code).alias("code"), F.col(name).alias("name")), "code", "left")
    one = F.when(F.col("code").isNotNull(), F.struct("pos", F.coalesce("name", "code").alias("name")))
    return j.groupBy(key).agg(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["name"]), sep), F.lit("")).alias("translated"))


def enrich_first(*sources: tuple[Column, Column]) -> tuple[Column, Column]:
    """A pair of values, both from the first source that has a name."""
    pick = F.coalesce(*[F.when(a.isNotNull(), F.struct(a.alias("a"), b.alias("b"))) for a, b in sources])
    return pick["a"], pick["b"]


def search(papers: DataFrame, words: str, columns: list[str], year: Column, first: int, last: int, pages: int = 1, distinct: bool = False) -> DataFrame:
    """Rows of which a column holds the words, of the years first to last, once a page asked for: every page repeats the same search. distinct: once only."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.lower()))
    found = papers.where(hit & year.between(first, last))
    return found if distinct or pages == 1 else found.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
