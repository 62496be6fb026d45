"""Similarity search: dense top-k in two tiers, fusion with sparse scores, tag imputation, TF-IDF.

Dense search is a blocked matrix product. Query and item rows are packed into blocks of a fixed
number of rows; each pair of blocks is one task of bounded memory that keeps only the best k of each
query. Neither side is broadcast or collected, and no pair of rows leaves a task unless it is among
the best k of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

from loomwright.functions import stateful as st
from loomwright.functions import text as tx
from loomwright.functions import vectors as vx
from loomwright.session import cut, widen

BLOCK = 4096


def _unit(v: pd.Series) -> np.ndarray:
    m = np.array(v.tolist(), dtype=np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def _blocked(q: DataFrame, t: DataFrame, block: int) -> PandasCogroupedOps:
    """The pairs of blocks of queries (key q) and items (key t)."""
    nq = max(1, -(-q.count() // block))
    nt = max(1, -(-t.count() // block))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    t = t.withColumn("tb", F.pmod(F.xxhash64("t"), F.lit(nt)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb"))


#: Numbers (of 8 bytes) that the queries' vectors may hold to be sent along with the items' scan.
SENT_NUMBERS = 4_000_000


def _best(keys: np.ndarray, right: np.ndarray, own: np.ndarray, left: np.ndarray, k: int, least: float) -> Iterator[tuple]:
    """(query, item, score) of the best k items of each query, items sorted by key."""
    for at in range(0, len(own), 512):
        part = own[at : at + 512]
        s = left[at : at + 512] @ right.T
        s[s < least] = -2
        s[part[:, None] == keys[None, :]] = -2
        n = min(k, s.shape[1])
        for i, row in enumerate(s):
            kth = np.partition(row, -n)[-n]
            hits = np.flatnonzero(row >= max(kth, -1))
            hits = hits[np.argsort(-row[hits], kind="stable")][:n]
            for j in hits:
                yield part[i], keys[j], float(row[j])


def cosine_candidates(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """(query_key, match_id, score): of each query its k nearest items with a cosine of `least` or more.

    An item with the query's own key is no match of it. Ties go to the smaller key. Rows with a null
    vector take no part. Queries of at most SENT_NUMBERS numbers, as measured, go to the tasks that scan the items, which
    are neither shuffled nor repeated; more of them meet the items in blocks.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    t = items.where(F.col(vector).isNotNull()).select(F.col(item_key).alias("t"), F.col(vector).cast("array<double>").alias("v"))
    kind = queries.schema[query_key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    schema = f"{query_key} {kind}, match_id {item_kind}, score double"
    width = q.agg(F.sum(F.size("v") + 2)).first()[0] or 0
    if width <= SENT_NUMBERS:
        sent = q.toPandas()
        if not len(sent):
            return q.sparkSession.createDataFrame([], schema + ", rank int")
        own, left = sent["q"].to_numpy(), _unit(sent["v"])

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in frames:
                if len(b):
                    b = b.sort_values("t", kind="stable")
                    yield pd.DataFrame(_best(b["t"].to_numpy(), _unit(b["v"]), own, left, k, least), columns=[query_key, "match_id", "score"])

        near = widen(t).mapInPandas(scan, schema)
    else:

        def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame([], columns=[query_key, "match_id", "score"])
            b = b.sort_values("t", kind="stable")
            return pd.DataFrame(_best(b["t"].to_numpy(), _unit(b["v"]), a["q"].to_numpy(), _unit(a["v"]), k, least), columns=[query_key, "match_id", "score"])

        near = _blocked(q, t, block).applyInPandas(score, schema)
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), "match_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tag_candidates(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, tag: str, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """(query_key, tag, score): of each query its k best tags; a tag scores as its nearest item, if that has a cosine of `least` or more.

    An item with the query's own key is no match of it. Ties go to the smaller tag. Rows with a null
    vector or tag take no part.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    t = items.where(F.col(vector).isNotNull() & F.col(tag).isNotNull()).select(F.col(item_key).alias("t"), F.col(tag).alias("tag"), F.col(vector).cast("array<double>").alias("v"))
    kinds = [queries.schema[query_key].dataType.simpleString(), items.schema[tag].dataType.simpleString()]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("tag", kind="stable").reset_index(drop=True)
            keys, tags, right = b["t"].to_numpy(), b["tag"].to_numpy(), _unit(b["v"])
            starts = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1]])
            for at in range(0, len(a), 512):
                part = a.iloc[at : at + 512]
                s = _unit(part["v"]) @ right.T
                s[part["q"].to_numpy()[:, None] == keys[None, :]] = -2
                for i, row in enumerate(np.maximum.reduceat(s, starts, axis=1)):
                    best = np.argsort(-row, kind="stable")[:k]
                    out += [(part["q"].iat[i], tags[starts[j]], float(row[j])) for j in best if row[j] >= max(least, -1)]
        return pd.DataFrame(out, columns=[query_key, tag, "score"])

    near = _blocked(q, t, block).applyInPandas(score, f"{query_key} {kinds[0]}, {tag} {kinds[1]}, score double")
    best = near.groupBy(query_key, tag).agg(F.max("score").alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), tag)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def hybrid_search(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, weights: DataFrame, key: str, k: int, threshold: float, alpha: float, block: int = BLOCK) -> DataFrame:
    """(query_key, rank, match_id, score): of each query the best k of all items by fused score, those of the threshold or more.

    weights has (key, term, w) of queries and items, as `tfidf` gives them; a row without any has the sparse
    score 0. Both scores are fused for every item before the cut, inside the tasks of the blocked product.
    An item with the query's own key is no match of it. Ties go to the smaller key. Rows with a null vector take no part.
    """

    def side(df: DataFrame, own: str, name: str) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select(F.col(own).alias(name), F.col(vector).cast("array<double>").alias("v"))
        sparse = weights.groupBy(F.col(key).alias(name)).agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
        return rows.join(sparse, name, "left").select(name, "v", "terms", "ws")

    kind = queries.schema[query_key].dataType.simpleString()

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("t", kind="stable").reset_index(drop=True)
            keys, right = b["t"].to_numpy(), _unit(b["v"])
            found: dict[str, list] = {}
            for j, (terms, ws) in enumerate(zip(b["terms"], b["ws"])):
                for term, x in zip(terms, ws) if terms is not None else ():
                    found.setdefault(term, []).append((j, x))
            postings = {term: (np.array([j for j, _ in p]), np.array([x for _, x in p])) for term, p in found.items()}
            for at in range(0, len(a), 512):
                part = a.iloc[at : at + 512]
                dense = (_unit(part["v"]) @ right.T + 1) / 2
                for i, (own, terms, ws) in enumerate(zip(part["q"], part["terms"], part["ws"])):
                    t = np.zeros(len(b))
                    for term, x in zip(terms, ws) if terms is not None else ():
                        if term in postings:
                            at_rows, xs = postings[term]
                            t[at_rows] += x * xs
                    row = (1 - alpha) * dense[i] + alpha * np.clip(t, 0.0, 1.0)
                    hits = np.flatnonzero((row >= threshold) & (keys != own))
                    hits = hits[np.argsort(-row[hits], kind="stable")][:k]
                    out += [(own, keys[j], float(row[j])) for j in hits]
        return pd.DataFrame(out, columns=[query_key, "match_id", "score"])

    near = _blocked(side(queries, query_key, "q"), side(items, item_key, "t"), block).applyInPandas(score, f"{query_key} {kind}, match_id {kind}, score double")
    r = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), "match_id"))
    return near.withColumn("rank", r).where(F.col("rank") <= k).select(query_key, "rank", "match_id", F.round("score", 6).alias("score"))


def cosine_topk_two_tier(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, k: int = 3, primary: float = 0.8, secondary: float = 0.73, keep_empty: bool = True) -> DataFrame:
    """(query_key, rank, match_id, score): the best k of the primary tier, or, if it is empty, of the secondary.

    A query without a match comes out once with nulls (keep_empty).
    """
    near = cosine_candidates(queries, items, query_key, item_key, vector, k, secondary)
    best = F.max("score").over(Window.partitionBy(query_key))
    tier = near.withColumn("__best", best).where((F.col("__best") < primary) | (F.col("score") >= primary)).drop("__best")
    out = tier.select(query_key, "rank", "match_id", F.round("score", 6).alias("score"))
    return queries.select(query_key).join(out, query_key, "left") if keep_empty else out


def match_records(matches: DataFrame, query_key: str) -> DataFrame:
    """(query_key, matches ARRAY<STRUCT<index, score>>) in order of rank; an empty array for none."""
    m = F.filter(F.sort_array(F.collect_list(F.struct("rank", "match_id", "score"))), lambda x: x["match_id"].isNotNull())
    return matches.groupBy(query_key).agg(F.transform(m, lambda x: F.struct(x["match_id"].alias("index"), x["score"].alias("score"))).alias("matches"))


def tfidf(docs: DataFrame, key: str, terms: Column, min_df: int = 2) -> DataFrame:
    """(key, term, w): smoothed idf, unit rows, over the terms (an array) of each document."""
    tokens = docs.select(key, F.explode(terms).alias("term")).where("term <> ''")
    tf = tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, key).select(key, "term", (F.col("w") / F.col("size")).alias("w"))


def idf_table(docs: DataFrame, key: str, terms: Column, min_df: int = 2) -> DataFrame:
    """(term, df, idf)."""
    tokens = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).where("term <> ''")
    n = docs.agg(F.count("*").alias("n"))
    df = tokens.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def hybrid_topk(pairs: DataFrame, query_key: str, item_key: str, cos: str, sparse: str, k: int, threshold: float, alpha: float) -> DataFrame:
    """(query_key, rank, item_key, score): fused scores of scored pairs, those above the threshold, best k."""
    s = pairs.withColumn("score", vx.fuse(F.col(cos), F.col(sparse), alpha)).where(F.col("score") >= threshold)
    r = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), item_key))
    return s.withColumn("rank", r).where(F.col("rank") <= k).select(query_key, "rank", item_key, F.round("score", 6).alias("score"))


def impute_tags(scored: DataFrame, row: str, part: str, tag: str, score: str, tiers: tuple[float, float, float] = (0.78, 0.70, 0.65), k: int = 3) -> DataFrame:
    """(row, tags): of each part its best k tags of the first tier, else of the second, else its best of the third.

    scored has (row, part, tag, score); a tag found by several parts, or several times in one, keeps its
    best score; tags are joined by '；' from best to worst.
    """
    first, second, third = tiers
    w = Window.partitionBy(row, part)
    r = F.row_number().over(w.orderBy(F.desc(score), tag))
    s = scored.groupBy(row, part, tag).agg(F.max(score).alias(score)).where(F.col(score) >= third).withColumn("r", r).where(F.col("r") <= k).withColumn("best", F.max(score).over(w))
    ok = F.when(F.col("best") >= first, F.col(score) >= first).when(F.col("best") >= second, F.col(score) >= second).otherwise(F.col("r") == 1)
    per = s.where(ok).groupBy(row, tag).agg(F.max(score).alias("s"))
    return per.groupBy(row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col(tag).alias("t")))), lambda x: x["t"]), "；").alias("tags"))


def fill_tags(rows: DataFrame, key: str, field: str, tags: str, encode: Callable[[Column], Column], tiers: tuple[float, float, float] = (0.78, 0.70, 0.65), k: int = 3) -> DataFrame:
    """(key, tags): tags for the rows that have none, by the similarity of their field to the tags of the others.

    A field is taken in parts (at list marks) and as a whole; each takes its best k tags of the first tier, else of the
    second, else its best of the third. A tag found again keeps the score it was first found with; tags come out from best to worst.
    `encode` turns texts into vectors. Texts and tags are encoded once each. Rows for which nothing is found don't come out.
    """
    vocabulary = rows.select(F.explode(F.split(F.col(tags), "[;；]+")).alias("t")).select(tx.non_blank(F.col("t")).alias("tag")).where("tag is not null").distinct()
    empty = rows.where(tx.is_blank(F.col(tags)) & ~tx.is_blank(F.col(field)))
    parts = F.filter(F.transform(F.split(F.col(field), r"[;；,，/、\\|]+"), tx.blank_trim), lambda x: x != "")
    asked = empty.select(key, F.posexplode(F.concat(parts, F.array(field))).alias("pos", "x")).select(key, "pos", st.normalize_text(F.col("x")).alias("text")).where("text <> ''")
    asked = cut(asked)  # else the encoder would clean a text again for every n-gram
    texts = asked.select("text").distinct().select(F.concat(F.lit("q:"), "text").alias("q"), encode(F.col("text")).alias("v"))
    named = cut(vocabulary.select("tag", st.normalize_text(F.col("tag")).alias("text")))
    items = named.select(F.concat(F.lit("t:"), "tag").alias("t"), encode(F.col("text")).alias("v"))
    near = cosine_candidates(cut(texts), cut(items), "q", "t", "v", k, tiers[2])
    best = F.max("score").over(Window.partitionBy("q"))
    ok = F.when(F.col("best") >= tiers[0], F.col("score") >= tiers[0]).when(F.col("best") >= tiers[1], F.col("score") >= tiers[1]).otherwise(F.col("rank") == 1)
    chosen = near.withColumn("best", best).where(ok).select(F.substring("q", 3, 2_000_000_000).alias("text"), F.substring("match_id", 3, 2_000_000_000).alias("tag"), "rank", "score")
    first = asked.join(chosen, "text").groupBy(key, "tag").agg(F.min(F.struct("pos", "rank", "score")).alias("x"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("x.score")).alias("s"), F.col("x.pos").alias("p"), F.col("x.rank").alias("r"), F.col("tag").alias("t"))))
    return first.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["t"]), "；").alias("tags"))


def term_export(idf: DataFrame) -> DataFrame:
    """(term, idf) of the terms in Han script only, rarest first."""
    return idf.where(F.col("term").rlike("^[一-鿿]+$")).select("term", "idf").orderBy(F.desc("idf"), "term")


def contains_search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of which a column holds the needle, case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.upper(F.coalesce(F.col(c), F.lit(""))).contains(needle.upper())
    return df.where(hit)
