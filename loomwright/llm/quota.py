"""Problem 6: a sample whose category shares follow given targets.

Quotas go top down over a tree of categories. At the top each category asks for
max(minimum, floor(share * n + 0.5)) rows; below, a node asks the same of each of its children,
whatever they hold. What a node cannot give is passed first to its siblings, by the same weights,
as far as they have rows left; what they cannot give either is their parent's unmet quota and goes on
to the parent's siblings, so to the node's cousins, and so up to the top, where it is the
category's reported shortfall and goes to the other categories by target share. At the leaves
rows are drawn by the dense rank of a permuted (hashed) key.

Only counts move: one row a leaf after a map-side sum, gathered by category. Ranking never sorts a
whole leaf in a task: rows fall into 4,096 ranges of the permuted key, whole ranges below the
quota are taken by their counts, and only rows of the one range where the quota ends are ranked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.operators.sampling import permuted
from loomwright.session import cut, small


def clean_category(c: Column) -> Column:
    """A category without white space and punctuation at its ends; null stays null."""
    edge = r"[\s\p{P}\p{S}\p{Z}\p{C}]+"
    return F.regexp_replace(c.cast("string"), f"(?U)^{edge}|{edge}$", "")


def share_out(total: int, weights: list[float], caps: list[int]) -> list[int]:
    """`total` split by weight, none above its cap; whole rows by largest remainder, ties by position.

    What the caps turn away goes to the others by weight, as long as there is room: all that are below
    their cap get the same number of rows a weight.
    """
    left = min(total, sum(caps))
    if left <= 0:
        return [0] * len(caps)
    weights = [max(float(w), 1e-12) for w in weights]
    order = sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i))
    full, open_, level = 0, sum(weights), None
    for i in order:
        level = (left - full) / open_
        if level <= caps[i] / weights[i]:
            break
        full, open_, level = full + caps[i], open_ - weights[i], None
    exact = [float(c) if level is None else min(float(c), level * w) for c, w in zip(caps, weights)]
    got = [int(x + 1e-9) for x in exact]
    rest = left - sum(got)
    for i in sorted(range(len(caps)), key=lambda i: (-round(exact[i] - got[i], 6), i)):
        if rest > 0 and got[i] < caps[i]:
            got[i] += 1
            rest -= 1
    return got


def descend(leaves: list[tuple], quota: int) -> dict[tuple, int]:
    """Quota of a category to its leaves, (path, rows) each.

    Down: every node asks its children for equal parts of what it was asked for. Up: what a node's children lack is given to
    those of them with rows left, and only what none of them has is passed on, to the node's siblings.
    """
    out: dict[tuple, int] = {}

    def give(rows: list[tuple], depth: int, asked: int) -> None:
        if len(rows) == 1 and depth == len(rows[0][0]):
            out[rows[0][0]] = asked
            return
        kids: dict = {}
        for r in rows:
            kids.setdefault(r[0][depth], []).append(r)
        names = sorted(kids, key=lambda k: (k == "", k))
        have = [sum(n for _, n in kids[k]) for k in names]
        for k, q in zip(names, share_out(asked, [1.0] * len(names), have)):
            if q:
                give(kids[k], depth + 1, q)

    if quota > 0 and leaves:
        give(leaves, 0, quota)
    return out


def top_quotas(goals: list[tuple[str, float, int, int]], n: int) -> list[tuple[str, int, int, int, int]]:
    """(category, wanted, available, quota, shortfall) of (category, share, minimum, available), in order of share.

    A category gives what it has of what it is asked for; the rest is its shortfall and is passed to the others.
    Where the minima ask for more than n, those above their minimum give way, by what they have above it.
    """
    goals = sorted(goals, key=lambda g: (-g[1], g[0]))
    wanted = [max(int(m), int(s * n + 0.5)) for _, s, m, _ in goals]
    given = [min(w, g[3]) for w, g in zip(wanted, goals)]
    unmet = [w - q for w, q in zip(wanted, given)]
    missing = n - sum(given)
    if missing > 0:
        given = [q + x for q, x in zip(given, share_out(missing, [g[1] for g in goals], [g[3] - q for g, q in zip(goals, given)]))]
    elif missing < 0:
        room = [max(0, q - int(g[2])) for q, g in zip(given, goals)]
        given = [q - x for q, x in zip(given, share_out(-missing, [float(r) for r in room], room))]
    return [(g[0], w, g[3], q, u) for g, w, q, u in zip(goals, wanted, given, unmet)]


def _prepare(rows: DataFrame, category: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"__l{i}" for i in range(len(levels) + 1)]
    cols = [F.coalesce(clean_category(F.col(c)), F.lit("")) for c in [category, *levels]]
    return rows.withColumns(dict(zip(names, cols))), names


def quota_report(rows: DataFrame, targets: DataFrame, fraction: float = 0.2, category: str = "category") -> DataFrame:
    """(category, wanted, available, quota, shortfall): one row a target category.

    wanted is max(min_rows, floor(share * n + 0.5)), n = floor(fraction * rows + 0.5); quota what is
    drawn of it in the end, with what others passed on; shortfall the quota it had to pass on. Null, blank and
    unlisted categories are no target, but their rows count for n. Repeated rows count each time; a category listed twice counts
    with its larger figures; empty tables give shortfalls of the whole minimum.
    """
    tagged, _ = _prepare(rows, category, [])
    counts = tagged.groupBy("__l0").agg(F.count("*").alias("have"))
    goal = targets.select(clean_category(F.col("category")).alias("__l0"), "target_share", "min_rows").where("__l0 is not null and __l0 <> ''")
    goal = goal.groupBy("__l0").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("long").alias("least"))
    listed = goal.join(counts, "__l0", "left").crossJoin(F.broadcast(counts.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("rows"))))

    def run(f: pd.DataFrame) -> pd.DataFrame:  # one row a listed category
        goals = [(c, s, m, int(h)) for c, s, m, h in zip(f["__l0"], f["share"], f["least"], f["have"])]
        got = top_quotas(goals, int(fraction * int(f["rows"].iat[0]) + 0.5))
        return pd.DataFrame(got, columns=["category", "wanted", "available", "quota", "shortfall"])

    return listed.select("__l0", "share", "least", F.coalesce("have", F.lit(0)).alias("have"), "rows").groupBy().applyInPandas(run, "category string, wanted long, available long, quota long, shortfall long")


def quota_sample(rows: DataFrame, targets: DataFrame, key: str, fraction: float = 0.2, category: str = "category", levels: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The rows drawn, with all their columns; see quota_report for the shares.

    Rows are taken in the order of md5(key, seed), ties by all columns' digest, and of wholly equal rows one
    after the other; so equal inputs draw equal samples and a repeated row may be drawn as often as it occurs.
    """
    tagged, names = _prepare(rows, category, levels or [])
    report = quota_report(rows, targets, fraction, category).select(F.col("category").alias("__l0"), "quota")
    counts = tagged.groupBy(*names).agg(F.count("*").alias("n")).join(F.broadcast(report), "__l0")

    def run(f: pd.DataFrame) -> pd.DataFrame:  # the leaf counts of one category
        leaves = [(tuple(r), int(n)) for r, n in zip(f[names[1:]].itertuples(index=False), f["n"])]
        got = descend(leaves, int(f["quota"].iat[0])) if len(names) > 1 else {(): int(f["quota"].iat[0])}
        return pd.DataFrame([(f["__l0"].iat[0], *p, q) for p, q in got.items()], columns=[*names, "__q"])

    plan = counts.groupBy("__l0").applyInPandas(run, ", ".join(f"{n} string" for n in names) + ", __q long")
    leaves = small(cut(plan.where("__q > 0")))
    h = permuted(F.col(key), seed)
    tagged = tagged.join(leaves, names).withColumns({"__h": h, "__b": F.substring(h, 1, 3)})
    per = tagged.groupBy(*names, "__b").agg(F.count("*").alias("__n"), F.max("__q").alias("__q"))
    before = F.sum("__n").over(Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    cuts = per.withColumn("__before", F.coalesce(before, F.lit(0))).where("__before < __q").select(*names, "__b", (F.col("__q") - F.col("__before")).alias("__take"), "__n")
    drawn = tagged.drop("__q").join(cuts, [*names, "__b"])
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    rank = F.dense_rank().over(Window.partitionBy(*names, "__b").orderBy("__h", "__tie", "__copy"))
    part = drawn.where("__n > __take").withColumns({"__tie": tie, "__copy": F.monotonically_increasing_id()}).withColumn("__r", rank).where("__r <= __take")
    return drawn.where("__n <= __take").unionByName(part.drop("__r", "__tie", "__copy")).select(*[f"`{c}`" for c in rows.columns])
