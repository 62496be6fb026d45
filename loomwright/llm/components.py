"""Classes of linked keys: the smallest key each can be reached from, by rounds of hash-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut


def classes(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(key, class): every key that occurs in a link, with the smallest key of its class.

    Each round halves the way to the smallest key (label of the label); labels live in the
    shared checkpoint, never on the driver. Null keys, loops and repeated links do no harm.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("class")).withColumnRenamed("x", "key"))
    for _ in range(max_rounds):
        near = edges.join(label.withColumnRenamed("key", "y").withColumnRenamed("class", "c"), "y").groupBy("x").agg(F.min("c").alias("c"))
        step = label.join(near.withColumnRenamed("x", "key"), "key", "left").select("key", "class", F.least("class", "c").alias("new"))
        jump = label.select(F.col("key").alias("new"), F.col("class").alias("far"))
        nxt = cut(step.join(jump, "new", "left").select("key", F.coalesce(F.least("new", "far"), "new").alias("class"), (F.coalesce(F.least("new", "far"), "new") != F.col("class")).alias("moved")))
        label = nxt.select("key", "class")
        if not nxt.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"classes did not settle in {max_rounds} rounds")
