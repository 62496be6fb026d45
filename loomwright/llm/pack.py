"""Problem 9: filling containers of fixed capacity with items of varying length.

Hierarchical residual packing. Each partition packs its own items best-fit, largest first, and
closes the bins that are nearly full. What stays open goes on as items of the next round, where
`fan_in` neighbouring partitions meet in one task, until one partition is left. If more than
`carry` bins a task stay open, fewer partitions meet, so that no task holds more, and the open bins are
dealt out anew for each round; rounds end when one saves no bin. So no task grows with the corpus, and
no bin is closed before it has met others in vain.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.encode import TOKENIZER_DIR, WORD_PATTERN, load_ranks
from loomwright.session import cut, widen

CAPACITY = 2048
#: A bin with at most this share of room left is closed.
SLACK = 0.005
FAN_IN = 8
#: Most open bins a task is given.
CARRY = 20_000

_counters: dict[str, object] = {}


def _counter(path: str):
    if path not in _counters:
        import tiktoken

        _counters[path] = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _counters[path]


def token_sizes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, n_tokens): tokens of each text; 0 for null and empty ones."""
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = _counter(path)
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["k", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    src = widen(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return src.mapInArrow(run, f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions, by best fit with the largest item first; ties by position, equal rooms first come, first filled.

    Bins stand in queues by the room they have left, at most `capacity` of them, so a step costs the same however many bins there are.
    """
    bins: list[list[int]] = []
    queues: dict[int, deque] = {}
    rooms: list[int] = []  # those with a bin, ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[i])
        if at < len(rooms):
            left = rooms[at]
            b = queues[left].popleft()
            if not queues[left]:
                del rooms[at], queues[left]
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            left -= sizes[i]
            if left not in queues:
                queues[left] = deque()
                insort(rooms, left)
            queues[left].append(b)
    return bins


_PART = "struct<doc:{kind},piece:int,token_start:long,token_end:long>"


def _round(capacity: int, level: int, last: bool, slack: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts: list[list] = []
        for f in frames:
            parts += [list(p) for p in f["parts"]]
        if not parts:
            return
        sized = [(sum(p["token_end"] - p["token_start"] for p in ps), ps[0]["doc"], ps[0]["piece"], ps) for ps in parts]
        sized.sort(key=lambda x: (-x[0], x[1], x[2]))  # the same order whenever a lost task runs again
        task = TaskContext.get().partitionId()
        rows = []
        for n, b in enumerate(best_fit([x[0] for x in sized], capacity)):
            fill = sum(sized[i][0] for i in b)
            rows.append([(level << 56) | (task << 32) | n, fill, last or capacity - fill <= slack * capacity, [p for i in b for p in sized[i][3]]])
        for at in range(0, len(rows), 5000):
            yield pd.DataFrame(rows[at : at + 5000], columns=["container_id", "fill", "closed", "parts"])

    return run


def pack(
    sizes: DataFrame,
    key: str = "doc_id",
    size: str = "n_tokens",
    capacity: int = CAPACITY,
    slack: float = SLACK,
    fan_in: int = FAN_IN,
    carry: int = CARRY,
) -> DataFrame:
    """(key, piece, container_id, token_start, token_end, container_offset) of every item.

    Only an item larger than the capacity is divided: into full pieces, each a container of its
    own, and one rest. Items of size 0 or null need no room: they come out once, with a null
    container and the range 0 to 0. Equal items are ordered by key; a repeated key with equal
    sizes gives as many rows as it has. An empty table gives an empty result.
    """
    kind = sizes.schema[key].dataType.simpleString()
    part = _PART.format(kind=kind)
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    items = sizes.select(F.col(key).alias("doc"), n.alias("n"))
    starts = F.expr(f"sequence(0L, n - 1, {capacity}L)")
    pieces = items.where("n > 0").select("doc", "n", F.posexplode(starts).alias("piece", "token_start")).withColumn("token_end", F.least(F.col("token_start") + capacity, F.col("n")))
    full = pieces.where(F.col("token_end") - F.col("token_start") == capacity)
    open_items = pieces.where(F.col("token_end") - F.col("token_start") < capacity).select(
        F.expr(f"array(cast(named_struct('doc', doc, 'piece', piece, 'token_start', token_start, 'token_end', token_end) as {part}))").alias("parts")
    )
    schema = f"container_id long, fill long, closed boolean, parts array<{part}>"
    parts = max(1, open_items.rdd.getNumPartitions())
    level, closed, before = 0, [], None
    while True:
        last = parts == 1
        bins = open_items.mapInPandas(_round(capacity, level, last, slack), schema)
        if last:
            closed.append(bins)
            break
        bins = cut(bins.withColumn("part", F.spark_partition_id()))
        n_open = bins.where("not closed").count()
        fewer = max(1, -(-parts // fan_in), -(-n_open // carry))
        if not n_open or fewer >= parts and before is not None and n_open >= before:  # this round saved no bin
            closed.append(bins.drop("part"))
            break
        closed.append(bins.where("closed").drop("part"))
        # neighbours meet; where bins are too many for that, they are dealt out by their digest, anew in each round
        to = F.least((F.col("part") * fewer / parts).cast("int"), F.lit(fewer - 1)) if fewer <= -(-parts // fan_in) else F.pmod(F.xxhash64("container_id", F.lit(level)), F.lit(fewer)).cast("int")
        open_items = bins.where("not closed").select("parts", to.alias("to")).repartitionById(fewer, "to").select("parts")
        parts, before, level = fewer, n_open, level + 1
    binned = closed[0]
    for c in closed[1:]:
        binned = binned.unionByName(c)
    out = binned.select("container_id", "parts", F.posexplode("parts").alias("i", "p")).select(
        F.col("p.doc").alias(key), F.col("p.piece").alias("piece"), "container_id", F.col("p.token_start").alias("token_start"), F.col("p.token_end").alias("token_end"),
        F.expr("aggregate(slice(parts, 1, i), 0L, (a, x) -> a + x.token_end - x.token_start)").alias("container_offset"),
    )
    # a full piece is a container of its own, with a negative id
    own = full.select(F.col("doc").alias(key), "piece", (-1 - F.monotonically_increasing_id()).alias("container_id"), "token_start", "token_end", F.lit(0).cast("long").alias("container_offset"))
    none = items.where("n = 0").select(F.col("doc").alias(key), F.lit(0).alias("piece"), F.lit(None).cast("long").alias("container_id"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end"), F.lit(None).cast("long").alias("container_offset"))
    return out.unionByName(own).unionByName(none)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Texts as training sequences of at most `capacity` tokens; see pack."""
    return pack(cut(token_sizes(docs, key, text, vocabulary, tokenizer_dir)), key, "n_tokens", capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room unused, and the fewest containers possible."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum(F.expr("token_end - token_start")).alias("fill"))
    return used.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.coalesce(F.max("fill"), F.lit(0)).alias("largest_fill"),
        F.round(1 - F.sum("fill") / (F.count("*") * capacity), 6).alias("unused_share"), F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least_containers"),
    )
