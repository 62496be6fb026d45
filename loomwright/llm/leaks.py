"""Problem 4: records that occur, exactly or almost, in two splits.

Content-defined chunks. A record (its fields joined, in one form) is cut where a rolling hash of
a few characters hits a pattern, so an edit changes only the chunks it touches. Chunk digests are
joined across splits; the summed lengths of shared chunks give overlap fractions.

The join is a prefix filter on both sides. A record's chunks are ordered by how many training
records have them (counted by digest buckets, which is an order all the same), rare ones first; its
head is its first chunks up to 1 - TAIL of its length. Chunks outside a head make up at most TAIL of
its record, and what two records share outside either head is the end of one order, so two records
with an overlap of OVERLAP or more share at least OVERLAP - TAIL of the longer one by the chunks that
are in both heads. A chunk of a common prompt stands last and hardly ever meets another, and no
overlap of OVERLAP or more is lost.

Pairs of heads that meet grow faster than the table, so none is written: the chunks of the evaluation
records are a table of blocks, and each task that scans training records reads block after block
from the shared folder, sums what meets in memory, and gives out only pairs whose whole overlap is
OVERLAP or more. Equal records of a task are one. What remains is checked by its texts, field by field.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import classes
from loomwright.session import cut, small, spread, widen

WINDOW, MEAN = 4, 6
#: Overlap by shared chunk length that makes a pair a candidate, and the part of a record outside its head.
OVERLAP, TAIL = 0.5, 0.4
#: Training chunks are counted by so many first bits of their digests; characters cut up at once; evaluation records a block,
#: training records that meet a block at once, and chunks met that are summed at once. No result depends on them.
COUNTER_BITS, CUT_AT_ONCE, BLOCK, BATCH, MET = 23, 500_000, 40_000, 20_000, 2_000_000
#: Least similarity (Dice of character trigrams) of the prompts and of the outputs of a copy.
PROMPT_LEAST, OUTPUT_LEAST = 0.75, 0.7

_KEEP = re.compile(r"[^\W_]+")
_NUMBERS = re.compile(r"\d+")


def one_form(text: str | None) -> str:
    """Letters and digits only: width, case, space and punctuation are no difference."""
    return "".join(_KEEP.findall(unicodedata.normalize("NFKC", text or "").casefold()))


#: Odd base of the digests, and its inverse modulo 2**64: a chunk's digest is a polynomial of its letters, taken from sums over the whole text.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    out = []
    for x in (_BASE, _INVERSE):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def cut_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, digest, length) of the content-defined chunks of texts none of which is empty, in order."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    up, down = _powers(1 << max(10, (n + 1).bit_length()))
    last = np.cumsum([len(t) for t in texts])
    ends = last
    if n > WINDOW:
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            h = h * np.uint64(0x100000001B3) + c[j : n - WINDOW + 1 + j]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        found = np.flatnonzero(h % np.uint64(MEAN) == 0)
        found = found[found + WINDOW < last[np.searchsorted(last, found, "right")]] + WINDOW  # begins and ends within one text
        ends = np.sort(np.append(found, last))
    starts = np.append(0, ends[:-1])
    sums = np.append(np.uint64(0), np.add.accumulate((c + np.uint64(1)) * down[:n]))
    digest = (sums[ends] - sums[starts]) * up[starts]
    lengths = ends - starts
    digest = (digest ^ (digest >> np.uint64(29)) ^ lengths.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.searchsorted(last, starts, "right"), (digest ^ (digest >> np.uint64(32))).view(np.int64), lengths


def chunk_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, digest, length), by text and digest: a chunk that a text has twice counts once with both lengths."""
    parts, at = [(np.zeros(0, np.int64),) * 3], 0
    while at < len(texts):
        to, chars = at + 1, len(texts[at])
        while to < len(texts) and chars + len(texts[to]) <= CUT_AT_ONCE:
            chars, to = chars + len(texts[to]), to + 1
        owner, digest, n = cut_places(texts[at:to])
        order = np.lexsort((digest, owner))
        owner, digest, n = owner[order], digest[order], n[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])))
        parts.append((owner[first] + at, digest[first], np.add.reduceat(n, first)))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def chunks(text: str) -> list[tuple[int, int]]:
    """(digest, length) of the content-defined chunks of a text."""
    return list(zip(*(x.tolist() for x in cut_places([text])[1:]))) if text else []


def dice(a: str, b: str) -> float:
    """Dice of the multisets of character trigrams; 1 for equal texts, even short ones."""
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def is_copy(prompt_a: str, output_a: str, prompt_b: str, output_b: str) -> bool:
    """Whether two records in one form are the same as a whole or a lightly edited copy: other numbers make another answer."""
    here, there = Counter(_NUMBERS.findall(output_a)), Counter(_NUMBERS.findall(output_b))
    if here - there and there - here:  # numbers changed, not only left out or moved
        return False
    return dice(output_a, output_b) >= OUTPUT_LEAST and dice(prompt_a, prompt_b) >= PROMPT_LEAST


def _buckets(digests: np.ndarray) -> np.ndarray:
    return (digests.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _open(file: str) -> pq.ParquetFile:
    fs, path = pa.fs.FileSystem.from_uri(file)
    return pq.ParquetFile(fs.open_input_file(path))


@lru_cache(1)
def _counters(files: tuple[str, ...]) -> np.ndarray:
    """How many training records have the chunks of each bucket, from the table written of it."""
    out = np.zeros(1 << COUNTER_BITS, np.int32)
    for f in files:
        for b in _open(f).iter_batches(1 << 20, use_threads=False):
            out[b.column(0).to_numpy()] = np.minimum(b.column(1).to_numpy(), np.iinfo(np.int32).max)
    return out


def in_head(owner: np.ndarray, digest: np.ndarray, n: np.ndarray, sizes: np.ndarray, count: np.ndarray, tail: float) -> tuple[np.ndarray, np.ndarray]:
    """(order of the chunks in which those of a record follow each other, rare ones first; whether each one, so ordered, is in its record's head)."""
    order = np.lexsort((digest, count, owner))
    n, owner = n[order], owner[order]
    before = np.cumsum(n) - n
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)]
    before -= np.repeat(before[starts], np.diff(np.append(starts, len(owner))))
    return order, before <= (1 - tail) * sizes[owner]


def _once(batch: pa.RecordBatch, seen: set[int]) -> tuple[np.ndarray, list[str]]:
    """(ids, texts) of the records of a batch (id, p, o) that were not seen before."""
    ids = batch.column(0).to_pylist()
    rows = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
    p, o = (batch.column(k).take(pa.array(rows, pa.int64())).to_pylist() for k in (1, 2))
    return np.array([ids[i] for i in rows], np.int64), [a + b for a, b in zip(p, o)]


def _blocks(files: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The evaluation records in blocks: (ids, sizes, bounds of their chunks, chunks, lengths; chunks, owners and lengths of their heads, by chunk)."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        _, rows = np.unique(t["id"].to_numpy(), return_index=True)
        t = t.take(pa.array(rows)).combine_chunks()
        ids, sizes, head, chunk, n = (t[c].combine_chunks() for c in ("id", "size", "head", "chunk", "n"))
        bounds = np.append(0, np.cumsum(chunk.value_lengths().to_numpy()))
        digest, n = chunk.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)
        at = _spans(bounds[:-1], head.to_numpy())
        by = at[np.argsort(digest[at], kind="stable")]
        return ids.to_numpy(), sizes.to_numpy(), bounds, digest, n, digest[by], (np.searchsorted(bounds, by, "right") - 1), n[by]

    for f in files:
        for b in _open(f).iter_batches(BLOCK, use_threads=False):
            held.append(b)
            if sum(map(len, held)) >= BLOCK:
                yield block()
                held = []
    if sum(map(len, held)):
        yield block()


def _spans(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + many[i], one after another."""
    return np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)


def _overlapping(ids: np.ndarray, texts: list[str], files: tuple[str, ...], counters: np.ndarray, overlap: float, tail: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(evaluation ids, training ids) of all pairs with an overlap of the given size or more, of these training records."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, digest, n = chunk_sets(texts)
    order, head = in_head(owner, digest, n, sizes, counters[_buckets(digest)], tail)
    head = np.sort(order[head])
    values, code = np.unique(digest, return_inverse=True)
    whole = owner * len(values) + code  # sorted, as chunk_sets is
    own_code, own, own_n = code[head], owner[head], n[head]
    for o_ids, o_sizes, bounds, chunk, o_n, heads, o_owner, head_n in _blocks(files):
        low, high = (np.searchsorted(heads, values, side) for side in ("left", "right"))
        many = (high - low)[own_code]
        met = np.flatnonzero(many)
        total = np.cumsum(many[met])
        at = 0
        while at < len(met):
            # a training record is summed whole: pieces end where another begins
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + MET, "right"))
            to = max(to, at + 1)
            while to < len(met) and own[met[to]] == own[met[to - 1]]:
                to += 1
            rows = met[at:to]
            at = to
            place = _spans(low[own_code[rows]], many[rows])
            rows = np.repeat(rows, many[rows])
            a, b = own[rows], o_owner[place]
            x, y = sizes[a], o_sizes[b]
            longer = np.maximum(x, y)
            ok = (np.minimum(x, y) >= overlap * longer) & (ids[a] != o_ids[b])
            pair = (a[ok] * len(o_ids) + b[ok]) << 31 | np.minimum(head_n[place[ok]], own_n[rows[ok]])
            pair.sort()
            shared, pair = pair & 0x7FFFFFFF, pair >> 31
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))[: len(pair)]
            if not len(first):
                continue
            shared, pair = np.add.reduceat(shared, first), pair[first]
            a, b = pair // len(o_ids), pair % len(o_ids)
            ok = shared >= (overlap - tail) * np.maximum(sizes[a], o_sizes[b])
            a, b = a[ok], b[ok]
            for i in range(0, len(a), 20_000):
                yield from _whole(a[i : i + 20_000], b[i : i + 20_000], values, whole, n, sizes, bounds, chunk, o_n, o_sizes, overlap, ids, o_ids)


def _whole(a, b, values, whole, n, sizes, bounds, chunk, o_n, o_sizes, overlap, ids, o_ids) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) of a block whose overlap by all their chunks is large enough."""
    many = bounds[b + 1] - bounds[b]
    place = _spans(bounds[b], many)
    row = np.repeat(np.arange(len(a)), many)
    code = np.searchsorted(values, chunk[place])
    code[code == len(values)] = 0
    known = values[code] == chunk[place]
    place, row, code = place[known], row[known], code[known]
    key = a[row] * len(values) + code
    at = np.searchsorted(whole, key)
    at[at == len(whole)] = 0
    hit = whole[at] == key
    shared = np.bincount(row[hit], np.minimum(n[at[hit]], o_n[place[hit]]), len(a))
    ok = shared / np.maximum(sizes[a], o_sizes[b]) >= overlap
    yield o_ids[b[ok]], ids[a[ok]]


def _linked(rows: DataFrame, key: str, prompt: list[str], output: str, split: str, train: str, overlap: float, tail: float) -> tuple[DataFrame, DataFrame]:
    """((key, is_train, split, rec) of each row, (other, train, overlap) of the records that are copies); a record is known by the digest of its fields."""
    kind = rows.schema[key].dataType.simpleString()
    src = rows.where(F.col(split).isNotNull()).select(F.col(key).alias("key"), (F.col(split) == train).alias("is_train"), F.col(split).alias("split"), F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in prompt]).alias("prompt"), F.coalesce(F.col(output).cast("string"), F.lit("")).alias("output"))

    def tidy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p, o = f["prompt"].map(one_form), f["output"].map(one_form)
            digests = [xxhash.xxh128_digest(f"{a}\n{b}") for a, b in zip(p, o)]
            yield pd.DataFrame({"key": f["key"], "is_train": f["is_train"], "split": f["split"], "rec": digests, "p": p, "o": o})

    tidied = cut(widen(src).mapInPandas(tidy, f"key {kind}, is_train boolean, split string, rec binary, p string, o string").where("p <> '' or o <> ''"))
    # the id of the join is half the digest: should two records share it, both are checked by their texts
    texts = tidied.select(F.xxhash64("rec").alias("id"), "is_train", "rec", "p", "o")
    side = lambda flag: widen(texts.where(flag).select("id", "p", "o"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(1 << COUNTER_BITS, np.int32), set()
        for batch in batches:
            bucket, n = np.unique(_buckets(chunk_sets(_once(batch, seen)[1])[1]), return_counts=True)
            out[bucket] += n.astype(np.int32)
        found = np.flatnonzero(out)
        for i in range(0, len(found), 100_000):
            x = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(out[x], pa.int32())], ["bucket", "n"])

    counted = tuple(cut(side("is_train").mapInArrow(count, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))).inputFiles())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = _counters(counted), set()
        for batch in batches:
            ids, cut_texts = _once(batch, seen)
            sizes = np.array([len(t) for t in cut_texts], np.int64)
            owner, digest, n = chunk_sets(cut_texts)
            times = counters[_buckets(digest)]
            order, head = in_head(owner, digest, n, sizes, times, tail)
            live = times[order] > 0  # what no training record has can't be shared, but stands for length not shared
            order, head = order[live], head[live]
            many, heads = (np.bincount(owner[x], minlength=len(ids)) for x in (order, order[head]))
            bounds = pa.array(np.append(0, np.cumsum(many)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order], t)) for x, t in ((digest, pa.int64()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(heads, pa.int32()), *lists], ["id", "size", "head", "chunk", "n"])

    blocks = tuple(cut(side("not is_train").mapInArrow(cut_up, "id long, size long, head int, chunk array<long>, n array<int>")).inputFiles())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, seen = [], [], set()

        def found() -> Iterator[pa.RecordBatch]:
            for other, own in _overlapping(np.concatenate(ids), held, blocks, _counters(counted), overlap, tail):
                yield pa.RecordBatch.from_arrays([pa.array(other), pa.array(own)], ["other", "train"])

        for batch in batches:
            some, more = _once(batch, seen)
            ids, held = [*ids, some], [*held, *more]
            if len(held) >= BATCH:
                yield from found()
                ids, held = [], []
        if held:
            yield from found()

    met = cut(side("is_train").mapInArrow(meet, "other long, train long").distinct())
    wanted = cut(met.select(F.explode(F.array("other", "train")).alias("id")).distinct())
    sought = cut(texts.join(small(wanted), "id", "left_semi").select("id", "rec", "p", "o").dropDuplicates(["rec"]))
    both = met.join(sought.selectExpr("id as other", "rec as rec_a", "p as pa", "o as oa"), "other").join(sought.selectExpr("id as train", "rec as rec_b", "p as pb", "o as ob"), "train")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, pa, oa, pb, ob in zip(f["rec_a"], f["rec_b"], f["pa"], f["oa"], f["pb"], f["ob"]):
                if a != b and is_copy(pa, oa, pb, ob):
                    here, there = Counter(), Counter()
                    for c, text in ((here, pa + oa), (there, pb + ob)):
                        for d, n in chunks(text):
                            c[d] += n
                    part = sum((here & there).values()) / max(len(pa) + len(oa), len(pb) + len(ob))
                    if part >= overlap:
                        out.append((a, b, part))
            yield pd.DataFrame(out, columns=["other", "train", "overlap"])

    near = spread(both).mapInPandas(check, "other binary, train binary, overlap double")
    sides = tidied.groupBy("rec").agg(F.bool_or("is_train").alias("in_train"), F.bool_or(~F.col("is_train")).alias("in_other"))
    same = sides.where("in_train and in_other").select(F.col("rec").alias("other"), F.col("rec").alias("train"), F.lit(1.0).alias("overlap"))
    return tidied.select("key", "is_train", "split", "rec"), cut(near.unionByName(same))


def cross_split_copies(rows: DataFrame, key: str, prompt: list[str], output: str, split: str, train: str = "train", overlap: float = OVERLAP, tail: float = TAIL) -> DataFrame:
    """(key_a, key_b, key_train, key_other, split, overlap): copies between train and any other split.

    overlap is the shared chunk length over the longer record's length. Null fields are empty;
    records empty in all fields have no copies; rows of a null split take no part. Repeated rows
    are paired each (`copy_classes` has them without pairs); an empty table gives an empty result.
    """
    tidied, linked = _linked(rows, key, prompt, output, split, train, overlap, tail)
    others = tidied.where("not is_train").select(F.col("key").alias("ko"), "split", F.col("rec").alias("other"))
    trains = tidied.where("is_train").select(F.col("key").alias("kt"), F.col("rec").alias("train"))
    return linked.join(others, "other").join(trains, "train").select(F.least("ko", "kt").alias(f"{key}_a"), F.greatest("ko", "kt").alias(f"{key}_b"), F.col("kt").alias(f"{key}_train"), F.col("ko").alias(f"{key}_other"), "split", F.round("overlap", 6).alias("overlap"))


def copy_classes(rows: DataFrame, key: str, prompt: list[str], output: str, split: str, train: str = "train", overlap: float = OVERLAP, tail: float = TAIL) -> DataFrame:
    """(key, split, class, links): each row that occurs in train and another split, with the class of records linked, and its number of copies on the other side.

    The class is the smallest key of its rows. Linear in the rows however often a record is repeated.
    """
    tidied, linked = _linked(rows, key, prompt, output, split, train, overlap, tail)
    links = linked.select(F.xxhash64("other").alias("a"), F.xxhash64("train").alias("b"))
    label = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).distinct().join(classes(links).withColumnRenamed("key", "rid"), "rid", "left").select("rid", F.coalesce("class", "rid").alias("c"))
    per = cut(tidied.groupBy(F.xxhash64("rec").alias("rid")).agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_other"), F.min("key").alias("least")))
    over = links.join(per.select(F.col("rid").alias("b"), "n_train"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("n_train").alias("of_other"))
    back = links.join(per.select(F.col("rid").alias("a"), "n_other"), "a").groupBy(F.col("b").alias("rid")).agg(F.sum("n_other").alias("of_train"))
    found = label.join(per, "rid").join(over, "rid", "left").join(back, "rid", "left")
    least = found.groupBy("c").agg(F.min("least").alias("class"))
    found = found.join(least, "c").select("rid", "class", "of_other", "of_train")
    out = tidied.withColumn("rid", F.xxhash64("rec")).join(found, "rid")
    return out.select(F.col("key").alias(key), "split", "class", F.coalesce(F.when(F.col("is_train"), F.col("of_train")).otherwise(F.col("of_other")), F.lit(0)).alias("links"))


def overlap_report(copies: DataFrame, rows: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """(split_name, source, records, copied): records of each split but train, and how many have a copy there."""
    found = copies.select(F.col(f"{key}_other").alias(key)).distinct().withColumn("hit", F.lit(1))
    return rows.where(F.col(split) != "train").select(key, F.col(split).alias("split_name"), F.col(source).alias("source")).join(found, key, "left").groupBy("split_name", "source").agg(F.count("*").alias("records"), F.count("hit").alias("copied"))
