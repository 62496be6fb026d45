"""Text generators and term extractors as injected callables, over Arrow batches, with retries and a written table to go on from."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.session import spread

#: Makes a client in a task; the client turns (system, prompt) into an answer.
Load = Callable[[], Callable[[str, str], str]]


def answers(df: DataFrame, key: str, system: Column, prompt: Column, load: Load, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, answer): what the client says to each prompt; an error is tried again with growing waits, and gives '' in the end.

    The client is made once a task. A null prompt gets ''; repeated keys an answer each.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for f in frames:
            client = client or load()
            out = []
            for s, p in zip(f["s"], f["p"]):
                said = ""
                for turn in range(retries if p is not None else 0):
                    try:
                        said = client(s or "", p) or ""
                        break
                    except Exception:  # noqa: BLE001 - any failure of a client
                        if turn + 1 < retries:
                            time.sleep(wait * 2**turn)
                out.append(said)
            yield pd.DataFrame({"k": f["k"], "answer": out})

    return spread(df.select(F.col(key).alias("k"), system.alias("s"), prompt.alias("p"))).mapInPandas(run, f"k {kind}, answer string").withColumnRenamed("k", key)


def answers_kept(df: DataFrame, key: str, system: Column, prompt: Column, load: Load, folder: str, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """As `answers`, by a table in `folder` under the digest of system and prompt: what is there and not '' is not asked again.

    A run that broke off goes on from what it wrote.
    """
    spark = df.sparkSession
    digest = F.md5(F.concat_ws("\u0000", F.coalesce(system, F.lit("")), F.coalesce(prompt, F.lit(""))))
    asked = df.select(key, digest.alias("digest"), system.alias("s"), prompt.alias("p"))
    schema = "digest string, answer string"
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    done = spark.read.schema(schema).parquet(folder).where("answer <> ''")
    new = asked.dropDuplicates(["digest"]).join(done, "digest", "left_anti")
    answers(new, "digest", F.col("s"), F.col("p"), load, retries, wait).write.mode("append").parquet(folder)
    known = spark.read.schema(schema).parquet(folder).groupBy("digest").agg(F.max("answer").alias("answer"))
    return asked.join(known, "digest", "left").select(key, F.coalesce("answer", F.lit("")).alias("answer"))


def extracted_terms(df: DataFrame, text: str, system: str, load: Load, least: int = 5, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(term): distinct terms that the client lists as JSON for the distinct texts of `least` characters or more; one letter and bare numbers are no terms."""
    texts = df.where(F.length(text) >= least).select(F.col(text).alias("t")).distinct()
    said = answers(texts, "t", F.lit(system), F.col("t"), load, retries, wait)
    found = said.select(F.explode(tx.json_list(F.col("answer"))).alias("x")).select(tx.blank_trim(F.col("x")).alias("term"))
    return found.where((F.length("term") > 1) & ~F.col("term").rlike(r"^[0-9]+\z")).distinct()


def preference_pairs(df: DataFrame, key: str, said: DataFrame, first: str, second: str) -> DataFrame:
    """(key, instruction, input, chosen, rejected): joint answers cut at their labels, beside the prompts they answer."""
    chosen, rejected = tx.between_labels(F.col("answer"), first, second)
    return df.join(said, key).select(key, tx.filled(F.col("instruction")).alias("instruction"), tx.filled(F.col("input")).alias("input"), chosen.alias("chosen"), rejected.alias("rejected"))
