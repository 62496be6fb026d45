"""Offline stand-ins for models: terms without a segmenter, and hashed character n-grams as vectors.

A real encoder comes as any function from a Series of texts to a Series of vectors; see `encoder_udf`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(c: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Lower-case Latin words, numbers and runs of Han of two characters or more; null gives an empty array."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z]+|[一-鿿]+"), 0), lambda x: F.length(x) > 1)
    return F.array_except(found, F.array(*[F.lit(b) for b in blocked])) if blocked else found


#: Scripts whose words are parted by blanks; the others come as runs of one script.
WORDED = ("Latin", "Greek", "Cyrillic", "Hangul", "Arabic", "Hebrew", "Devanagari")


def script_terms(c: Column) -> Column:
    """As `terms`, of every script: accented and other words, runs of Han, of kana and of Thai; repeated ones stay."""
    words = "".join(rf"\p{{Is{s}}}" for s in WORDED)
    runs = rf"[0-9{words}]+|\p{{IsHan}}+|[\p{{IsHiragana}}\p{{IsKatakana}}ー]+|\p{{IsThai}}+"
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(runs), 0), lambda x: F.length(x) > 1)


def hashed_vector(c: Column, dims: int = 64, n: int = 2) -> Column:
    """Counts of hashed character n-grams, in the JVM; a text shorter than n gives zeros, null gives null."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    slots = F.transform(F.filter(at, lambda i: F.length(c) >= n), lambda i: F.pmod(F.xxhash64(F.substring(c, i, F.lit(n))), F.lit(dims)))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    return F.when(c.isNotNull(), vector)


def encoder_udf(load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[Column], Column]:
    """An encoder as a UDF over Arrow batches; `load` runs once in each Python worker's task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return encode
