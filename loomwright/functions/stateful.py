"""The few functions and metrics that built-in functions cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import math
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import text as tx

def _ngrams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu4(prediction: str | None, reference: str | None) -> float:
    """Sentence BLEU of white-space words, uniform weights, geometric smoothing of empty precisions, times 100."""
    p, r = (prediction or "").split(), (reference or "").split()
    if not p or not r:
        return 0.0
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        have = _ngrams(p, n)
        hits = sum((have & _ngrams(r, n)).values())
        total = max(1, len(p) - n + 1)
        if n == 1 and not hits:
            return 0.0
        if not hits:
            zeros += 1
        logs += math.log(hits / total if hits else 1 / (2**zeros * total))
    brevity = min(1.0, math.exp(1 - len(r) / len(p)))
    return round(100 * brevity * math.exp(logs / 4), 4)


def rouge_l(prediction: str | None, reference: str | None) -> float:
    """F of the longest common subsequence of white-space words, times 100."""
    p, r = (prediction or "").split(), (reference or "").split()
    if not p or not r:
        return 0.0
    row = [0] * (len(r) + 1)
    for w in p:
        diagonal = 0
        for j, x in enumerate(r, 1):
            diagonal, row[j] = row[j], diagonal + 1 if w == x else max(row[j], row[j - 1])
    a, b = row[-1] / len(p), row[-1] / len(r)
    return round(100 * 2 * a * b / (a + b + 1e-8), 4)


def _udf(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*cols)], dtype="float64" if isinstance(kind, T.DoubleType) else object)

    if f.__code__.co_argcount == 1:
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return F.pandas_udf(one, kind)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(two, kind)


def _nfkc(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFKC", s)


def _unescaped(s: str | None) -> str | None:
    return (html.unescape(s.strip()).strip() or None) if s is not None else None


nfkc = _udf(_nfkc, T.StringType())
html_unescape = _udf(_unescaped, T.StringType())
bleu4_column = _udf(bleu4, T.DoubleType())
rouge_l_column = _udf(rouge_l, T.DoubleType())


def normalize_text(c: Column) -> Column:
    """Text for matching, compatibility forms brought to one form first; see text.normalize_words for the rest."""
    return tx.normalize_words(nfkc(c))
