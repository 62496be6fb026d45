"""Problem 8: encoding texts with a byte-level BPE vocabulary.

A sorted list of distinct words is a trie walked depth first: two neighbours share the path of
their common prefix. At each byte of the path the walk keeps the *last token* of the encoding
of the path so far, so the encoding of a shared prefix is worked out once. The last token at a
byte is the only token that ends there and fits behind the last token of the path before it;
two tokens fit if BPE applied to their joined bytes gives just these two again.

Nothing is shuffled: each task holds the distinct words of one Arrow batch at a time, and the words
its worker met before, of which the memory is bounded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import widen

#: Where the vocabulary files lie; a parameter of every function below.
TOKENIZER_DIR = "/opt/tokenizers"

#: Words a worker remembers the encoding of; beyond it the memory starts anew, the result stays the same.
KNOWN_WORDS = 500_000

# Fixed value: the published pre-tokenisation pattern of this vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TrieEncoder:
    """Encodes words by a depth-first walk over the trie of the distinct words given."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._build_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.whole: dict[int, bool] = {}

    def _build_automaton(self) -> None:
        """The automaton that finds, at each byte, the longest token ending there."""
        go: list[dict[int, int]] = [{}]
        out = [-1]
        for tok, i in self.ranks.items():
            s = 0
            for b in tok:
                n = go[s].get(b)
                if n is None:
                    n = len(go)
                    go[s][b] = n
                    go.append({})
                    out.append(-1)
                s = n
            out[s] = i
        fail = [0] * len(go)
        #: of a token, the next shorter token that is its suffix
        shorter: dict[int, int] = {}
        queue = list(go[0].values())
        for s in queue:
            below = out[fail[s]]
            if out[s] < 0:
                out[s] = below
            else:
                shorter[out[s]] = below
            for b, n in go[s].items():
                f = fail[s]
                while f and b not in go[f]:
                    f = fail[f]
                fail[n] = go[f].get(b, 0) if go[f].get(b, 0) != n else 0
                queue.append(n)
        self.go, self.fail, self.out, self.shorter = go, fail, out, shorter
        self.length = {i: len(b) for b, i in self.ranks.items()}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: join the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _fit(self, before: int, tok: int) -> bool:
        key = before << 20 | tok
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merge(self.bytes_of[before] + self.bytes_of[tok]) == [before, tok]
        return known

    def _alone(self, tok: int) -> bool:
        known = self.whole.get(tok)
        if known is None:
            known = self.whole[tok] = self.merge(self.bytes_of[tok]) == [tok]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The token ids of each distinct word."""
        todo = sorted((w.encode("utf-8", "replace"), w) for w in set(words))
        go, fail, out, shorter, length = self.go, self.fail, self.out, self.shorter, self.length
        fits, fit = self.fits, self._fit
        states, last = [0], [-1]  # by depth: automaton state, last token
        done: dict[str, list[int]] = {}
        previous = b""
        for data, word in todo:
            shared = len(os.path.commonprefix((previous, data)))
            del states[shared + 1 :], last[shared + 1 :]
            s = states[shared]
            for depth in range(shared + 1, len(data) + 1):
                b = data[depth - 1]
                while s and b not in go[s]:
                    s = fail[s]
                s = go[s].get(b, 0)
                tok = out[s]
                while True:
                    n = length[tok]
                    if n == depth:
                        if n == 1 or self._alone(tok):
                            break
                    else:
                        before = last[depth - n]
                        ok = fits.get(before << 20 | tok)
                        if ok is None:
                            ok = fit(before, tok)
                        if ok:
                            break
                    tok = shorter[tok]
                states.append(s)
                last.append(tok)
            whole = self.ranks.get(data)
            if whole is not None:
                done[word] = [whole]
            else:
                ids, at = [], len(data)
                while at:
                    ids.append(last[at])
                    at -= length[last[at]]
                ids.reverse()
                done[word] = ids
            previous = data
        return done


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(load_ranks(path))
    return _encoders[path]


def encode_texts(texts: list[str | None], enc: TrieEncoder) -> list[list[int]]:
    import regex

    split = regex.compile(WORD_PATTERN).findall
    rows = [split(t) if t else [] for t in texts]
    words = {w for r in rows for w in r}
    if len(enc.known) + len(words) > KNOWN_WORDS:
        enc.known.clear()
    ids = enc.known
    ids |= enc.encode_words(words - ids.keys())
    return [[i for w in r for i in ids[w]] for r in rows]


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of each text, without special tokens.

    Null and empty texts give an empty list, white space its own tokens. Strings that look like
    special tokens are ordinary text. Repeated keys give one row each; other columns are ignored;
    an empty table gives an empty result.
    """
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            enc = enc or encoder(path)
            rows = encode_texts(batch.column(1).to_pylist(), enc)
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    src = widen(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return src.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
