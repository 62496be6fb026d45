"""Problem 10: sentence boundaries across languages and scripts.

Candidates are end marks outside quoted, bracketed or titled passages, line breaks, and the spaces
of scripts and texts without end marks. Line breaks and spaces are settled by fixed rules, and so are
end marks whose neighbours leave no doubt (`certain`). A maximum-entropy classifier (two classes: logistic)
decides the other end marks by their neighbours: how often the word before stands without a period, how often
what follows begins a sentence, case, digits, lengths, script, kind of mark. It is trained on
reliable boundaries of the corpus itself: marks before a blank line or list entry, full-width
marks, ordinary words before a frequent beginning; and reliable non-boundaries: marks before a small
letter, a comma or within a number.

The statistics of words cover all documents (a shuffled sum; only those above a share of all
words, a number bounded by 1 / share, go to the tasks). The classifier is fitted on the labelled candidates of at
most SAMPLE documents, those of the smallest hashed key. Splitting itself needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut, spread, widen

#: Documents whose reliable candidates the classifier is fitted on.
SAMPLE = 4000
#: A word is known to the tasks if it makes up this share of all words.
WORD_SHARE = 1e-5
_PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "〈": "〉", "[": "]", "［": "］", "〔": "〕", "„": "“", "«": "»", "{": "}", "｛": "｝"}
_CLOSERS = set(_PAIRS.values()) | {'"', "'"}
_STRONG, _DOTS = "。！？!?｡", "…"
_MARKS = re.compile(r"[。！？!?｡…．.]+")
_CJK = r"぀-ヿ㐀-鿿豈-﫿々〆"
_IS_CJK = re.compile(f"[{_CJK}]")
_THAI = re.compile(r"[฀-๿]")
# How a line of its own begins if it is a list entry or a heading.
_ENTRY = re.compile(r"\s*(?:[-–—*•·▪●○◦■□◆►▶※+](?=\s|[^\W\d_])|#{1,6}\s|[(（]\s*(?:\d{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z]|[ivx]{1,4})\s*[)）]|\d{1,3}(?:\.\d{1,3})+\.?(?=\s)|\d{1,3}\s*[.)）．、](?!\d)|[①-⑳❶-❿]|[一二三四五六七八九十]{1,3}、|第[\d一二三四五六七八九十百]+[章节条部分篇]|[QA]\d*[.:：]\s|【[^】\n]{1,20}】\s*$)")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|第[\d一二三四五六七八九十百]+[章节部篇]|\d{1,3}(?:\.\d{1,3})+\.?\s|[(（][一二三四五六七八九十]{1,3}[)）]|[一二三四五六七八九十]{1,3}、|[QA]\d+[.:：]\s)")
_MARK_ONLY = re.compile(r"[A-Z]?\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[一二三四五六七八九十]{1,3}")


def _opens(s: str, i: int) -> bool:
    return not s[i + 1 : i + 2].isspace() and not (i and s[i - 1].isalnum() and not _IS_CJK.match(s[i - 1]))


def _closes(s: str, i: int) -> bool:
    return not s[i - 1].isspace() and not (s[i + 1 : i + 2].isalnum() and not _IS_CJK.match(s[i + 1]))


_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_PAIRED = re.compile("[" + re.escape("".join({*_PAIRS, *_PAIRS.values(), '"', "’"})) + "]")


def protected(text: str) -> list[tuple[int, int]]:
    """Outermost quoted, bracketed and titled passages (start, end) of any length; none crosses a blank line.

    Straight quotes must look like an opening and a closing one: others may be inches or strays.
    """
    spans: list[tuple[int, int]] = []
    bounds = [0, *(x for m in _BLANK_LINE.finditer(text) for x in m.span()), len(text)]
    for base, top in zip(bounds[::2], bounds[1::2]):
        stack: list[tuple[str, int]] = []
        awaited: Counter = Counter()
        quote = -1
        found: list[tuple[int, int]] = []
        for m in _PAIRED.finditer(text, base, top):
            i, c = m.start(), m[0]
            if c == "’" and i > base and text[i - 1].isalpha() and not _closes(text, i):
                continue  # an apostrophe
            if c == '"':
                if quote < 0:
                    quote = i if _opens(text, i) else -1
                elif _closes(text, i):
                    found.append((quote, i + 1))
                    quote = -1
                elif _opens(text, i):
                    quote = i
            elif stack and c == _PAIRS[stack[-1][0]]:
                awaited[c] -= 1
                found.append((stack.pop()[1], i + 1))
            elif c in _PAIRS:
                if c == "‘" and i > base and text[i - 1].isalnum():
                    continue
                stack.append((c, i))
                awaited[_PAIRS[c]] += 1
            elif c in _CLOSERS and awaited[c] > 0:
                while c != _PAIRS[stack[-1][0]]:
                    awaited[_PAIRS[stack.pop()[0]]] -= 1
                awaited[c] -= 1
                found.append((stack.pop()[1], i + 1))
        end = -1
        for x, z in sorted(found, key=lambda x: (x[0], -x[1])):
            if x >= end:
                spans.append((x, z))
                end = z
    return spans


def word_before(text: str, at: int, floor: int) -> str:
    """The word, number or abbreviation that ends at `at`, however long."""
    i = at
    while i > floor and (text[i - 1].isalnum() or text[i - 1] in "_.'’-"):
        i -= 1
    while i < at and not text[i].isalnum():
        i += 1
    return text[i:at] if at > floor and text[at - 1].isalnum() else ""


_TOKEN = re.compile(rf"(?:(?![{_CJK}฀-๿])[^\W\d_])+|\d+")


def word_after(text: str, at: int) -> str:
    """The token that decides how a sentence begins: a Latin word, else two characters."""
    m = _TOKEN.match(text, at)
    return m[0] if m else text[at : at + 2]


def _line_units(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches between line breaks that end a unit; wrapped lines and quoted passages stay together."""
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n\r  \x0b\x0c\x85]+", text)]
    runs: list[list[tuple[int, int]]] = []
    for s, e in lines:
        gap = text[runs[-1][-1][1] : s] if runs else ""
        blank = not text[s:e].strip()
        if runs and not blank and len(re.findall(r"\r\n|\n|\r|[  \x0b\x0c\x85]", gap)) <= 1 and text[runs[-1][-1][0] : runs[-1][-1][1]].strip():
            runs[-1].append((s, e))
        else:
            runs.append([(s, e)])
    out: list[tuple[int, int]] = []
    for run in runs:
        width = max(len(text[s:e].rstrip()) for s, e in run)
        # most lines of a wrapped paragraph had no room for the next line's first word
        no_room = [len(text[s:e].rstrip()) + 1 + len((text[a:z].split(maxsplit=1) or [""])[0]) > width - 3 for (s, e), (a, z) in zip(run, run[1:])]
        if len(no_room) < 2 or sum(no_room) < 0.6 * len(no_room):
            width = 10**9
        start = run[0][0]
        for (s, e), nxt in zip(run, [*run[1:], None]):
            if nxt is None or not (any(a < e < z for a, z in spans) or _wrapped(text, s, e, nxt, width, s == start)):
                out.append((start, e))
                start = nxt[0] if nxt else e
    return out


def _wrapped(text: str, s: int, e: int, nxt: tuple[int, int], width: int, first: bool) -> bool:
    """Whether the line break behind text[s:e] only wraps a sentence (or leaves it to its end mark)."""
    line, after = text[s:e].rstrip(), text[nxt[0] : nxt[1]].lstrip()
    latin = not _IS_CJK.search(line[-2:]) and not _THAI.search(line[-2:]) and not _IS_CJK.match(after) and not _THAI.match(after)
    # greedy wrapping: the next word had no room on this line
    word = after.split(maxsplit=1)[0] if after else ""
    full = latin and width >= 30 and len(line) + 1 + len(word) > width - 3
    tail = re.sub(r"[”’」』）)】》\"']+$", "", line)
    if _ENTRY.match(text, nxt[0], nxt[1]):
        return full and word[:1].isdigit() and tail[-1:].isalpha()  # a number within a wrapped sentence
    if first and _HEADING.match(line) and len(line) <= 60 and not re.search(r"[。！？!?.][”’」』）)\"]*$", line):
        return False
    if tail[-1:] in "，,、；;：:-–—" and not _ENTRY.match(line):
        return True
    return latin and (after[:1].islower() or full)


#: Neighbours that speak for (1) or against (-1) a boundary by themselves; each is a feature of its own, and this its weight's sign before training.
SIGNS = {"last": 1, "closed": -1, "comma": -1, "decimal": -1, "numbering": -1, "joined": -1, "small": -1, "full width": 1, "own bracket": 1, "mark only": -1}
BASE = 18
FEATURES = BASE + len(SIGNS)
_AT = {name: BASE + i for i, name in enumerate(SIGNS)}
PRIOR = 4.0


_SPACES = re.compile(r"\s*")


def features(text: str, a: int, b: int, e: int, floor: int, quoted: bool, stats: dict[str, tuple[float, float]]) -> list[float]:
    """Of the candidate with marks text[a:b] that would end at e, where no neighbour tells by itself."""
    x = [0.0] * FEATURES
    prev = word_before(text, a, floor)
    nxt = _SPACES.match(text, e).end()
    after = text[nxt : nxt + 1]
    word = word_after(text, nxt) if nxt < len(text) else ""
    cjk_before = bool(_IS_CJK.match(text[a - 1 : a] or " "))
    low = prev.casefold().rstrip(".")
    # a short capitalised word is judged by how often it stands without a period, any other by what follows its period
    bare = stats.get(("w:" if len(low) <= 4 and prev[:1].isupper() else "c:") + low, (None, 0))[0]
    # an unknown word in Latin script is most likely a name: those seldom begin a sentence
    begins = stats.get("b:" + word, (-1.5 if word[:1].isalpha() and word.isascii() else 0.0, None))[0]
    x[0] = 1
    x[1] = 0 if word.isdigit() else begins
    x[2] = 2.0 if cjk_before else (bare if bare is not None else (1.0 if len(low) > 3 and "." not in low else -0.5))
    x[3] = word.islower()
    x[4] = after.isupper()
    x[5] = after.isdigit()
    x[6] = bool(_IS_CJK.match(after or " "))
    x[7] = prev[-1:].isdigit()
    x[8] = len(prev) == 1 and not cjk_before and not prev.isdigit()
    x[9] = any(c in _STRONG for c in text[a:b])
    x[10] = "…" in text[a:b] or text[a:b].count(".") > 1
    x[11] = not x[9] and not x[10]
    x[12] = quoted
    x[13] = nxt == e
    x[14] = after in _PAIRS or after == '"'
    x[15] = x[11] and cjk_before
    x[16] = "." in prev
    x[17] = after == ""
    return x


def candidates(text: str, s: int, z: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, bool]]:
    """(mark start, mark end, unit end, at a closing quote) of each run of end marks in text[s:z]."""
    k = 0
    entry = _ENTRY.match(text, s, z)
    for m in _MARKS.finditer(text, s, z):
        a, b = m.span()
        if entry and a < entry.end():  # the mark of a list entry
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] <= a < spans[k][1]:
            if text[b : spans[k][1]].strip("".join(_CLOSERS)) == "" and text[spans[k][0]] in "“‘「『\"„«（(":
                yield a, b, spans[k][1], True
            continue
        e = b
        while e < z and text[e] in _CLOSERS and not (text[e] in "\"'“" and e + 1 < z and text[e + 1].isalnum()):
            e += 1
        yield a, b, e, False


_HEAD_NUMBER = re.compile(r"(?:^|[\s;；:：,，、(（。])\d{1,3}$")


def telling(text: str, a: int, b: int, e: int, z: int, floor: int, quoted: bool) -> str | None:
    """The neighbour (a key of SIGNS) that by itself tells of the candidate with marks text[a:b] that would end at e, or None."""
    t = e
    while t < z and text[t].isspace():
        t += 1
    if t >= z:
        return "last"
    mark, c, n = text[a:b], text[e], text[t]
    if c in "，,、；;：:)）】」』”》" or quoted and _MARKS.match(c):
        return "closed"
    if n in "，,、；;：:":
        return "comma"
    before = text[a - 1 : a]
    if mark in (".", "．"):
        if before.isdigit() and c.isdigit():
            return "decimal"
        if before.isdigit() and not c.isspace() and _HEAD_NUMBER.search(text[max(floor, a - 6) : a]):
            return "numbering"
        if before.isalnum() and c.isalnum() and not _IS_CJK.match(before) and not _IS_CJK.match(c):
            # no space: only a small letter before a capital can be a boundary
            return None if before.islower() and c.isupper() and len(word_before(text, a, floor)) > 2 else "joined"
    if n.islower() and (quoted or mark[0] not in "。｡") and word_after(text, t).islower():  # pH begins a sentence as well as any
        return "small"
    if not quoted and any(x in "。！？｡" for x in mark):
        return "full width"
    return None


def split_text(text: str, model: np.ndarray, stats: dict[str, tuple[float, float]]) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without white space at their ends."""
    spans = protected(text)
    cuts: list[tuple[int, int]] = []
    unmarked = not re.search(r"[。！？!?｡]|\.(?!\d)", text)
    weights = model.tolist()
    for s, z in _line_units(text, spans):
        at = s
        for a, b, e, quoted in candidates(text, s, z, spans):
            if e <= at or e > z:
                continue
            told = telling(text, a, b, e, z, s, quoted)
            if quoted and (told is None or SIGNS[told] < 0) and text[e : e + 1].isspace():
                first = at
                while text[first].isspace():
                    first += 1
                if text[first] in "(（" and text.rfind(text[first], at, a) == first:
                    told = "own bracket"  # a bracketed passage that is a sentence of its own
            if (told is None or SIGNS[told] > 0) and text[a:b] in (".", "．") and _MARK_ONLY.fullmatch(text[at:a].strip()):
                told = "mark only"  # the mark of an entry or heading within the line
            score = weights[0] + weights[_AT[told]] if told else sum(x * w for x, w in zip(features(text, a, b, e, s, quoted, stats), weights) if x)
            if score > 0:
                cuts += _spaced(text, at, e, spans, unmarked, stats)
                at = e
        cuts += _spaced(text, at, z, spans, unmarked, stats)
    out = []
    for s, e in cuts:
        part = text[s:e]
        s += len(part) - len(part.lstrip())
        part = part.strip()
        if part:
            out.append((s, s + len(part)))
    return out


_UNSPACED = re.compile(f"[{_CJK}฀-๿]")
_BLANKS = re.compile(r"[^\S\n]+")


def _spaced(text: str, s: int, z: int, spans: list[tuple[int, int]], unmarked: bool, stats: dict) -> list[tuple[int, int]]:
    """text[s:z] divided at spaces between sentences: Thai, and CJK stretches without end marks."""
    out, at = [], s
    if not _UNSPACED.search(text, s, z):
        return [(s, z)]
    for m in _BLANKS.finditer(text, s, z):
        p, q = m.span()
        if p == at or q >= z:
            continue
        x, y = text[p - 1], text[q]
        if x.isascii() and y.isascii() or any(a < p < b for a, b in spans):
            continue
        if _THAI.match(x) and _THAI.match(y):
            pass
        elif (_IS_CJK.match(x) or x in "%％）)”」") and (_IS_CJK.match(y) or y in "“「《【"):
            begins = stats.get("b:" + word_after(text, q), (0.0, None))[0]
            if not (unmarked and p - at >= 6 or begins > 1 and p - at >= 10) or _ENTRY.fullmatch(text, at, p):
                continue
        elif (_THAI.match(x) and (y.isalpha() and y.isupper() or _IS_CJK.match(y))) or (_THAI.match(y) and x in ".。!！?？"):
            pass
        elif unmarked and _THAI.search(text[at:p]) and _THAI.match(y) and not x.isdigit():
            pass
        else:
            continue
        out.append((at, q))
        at = q
    return [*out, (at, z)]


_WORD = re.compile(r"[A-Za-zÀ-ɏ][\w'’-]*(?:\.[A-Za-zÀ-ɏ]+)*(\.?)")
_LINE = re.compile(r"[^\n]+")
_BEGINS = re.compile(r"([。！？!?]\s*)|([，,、：:；;”」』)）]\s*)|(?<=[^\W\d_]{4}\.)\s+(?=\w)|((?<![^\W\d_]{4})\.\s+)|(?<=[A-Za-z])\s+(?=[A-Z])")


def _count(text: str, words: Counter) -> None:
    """w:word with a period or without; c:word with a period, going on or not; b:token beginning a sentence or not."""
    for m in _WORD.finditer(text):
        word = m[0].rstrip(".").casefold()
        words[("w:" + word, 1 if m[1] else 0)] += 1
        if m[1]:
            rest = text[m.end() : m.end() + 3].lstrip()
            words[("c:" + word, 1 if rest[:1].islower() or rest[:1].isdigit() or rest[:1] in (",", ";", ")") and rest else 0)] += 1
    for s, e in (m.span() for m in _LINE.finditer(text)):
        t = _SPACES.match(text, s).end()
        if t < e:
            words[("b:" + word_after(text, t), 1)] += 1
        for m in _BEGINS.finditer(text, s, e):
            if m.end() < e:
                begins = bool(m[1]) or not (m[2] or m[3]) and text[m.start() - 1] == "."
                words[("b:" + word_after(text, m.end()), int(begins))] += 1


def word_statistics(docs: DataFrame, text: str = "text") -> dict[str, tuple[float, float]]:
    """Log odds of each frequent token: standing without a period (w:), its period followed by a capital (c:), beginning a sentence (b:)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words: Counter = Counter()
            for t in f["t"]:
                _count(t, words)
            yield pd.DataFrame([(w, k, n) for (w, k), n in words.items()], columns=["word", "kind", "n"])

    counted = widen(docs.select(F.col(text).cast("string").alias("t")).where("t is not null")).mapInPandas(run, "word string, kind int, n long")
    got = cut(counted.groupBy("word", "kind").agg(F.sum("n").alias("n")))  # read twice below, counted once
    per = got.groupBy("word").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("n"))
    per = per.where("n >= 5")
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    out = {}
    for r in per.where(F.col("n") >= max(5, total * WORD_SHARE)).collect():
        odds = float(np.clip(np.log((r.yes + 0.5) / (r.n - r.yes + 0.5)), -4, 4))
        out[r.word] = (odds if r.word.startswith("b:") else -odds, float(r.n))
    return out


def told_by(name: str) -> list[float]:
    x = [0.0] * FEATURES
    x[0] = x[_AT[name]] = 1.0
    return x


def _labelled(text: str, stats: dict) -> list[tuple[int, list[float]]]:
    """Reliable candidates: (1 or 0, features)."""
    spans = protected(text)
    out = []
    for s, z in _line_units(text, spans):
        for a, b, e, quoted in candidates(text, s, z, spans):
            told = telling(text, a, b, e, z, s, quoted)
            if told:
                out.append((int(SIGNS[told] > 0), told_by(told)))
            x = features(text, a, b, e, s, quoted, stats)
            sure = SIGNS[told] > 0 if told else None
            if sure is None and text[a:b] == "." and not quoted and not x[13]:
                if x[2] > 1.5 and (x[4] or x[5]) and not x[7] and not x[8]:
                    sure = True  # an ordinary word before a capital or a number
                elif x[1] < -1 and x[2] < 0:
                    sure = False
            elif sure is None and quoted:
                if x[1] > 1.5:
                    sure = True
                elif x[1] < -1.5:
                    sure = False
            if sure is not None:
                out.append((int(sure), x))
    return out


def fit(rows: list[tuple[int, list[float], float]], rounds: int = 3000, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the maximum-entropy model, by gradient descent on the mean log-likelihood of (class, features, count)."""
    w = np.zeros(FEATURES)
    w[1], w[2] = 1.0, 0.5  # without any rows: by what follows, what precedes, and the neighbours that tell by themselves
    for name, sign in SIGNS.items():
        w[_AT[name]] = PRIOR * sign
    if not rows:
        return w
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    weight = np.where(y > 0, 0.5 * n / max(1, (y * n).sum()), 0.5 * n / max(1, ((1 - y) * n).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ ((p - y) * weight) + ridge * w)
    return w


def train(docs: DataFrame, stats: dict, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), F.xxhash64(key).alias("h")).orderBy("h", "t").limit(sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(y, x) for t in f["t"] for y, x in _labelled(t, stats)]
            got = pd.DataFrame(rows, columns=["y", "x"])
            if len(got):  # equal rows weigh by their number
                got["x"] = got["x"].map(tuple)
                g = got.groupby(["y", "x"]).size().reset_index(name="n")
                g["x"] = g["x"].map(list)
                yield g.astype({"y": "int32", "n": "int64"})

    got = spread(chosen).mapInPandas(run, "y int, x array<double>, n long").groupBy("y", "x").agg(F.sum("n").alias("n")).orderBy("y", "x").collect()
    return fit([(r.y, r.x, r.n**0.5) for r in got])


def sentence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char): the sentences of each text, as code-point offsets, end exclusive.

    Together they cover all of a text but white space. Null, empty and blank texts have none;
    repeated texts are split alike; an empty table gives an empty result.
    """
    stats = word_statistics(docs, text)
    model = train(docs, stats, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, s, e) for k, t in zip(f["k"], f["t"]) for s, e in split_text(t, model, stats)], columns=["k", "start_char", "end_char"])

    src = widen(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null"))
    return src.mapInPandas(run, f"k {kind}, start_char long, end_char long").withColumnRenamed("k", key)
