"""Problem 2: several values packed in one field.

A cell can be read in several dialects: one value, a set of delimiters, single blanks among them
(with or without quotes and an outer bracket), or a numbered list. The dialect with the minimum description length is
taken: the sum of the code lengths of its values, and a little for each value and the dialect.
A value's code length is -log2 of its share of all values of the corpus, or, if it is
rare, what its characters cost; a delimiter inside a value is a dear character.

Distinct cells are parsed once, and once more by the dialect chosen; in between only digests of values move. Counts of
values and code lengths are sums over shuffled keys. The delimiters of a cell are tried alone, in pairs, in threes, all together
and all but one: every set of up to five kinds, and of more kinds a number that grows with their cube, not as a power of two.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut, spread

#: Delimiter classes. A class matches also in its other widths.
DELIMITERS = {
    "semicolon": r"[;；﹔]",
    "comma": r"[,，﹐､]",
    "enumeration_comma": r"[、､]",
    "slash": r"[/／]",
    "backslash": r"[\\＼]",
    "bar": r"[|｜]",
    "tab": r"\t",
    "line": r"[\r\n]+",
    "break": r"[<＜][bｂBＢ][rｒRＲ]\s*[/／]?[>＞]",
    "spaces": r"[^\S\r\n\t]{2,}",
}
#: One blank parts values only where known values speak for it: it is no dear character inside a value, and a reading by it is no evidence for its values.
BLANKS = {"blank": " ", "wide_blank": "\u3000", "other_blank": "[\u00a0\u1680\u2000-\u200a\u202f\u205f]"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "＂": "＂", "＇": "＇", "«": "»", "《": "》"}
BRACKETS = {"[": "]", "【": "】", "{": "}", "［": "］", "｛": "｝", "(": ")", "（": "）", "〔": "〕"}
_ANY = re.compile("|".join(DELIMITERS.values()))
_MARKS = (
    lambda k: rf"[(（]\s*{k}\s*[)）]",
    lambda k: rf"{k}\s*[)）]",
    lambda k: rf"{k}\s*[.．](?!\d+(?![A-Za-z一-鿿\d,，-]))",
    lambda k: rf"{k}\s*、",
    lambda k: re.escape(chr(0x245F + int(k))) if int(k) <= 20 else r"(?!)",
)
_EDGE = re.compile(r"^[\s;；,，、､|｜/／。]+|[\s;；,，、､|｜/／。]+$")
#: What a reading takes for a mark of the list, not of the value: dear inside a value.
_INSIDE = re.compile("|".join([*DELIMITERS.values(), r"[①-⑳]", r"[(（]\s*\d+\s*[)）]", r"(?:^|\s)\d+\s*[.．)）](?!\d+(?![A-Za-z一-鿿\d]))", "。", "[" + re.escape("".join({*QUOTES, *QUOTES.values()})) + r"\[\]【】{}［］｛｝]"]))
CHAR_BITS, MARK_BITS, VALUE_BITS, KNOWN_MARK_BITS = 7.0, 14.0, 1.5, 6.0
#: A value seen in fewer cells is coded by its characters; one with a mark inside needs more cells.
MIN_COUNT, MIN_MARKED = 2, 4


_ONE = re.compile("[1１①]")


def _digits(k: int) -> str:
    return "".join(f"[{d}{chr(0xFF10 + int(d))}]" for d in str(k))


def _numbered(s: str) -> list[str] | None:
    """The entries of a list numbered 1, 2, 3 ... in one style, or None."""
    if not _ONE.search(s):
        return None
    for style, mark in enumerate(_MARKS):
        at, cuts, k = 0, [], 1
        free = style == 4  # encircled numbers need no boundary before them
        while True:
            num = str(k) if free else _digits(k)
            m = re.compile(("" if free else r"(?:(?<=^)|(?<=[\s;；,，、､。|｜/／>]))") + mark(num)).search(s, at)
            if not m:
                break
            cuts.append(m.span())
            at, k = m.end(), k + 1
        if len(cuts) >= 2 and not s[: cuts[0][0]].strip():
            ends = [c[0] for c in cuts[1:]] + [len(s)]
            return [_bare(_EDGE.sub("", re.sub(DELIMITERS["break"] + r"\s*$", "", s[a:z].rstrip()))) for (_, a), z in zip(cuts, ends)]
    return None


def _bare(item: str) -> str:
    item = item.strip()
    if len(item) >= 2 and QUOTES.get(item[0]) == item[-1] and item.count(item[0]) <= 2:
        item = item[1:-1].strip()
    return item


_NOT_BLANK = re.compile(r"\S")


def _split(s: str, delimiter: re.Pattern, quoted: bool) -> list[str]:
    """Parts between delimiters; a quote opened at a part's start hides delimiters up to its close."""
    out, start, at = [], 0, 0
    while True:
        m = delimiter.search(s, at)
        if quoted and at == start and (first := _NOT_BLANK.search(s, start)) and first[0] in QUOTES and (not m or first.start() <= m.start()):
            close = s.find(QUOTES[first[0]], first.end())
            after = s[close + 1 :].lstrip(" \u3000\u00a0") if close > 0 else ""
            if close > 0 and (not after or _ANY.match(after) or delimiter.match(s, close + 1)):
                at = close + 1
                continue
            m = delimiter.search(s, max(at, first.start()))
        if not m:
            break
        if m.end() == m.start():
            at = m.end() + 1
            continue
        out.append(s[start : m.start()])
        start = at = m.end()
    out.append(s[start:])
    return [x for p in out if (x := _bare(p))]


@lru_cache(4096)
def _delimiter(names: tuple[str, ...]) -> re.Pattern:
    classes = DELIMITERS | BLANKS
    return re.compile("|".join(classes[n] for n in names))


_CLASSES = {n: re.compile(p) for n, p in (DELIMITERS | BLANKS).items()}


def _inner(s: str) -> str:
    """A cell without an outer bracket."""
    return s[1:-1].strip() if len(s) > 2 and BRACKETS.get(s[0]) == s[-1] and s.count(s[0]) == 1 else s


def readings(cell: str) -> list[tuple[str, float, list[str]]]:
    """(dialect, bits of the dialect, values) of each way to read a cell; the first is one value, simpler ways come first."""
    s = cell.strip()
    inner = _inner(s)
    out = []
    numbered = _numbered(inner)
    if numbered:
        out.append(("numbered", 2.0, [x for x in numbered if x]))
    present = [n for n, p in _CLASSES.items() if p.search(inner)]
    seen = {(s,)} | {tuple(x[2]) for x in out}
    quoted = any(q in inner for q in QUOTES)
    k = len(present)
    ways = [names for size in sorted({1, 2, 3, k - 1, k} & set(range(1, k + 1))) for names in combinations(present, size)]
    for names in sorted(ways, key=lambda w: not BLANKS.keys().isdisjoint(w)):
        for with_quotes in (True, False) if quoted else (False,):
            values = _split(inner, _delimiter(names), with_quotes)
            if len(values) > 1 and tuple(values) not in seen:
                seen.add(tuple(values))
                out.append(("+".join(names) + ("+quotes" if with_quotes else ""), 2.0 * len(names), values))
    return [("whole", 0.0, [s]), *sorted(out, key=lambda x: (x[1], x[0]))]


def parse_as(cell: str, dialect: str) -> list[str]:
    """The values of a cell read in one dialect, as `readings` gives them."""
    inner = _inner(cell.strip())
    if dialect == "numbered":
        return [x for x in _numbered(inner) or [] if x]
    names = dialect.removesuffix("+quotes").split("+")
    return _split(inner, _delimiter(tuple(names)), dialect.endswith("+quotes"))


class _Counted(dict):
    """What becomes of a character in a value's form for counting, worked out when it is first met."""

    def __missing__(self, n: int) -> int | None:
        to = self[n] = None if unicodedata.category(chr(n)) in ("Cf", "Mn") else ord("-") if chr(n) == "‐" else n
        return to


_COUNTED = _Counted()


def _key(value: str) -> str:
    """A value for counting: compatibility forms as one, invisible characters out."""
    s = unicodedata.normalize("NFKC", value)
    return s if s.isascii() else s.translate(_COUNTED)


def _raw_bits(value: str) -> float:
    return CHAR_BITS * (len(value) + 1) + MARK_BITS * len(_INSIDE.findall(value))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(200_000)
def _facts(value: str) -> tuple[int, float, int, bool]:
    """(digest, bits if spelt out, marks inside, white space inside) of a value."""
    key = _key(value)
    return _digest(key), _raw_bits(value), len(_INSIDE.findall(value)), bool(re.search(r"\s", key))


def _evidence(ways: list[tuple[str, float, list[str]]]) -> dict[tuple[int, bool], int]:
    """{(digest, spaced): fewest marks} of the values a cell speaks for: alone, or, with a mark inside, as one of several."""
    out: dict[tuple[int, bool], int] = {}
    for dialect, _, values in ways:
        if "blank" in dialect:  # a reading by single blanks is no evidence for its values
            continue
        for v in values:
            key, _, marks, spaced = _facts(v)
            if not marks or len(values) > 1:
                out[key, spaced] = min(marks, out.get((key, spaced), marks))
    return out


def packed_values(cells: DataFrame) -> DataFrame:
    """Of (source, row, field, cell): one row a value of each cell that holds two or more.

    (source, row, field, pos, item): pos counts from 1 as typed; item is the value as typed,
    without the quotes, brackets, list marks and white space around it. Empty items don't count,
    a repeated value counts each time. Null, empty and blank cells hold no value. Equal readings
    of a cell cost the same wherever it stands, so ties and repeated rows come out alike; the
    simpler dialect wins a tie. An empty table gives an empty result.
    """
    keyed = cells.where(r"cell rlike '(?U)\\S'").withColumn("id", F.unhex(F.md5("cell")))
    distinct = keyed.groupBy("id").agg(F.first("cell").alias("cell"), F.count("*").alias("n"))
    schema = "id binary, cell string, look long, n long, proof array<struct<key: bigint, spaced: boolean, marks: int>>, ways array<struct<dialect: string, bits: double, vals: array<struct<key: bigint, raw: double, marks: int>>>>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, looks, proofs, ways_of, said = [], [], [], [], []
            proof_ends, way_ends, said_ends = [0], [0], [0]
            for cell in batch.column(1).to_pylist():
                ways = readings(cell)
                looks.append(_digest(_key(cell)))
                proofs += [(k, sp, m) for (k, sp), m in _evidence(ways).items()]
                proof_ends.append(len(proofs))
                kept.append(cell if len(ways) > 1 else None)
                for dialect, bits, values in ways if len(ways) > 1 else ():
                    ways_of.append((dialect, bits))
                    said += [_facts(v)[:3] for v in values]
                    said_ends.append(len(said))
                way_ends.append(len(ways_of))
            column = lambda rows, i, kind: pa.array([r[i] for r in rows], kind)
            ends = lambda x: pa.array(x, pa.int32())
            proof = pa.StructArray.from_arrays([column(proofs, 0, pa.int64()), column(proofs, 1, pa.bool_()), column(proofs, 2, pa.int32())], ["key", "spaced", "marks"])
            vals = pa.StructArray.from_arrays([column(said, 0, pa.int64()), column(said, 1, pa.float64()), column(said, 2, pa.int32())], ["key", "raw", "marks"])
            ways = pa.StructArray.from_arrays([column(ways_of, 0, pa.string()), column(ways_of, 1, pa.float64()), pa.ListArray.from_arrays(ends(said_ends), vals)], ["dialect", "bits", "vals"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(looks, pa.int64()), batch.column(2), pa.ListArray.from_arrays(ends(proof_ends), proof), pa.ListArray.from_arrays(ends(way_ends), ways)],
                ["id", "cell", "look", "n", "proof", "ways"],
            )

    read_all = cut(spread(distinct, "id").select("id", "cell", "n").mapInArrow(read, schema))
    # a repeated cell, even typed with other characters, is no further evidence that its marks, or the blank in it, belong to the value
    proof = read_all.select("look", "n", F.inline("proof")).groupBy("look", "key").agg(F.sum("n").alias("n"), F.min("marks").alias("marks"), F.bool_or("spaced").alias("spaced"))
    per = proof.groupBy("key").agg(F.min("marks").alias("m"), F.count("*").alias("looks"), F.sum("n").alias("n"), F.bool_or("spaced").alias("spaced"))
    per = cut(per.select("key", F.col("m").alias("known_marks"), F.when((F.col("m") > 0) | F.col("spaced"), F.col("looks")).otherwise(F.col("n")).alias("c"), "n"))
    counts = per.where(f"c >= if(known_marks > 0, {MIN_MARKED}, {MIN_COUNT})").select("key", "c")
    total = per.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).cast("double").alias("total"))
    several = read_all.where("size(ways) > 0").select("id", F.posexplode("ways").alias("way", "w")).select("id", "way", "w.dialect", "w.bits", F.inline("w.vals"))
    known = several.join(counts, "key", "left").join(F.broadcast(total))
    code = F.when(F.col("c").isNotNull(), F.least(F.col("raw"), 1 + KNOWN_MARK_BITS * F.col("marks") - F.log2(F.col("c") / F.col("total")))).otherwise(F.col("raw"))
    cost = known.groupBy("id", "way").agg((F.sum(code) + F.count("*") * VALUE_BITS + F.first("bits")).alias("cost"), F.first("dialect").alias("dialect"))
    best = cost.groupBy("id").agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "way", "dialect")).alias("b")).where("b.way > 0").select("id", F.col("b.dialect").alias("dialect"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "items": [parse_as(c, d) for c, d in zip(f["cell"], f["dialect"])]})

    parsed = cut(read_all.where("cell is not null").select("id", "cell").join(best, "id").mapInPandas(parse, "id binary, items array<string>"))
    return keyed.select("source", "row", "field", "id").join(parsed, "id").select("source", "row", "field", F.posexplode("items").alias("at", "item")).select("source", "row", "field", (F.col("at") + 1).cast("long").alias("pos"), "item")


def cells_of(df: DataFrame, source: str, row: str, fields: list[str]) -> DataFrame:
    """(source, row, field, cell) of the fields of a table, read in one pass over it."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields])
    return df.select(F.lit(source).alias("source"), F.col(row).alias("row"), F.explode(pairs).alias("x")).select("source", "row", F.col("x.field").alias("field"), F.col("x.cell").alias("cell"))
