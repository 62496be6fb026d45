"""Problem 7: one form for texts that look the same.

The mapping runs as embedded SQL: each Arrow batch of a partition is a relation of a DuckDB
connection, where nfc_normalize, translate and regular expressions bring the text to its form.
No row leaves its partition for that; only finding equal texts shuffles, by digest of the form.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import cut, widen

# Letters of Greek and Cyrillic that have the shape of a Latin letter; those of further scripts come from the published table of confusable characters, see confusables().
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F", "Ӏ": "I", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "ԛ": "q", "ԝ": "w", "ԁ": "d", "һ": "h", "ү": "y", "ӏ": "l", "ё": "ë", "Ё": "Ë", "ѵ": "v", "ց": "g", "ո": "n", "ս": "u", "օ": "o",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "κ": "k", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
}
# Hyphens, CJK radicals without a decomposition, and dots and bars of one look.
HYPHENS = "‐‑‒–−﹘﹣－⁃˗"
RADICALS = {"⺟": "母", "⺠": "民", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟", "⺎": "兀", "⻑": "長", "⺌": "小", "⺮": "竹", "⺶": "羊", "⺷": "羊", "⻌": "辶", "⺼": "月"}
OTHER = {"‛": "'", "ʼ": "’", "․": ".", "∶": ":", "︰": ":", "꞉": ":", "⁄": "/", "∕": "/", "ǀ": "|", "∣": "|", "‚": ",", "⸴": ",", "･": "・", "·": "·", "•": "•", "〇": "〇"}
#: The table and field of each kind of text the queries bring to one form.
FIELDS = {"enterprises_full": "business", "experts_full": "research_field", "achievements_full": "title", "papers": "title"}
#: Decompositions that only change the look's encoding; raised, lowered, encircled, squared and fractional forms look different.
_SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}


def _one(c: str) -> str | None:
    """What character c becomes, or None if it stays (canonical decomposition is left to NFC)."""
    if c in LOOK_ALIKES or c in RADICALS or c in OTHER:
        return {**LOOK_ALIKES, **RADICALS, **OTHER}[c]
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Zs" and c != " ":
        return " "
    if kind == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    parts = unicodedata.decomposition(c).split()
    if not parts or parts[0] not in _SAME_LOOK:
        return None
    to = "".join(chr(int(x, 16)) for x in parts[1:])
    if any(unicodedata.category(x) == "Zs" for x in to) or to == c:  # spacing accents and the like
        return None
    return "".join(y if (y := _one(x)) is not None else x for x in to)


_tables_of: dict[str, tuple[tuple[str, str], ...]] = {}


def confusables(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(letter, Latin letter) of one shape, by the published table of confusable characters that comes with Spark's ICU library.

    Only letters without a decomposition that the table brings to one ASCII letter. The table has one prototype, l, for the shapes of I and l: a
    capital letter is an I. ASCII letters themselves stay: I and l, or O and 0, may be told apart by their look. Asked once an application.
    """
    app = spark.sparkContext.applicationId
    if app not in _tables_of:
        # letters of scripts with cases, and of others with letters of Latin shape; no Han, kana or Hangul
        asked = [
            c for n in (*range(0x80, 0x3000), *range(0xA000, 0xABC0), *range(0x10280, 0x10600), *range(0x118A0, 0x11900))
            if unicodedata.category(c := chr(n))[0] == "L" and not unicodedata.decomposition(c)
        ]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        forms = checker.getSkeleton("\x01".join(asked)).split("\x01")
        found = [(c, "I" if to == "l" and unicodedata.category(c) == "Lu" else to) for c, to in zip(asked, forms) if len(to) == 1 and to.isascii() and to.isalpha()] if len(forms) == len(asked) else []
        _tables_of[app] = tuple((c, to) for c, to in found if unicodedata.category(c) == "Lo" or c.isupper() == to.isupper())
    return _tables_of[app]


@lru_cache(2)
def tables(more: tuple[tuple[str, str], ...] = ()) -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """(from, to) of single characters for translate, characters to drop, and longer replacements; more: further look-alikes."""
    a, b, gone, longer = [], [], [], []
    extra = dict(more)
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        to = _one(c)
        if to is None:
            to = extra.get(c)
        if to is None:
            continue
        if to == "":
            gone.append(c)
        elif len(to) == 1:
            a.append(c)
            b.append(to)
        elif unicodedata.category(c)[0] == "L" or n in (0x2026, 0x2025, 0x203C, 0x2047, 0x2048, 0x2049, 0xFE19):
            longer.append((c, to))
    return "".join(a), "".join(b), "".join(gone), tuple(longer)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(2)
def look_sql(column: str = "t", more: tuple[tuple[str, str], ...] = ()) -> str:
    """The SQL expression of the form of a column. translate() drops what has no counterpart."""
    a, b, gone, longer = tables(more)
    # full-width ASCII, the bulk of it, by a short table; the long one only where others are left
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in HYPHENS) + "\u3000\u00a0"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) not in HYPHENS) + "  "
    first = f"translate({column}, {_quoted(wide)}, {_quoted(narrow)})"
    plain = "[ -~\u3001\u3002\u4e00-\u9fff\u00e0-\u00f6\u00f8-\u00fc\u00c0-\u00d6\u201c\u201d\u300c\u300d\u3010\u3011\u00b2\u00b3\u2460-\u2473]*"
    expr = f"translate({first}, {_quoted(a + gone)}, {_quoted(b)})"
    # joined letters, of every script, character by character where a text has any
    spelt = f"MAP {{{', '.join(f'{_quoted(x)}: {_quoted(y)}' for x, y in longer)}}}"
    joined = f"array_to_string(list_transform(string_split({expr}, ''), lambda c: coalesce({spelt}[c], c)), '')"
    expr = f"case when regexp_matches({expr}, '[{''.join(x for x, _ in longer)}]') then {joined} else {expr} end"
    # one more turn after NFC, for what a composition or a canonical singleton brings up
    expr = f"nfc_normalize(regexp_replace(nfc_normalize({expr}), '[\\r\\n\\t\\v\\f]', ' ', 'g'))"
    full = f"translate({expr}, {_quoted(a + gone)}, {_quoted(b)})"
    return f"case when regexp_full_match({first}, '{plain}') then {first} else {full} end"


def _run(batches: Iterator[pa.RecordBatch], more: int, letters: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    names = [f"c{i}" for i in range(more)]
    sql = f"select {', '.join([*names, 't', f"{look_sql('t', letters)} as form"])} from batch_rows"
    for batch in batches:
        if batch.num_rows:
            con.register("batch_rows", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("batch_rows")


def same_look(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """df with the column `form`: the one form of all texts that look like `text`.

    Width, encoding of accents, kind of space or hyphen, invisible characters, ligatures and
    look-alike letters or radicals vanish; case, wording, the number of spaces, missing accents
    and raised, lowered or encircled digits stay. Null gives null, an empty text an empty one;
    an existing column named `form` is replaced; other columns pass unchanged.
    """
    keep = [c for c in df.columns if c not in (text, form)]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields] + ["form string"])
    n = len(keep)
    letters = confusables(df.sparkSession)
    out = widen(src).mapInArrow(lambda it: _run(it, n, letters), fields)
    by = {c: f"c{i}" for i, c in enumerate(keep)} | {text: "t", form: "form"}
    order = [c for c in df.columns if c != form] + [form]
    return out.select(*[F.col(by[c]).alias(c) for c in order])


def look_alike_pairs(rows: DataFrame, group: list[str], key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(*group, key_a, key_b): rows of one group whose texts differ in characters but not in look.

    Texts under `least` characters are left out. Distinct spellings are gathered first and paired
    within their form; rows come in by their spelling only then. So a form typed alike by a third
    of all rows costs no comparison of equal texts: work and shuffle follow the pairs put out,
    and adaptive execution splits the rows of a hot spelling. Repeated rows are paired each.
    """
    formed = same_look(rows.select(*group, F.col(key).alias("k"), F.col(text).alias("text")).where(F.length("text") >= least), "text")
    marked = cut(formed.select(*group, "k", F.md5("form").alias("f"), F.md5("text").alias("s")))
    spellings = marked.select(*group, "f", "s").distinct()
    other = spellings.withColumnRenamed("s", "s2")
    pairs = spellings.join(other, [*group, "f"]).where("s < s2").select(*group, "s", "s2")
    first = pairs.join(marked.select(*group, "s", F.col("k").alias("k1")), [*group, "s"])
    both = first.join(marked.select(*group, F.col("s").alias("s2"), F.col("k").alias("k2")), [*group, "s2"])
    return both.select(*group, F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"))
