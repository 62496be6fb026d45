"""Text cleaners as Column expressions: they stay in the JVM and inside whole-stage codegen.

Every function takes a Column of strings and gives null for null unless it says otherwise. Patterns
use Unicode classes; `blank_trim` strips all Unicode white space, which SQL's trim does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, and the classes below, in natural order.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EDGE_PUNCT = r"[()\[\]【】（）,，。.．!！?？;；:：…\-—/\\\"'“”‘’<>《》、#*&^$%@』『·]"
LABEL_PUNCT = r"[，,;；:：.。!！?？、/／\\|\-—()（）\[\]【】{}<>\"'“”‘’·•…]+"
LIST_SEPARATORS = r"[，,;；/／\\|｜、]+"
DUTY_SEPARATORS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},，;；()（）、/|]+"
BULLETS = "•♦▪▫◆◇●○►▶◄◢◣◤◥★☆✦✧✸✹✶✷✺✻✽✾✿❖❂❃❁❀✪✫✬✭✮✯✰"
ENCLOSED = r"[\x{2460}-\x{24FF}\x{2776}-\x{2793}\x{3250}-\x{32FF}]+"
NUMBERINGS = [r"\d+\.", r"\d+．", r"\d+、", r"\[\d+\]", r"（\d+）", r"\(\d+\)", r"\d+）", r"\d+\)", r"\d+,"]
TITLE_LITERALS = ["【品牌整机厂创新需求】", "需求：", "需求:", "寻找：", "寻找:", "寻找", "寻求：", "寻求:", "寻求", "寻：", "寻:", "寻"]
BUSINESS_LITERALS = ["〓", "许可经营项目是：无", "许可经营项目是：", "一般经营项目是：", "许可经营项目是", "一般经营项目是", "许可经营项目：", "一般经营项目：", "许可经营项目", "一般经营项目", "许可项目：", "一般项目：", "许可项目", "一般项目"]
OPENING, CLOSING = "([{<〈【", ")]}>〉】"
WORD_CLASS = r"[^0-9A-Za-z\x{4e00}-\x{9fff}\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}+-]+"


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def blank_trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return sub(c, f"^{SPACE}+|{SPACE}+$")


def collapse(c: Column) -> Column:
    """Each run of white space as one blank."""
    return sub(c, f"{SPACE}+", " ")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space values."""
    return F.coalesce(blank_trim(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def non_blank(c: Column) -> Column:
    """Null where blank, else the trimmed value."""
    return F.nullif(blank_trim(c), F.lit(""))


def concat_non_blank(cols: list[Column], sep: str = "；") -> Column:
    """Trimmed, non-blank values joined; '' if there are none."""
    return F.concat_ws(sep, *[non_blank(c) for c in cols])


def normalize_words(c: Column) -> Column:
    """Text for matching: separators to blanks, only letters, digits, Han, + and - kept, blanks collapsed.

    Compatibility forms are left as they are; `stateful.nfkc` brings them to one form before.
    """
    s = collapse(blank_trim(c))
    s = sub(s, r"[，,；;/\\|]+", " ")
    s = sub(s, WORD_CLASS, " ")
    return blank_trim(collapse(s))


# Opening and closing tags, and residue of word processors, in the order in which they go.
OPEN_TAG, CLOSE_TAG = rf"<{SPACE}*[a-zA-Z0-9:_-]+(?:{SPACE}+[^<>]*?)?>", rf"<{SPACE}*/{SPACE}*[a-zA-Z0-9:_-]+{SPACE}*>"
STRAY = "<>▶"
SUPPORT_LISTS = rf"(?i)!?{SPACE}*!?{SPACE}*\[if{SPACE}*!?{SPACE}*supportLists\]{SPACE}*!?{SPACE}*!?"
RESIDUE = ["!--[endif]--", "![endif]", "!----&uuml;", "&uuml;", "!----"]
SPACE_ENTITIES = r"(?i)&nbsp;?|&#160;?"


def strip_tags(c: Column) -> Column:
    """HTML tags out, their text kept; stray angle brackets and residue of word processors too."""
    s = F.translate(reduce(sub, [OPEN_TAG, CLOSE_TAG], c), STRAY, "")
    return blank_trim(drop_literals(sub(s, SUPPORT_LISTS), RESIDUE))


def strip_space_entities(c: Column) -> Column:
    return sub(c, SPACE_ENTITIES)


def plain_html(c: Column) -> Column:
    return strip_tags(strip_space_entities(c))


def unescape_basic(c: Column) -> Column:
    """The five XML entities decoded, trimmed, blank as null."""
    s = c
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return non_blank(s)


def strip_edge_punct(c: Column) -> Column:
    return sub(sub(c, f"^{EDGE_PUNCT}+"), f"{EDGE_PUNCT}+$")


def cut_bracket(c: Column) -> Column:
    """Up to the first round bracket, trimmed."""
    return blank_trim(sub(c, r"(?s)[（(].*$"))


def first_word(c: Column) -> Column:
    """Up to the first white space; a blank value stays."""
    return sub(c, f"(?s)^{SPACE}*([^{SPACE[1:-1]}]+).*$", "$1")


def map_codes(c: Column, codes: dict[str, str]) -> Column:
    """The value of a code, else the trimmed input."""
    t = blank_trim(c)
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[t], t) if pairs else t


def normalize_category(c: Column) -> Column:
    return sub(collapse(blank_trim(c)), r"[，,。.；;：:\s]+$")


def normalize_duty(c: Column) -> Column:
    """Separators, round brackets and white space as one full-width semicolon."""
    return sub(sub(c, DUTY_SEPARATORS, "；"), "^；+|；+$")


def normalize_application_list(c: Column) -> Column:
    """Commas outside double quotes to semicolons; outer square brackets and quotes out."""
    s = F.replace(blank_trim(c), F.lit("，"), F.lit(","))
    s = sub(s, r"(?s)^\[(.*)\]$", "$1")
    parts = F.transform(F.split(s, '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(";"))).otherwise(x))
    s = F.array_join(parts, "")
    return sub(sub(sub(s, f"{SPACE}*;{SPACE}*", ";"), ";+", ";"), "^[ ;]+|[ ;]+$")


def normalize_field_list(c: Column) -> Column:
    """Numbering, bullets, enclosed numerals and white space out; separators as one comma."""
    s = blank_trim(c)
    s = reduce(lambda acc, p: sub(acc, p), NUMBERINGS, s)
    s = F.translate(s, BULLETS, "")
    s = F.translate(s, "，；", ",;")
    s = sub(sub(s, ENCLOSED), f"{SPACE}+")
    return sub(sub(s, r"[,.;]+", ","), "^,+|,+$")


def normalize_label(c: Column) -> Column:
    """Punctuation runs as one full-width comma, none at the ends; null gives ''."""
    return sub(sub(blank_trim(filled(c)), LABEL_PUNCT, "，"), "^，+|，+$")


def collapse_separators(c: Column) -> Column:
    return sub(c, LIST_SEPARATORS, "；")


def drop_literals(c: Column, literals: list[str]) -> Column:
    """The literals removed, in the order given."""
    return reduce(lambda acc, x: F.replace(acc, F.lit(x), F.lit("")), literals, c)


def need_title(c: Column) -> Column:
    return drop_literals(c, TITLE_LITERALS)


def ascii_spacing(c: Column) -> Column:
    """White space kept (as one blank) only between two words of ASCII letters and digits."""
    words = F.filter(F.split(collapse(c), " ", -1), lambda x: x != "")
    plain = lambda w: w.rlike("^[A-Za-z0-9]+$")
    gap = lambda w, i: F.when((i > 0) & plain(w) & plain(F.get(words, i - 1)), F.concat(F.lit(" "), w)).otherwise(w)
    return F.array_join(F.transform(words, gap), "")


def standard_title(c: Column) -> Column:
    """The label 成果 with its colon out, a lone double quote out, ASCII spacing; null gives ''."""
    s = collapse(sub(blank_trim(filled(c)), f"成果{SPACE}*[:：]{SPACE}*"))
    lone = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit(""))) == 1
    return ascii_spacing(F.when(lone, F.replace(s, F.lit('"'), F.lit(""))).otherwise(s))


def drop_bracketed(c: Column) -> Column:
    """Text in round full-width brackets out, nested to any depth; a bracket without its partner goes, its text stays.

    One pass over the pieces between brackets with a stack of open texts.
    """
    pieces = F.regexp_extract_all(c, F.lit("[（）]|[^（）]+"), 0)
    top = lambda a: F.slice(a, 1, F.size(a) - 1)
    step = lambda a, x: (
        F.when(x == "（", F.array_append(a, "")).when((x == "）") & (F.size(a) > 1), top(a)).when(x == "）", a).otherwise(F.array_append(top(a), F.concat(F.element_at(a, -1), x)))
    )
    return F.when(c.contains("（"), F.array_join(F.aggregate(pieces, F.array(F.lit("")), step), "")).otherwise(F.translate(c, "）", ""))


# What a cleaned business text neither begins nor ends with.
BUSINESS_HEAD = r"[()（）\[\]【】,，。.．!！?？;；:：…\-—/\\]+"
BUSINESS_TAIL = r"[，,。.．!！?？;；:：…]+"


def clean_business(c: Column) -> Column:
    """Boilerplate, junk, bracketed text (nested to any depth) and doubled marks out; one full stop at the end."""
    s = drop_literals(filled(c), BUSINESS_LITERALS)
    s = sub(F.translate(s, "#*&^$�", ""), r"[\r\n\t\x0b\x0c]")
    s = drop_bracketed(F.translate(s, OPENING + CLOSING, "（" * len(OPENING) + "）" * len(CLOSING)))
    s = sub(s, r"[，。,.!?；;:：]{2,}", "。")
    s = sub(sub(blank_trim(collapse(s)), f"^{BUSINESS_HEAD}"), f"{BUSINESS_TAIL}$")
    return F.when(s == "", s).otherwise(F.concat(s, F.lit("。")))


def append_if_missing(base: Column, addition: Column, sep: str = "") -> Column:
    """base, with addition behind it unless base holds it already."""
    b, a = filled(base), filled(addition)
    return F.when((a == "") | b.contains(a), b).when(b == "", a).otherwise(F.concat(b, F.lit(sep), a))


def upper_key(c: Column) -> Column:
    return F.upper(F.translate(blank_trim(c), "\r\n", ""))


def full_width_marks(c: Column) -> Column:
    return F.translate(c, ",;", "，；")


def replace_value(c: Column, old: str, new: str) -> Column:
    """new where the whole value is old."""
    return F.when(c == old, F.lit(new)).otherwise(c)


def safe_name(c: Column) -> Column:
    return sub(c, "[^0-9A-Za-z]+", "_")


def between_labels(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """The texts behind two labels of an answer; without labels all of it is the first, '' the second."""
    has_first, has_second = c.contains(first), c.contains(second)
    tail = F.when(has_first, F.substring_index(c, first, -1)).otherwise(c)
    one = F.substring_index(tail, second, 1)
    two = F.when(has_second, F.substring_index(c, second, -1)).otherwise("")
    return blank_trim(one), blank_trim(two)


def json_list(c: Column) -> Column:
    """The array between the first [ and the last ] of an answer, code fences out; null if it is no JSON list."""
    return F.from_json(F.regexp_extract(sub(c, "```(?:json)?"), r"(?s)\[.*\]", 0), "array<string>")


# List marks at the head of a line, those of an entry, and marks after which no semicolon is put.
LINE_MARK = rf"^{SPACE}*(?:[◆•●・◼]+|[（(]?{SPACE}*[0-9]+{SPACE}*[.、)）：:]){SPACE}*"
INDEX_MARK = rf"^{SPACE}*[（(]?{SPACE}*[0-9]+{SPACE}*[.、)）：:]{SPACE}*"
PAUSES = "[。！？；，、：:,.!?;]$"


def list_cell(c: Column) -> Column:
    """Entries of a cell parted by '；'. A cell with square brackets keeps the commas of its quoted entries; brackets and quotes go.

    The bracketed cell is read as tokens: a comma parts entries where an odd number of brackets is
    open and an even number of quotes lies before it. Null and blank cells stay as they are.
    """
    t = strip_tags(c)
    tokens = F.regexp_extract_all(t, F.lit(r"[\[\]]|[\"“”]|,|[^\[\]\"“”,]+"), 0)
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("quoted"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        level = F.when(x == "[", a["open"] + 1).when(x == "]", F.greatest(F.lit(0), a["open"] - 1)).otherwise(a["open"])
        mark = x.isin('"', "“", "”")
        said = F.when(mark | x.isin("[", "]"), "").when((x == ",") & (a["open"] > 0) & ~a["quoted"], "；").otherwise(x)
        return F.struct(level.alias("open"), (a["quoted"] != mark).alias("quoted"), F.concat(a["out"], said).alias("out"))

    listed = blank_trim(F.aggregate(tokens, start, step)["out"])
    return F.when(is_blank(c), c).when(c.contains("[") & c.contains("]"), listed).otherwise(collapse_separators(t))


def renumbered(c: Column) -> Column:
    """Lines of a description joined to one: marked lines numbered anew, '；' where a line ends without a mark; null gives ''.

    A text of one line without white space gets no full stop: only a joined or spaced one does.
    """
    lines = F.filter(F.transform(F.split(plain_html(filled(c)), r"\r\n|\r|\n", -1), blank_trim), lambda x: x != "")
    start = F.struct(F.lit(0).alias("number"), F.lit("").alias("before"), F.lit("").alias("text"))

    def step(a: Column, x: Column) -> Column:
        body = F.translate(sub(x, LINE_MARK), "\u3000\xa0", "")
        marked = x.rlike(LINE_MARK)
        number = a["number"] + marked.cast("int")
        part = F.when(marked, F.concat(number.cast("string"), F.lit("."), body)).otherwise(body)
        gap = F.when((a["text"] == "") & (a["number"] == 0) & (a["before"] == "") | a["before"].rlike(PAUSES), "").otherwise("；")
        return F.struct(number.alias("number"), body.alias("before"), F.concat(a["text"], gap, part).alias("text"))

    text = collapse(F.aggregate(lines, start, step)["text"])
    spaced = ascii_spacing(text)
    stop = F.when((spaced == "") | spaced.rlike(rf"。{SPACE}*$"), "").otherwise("。")
    return F.when(~text.contains(" "), text).otherwise(F.concat(sub(spaced, f"{SPACE}+$"), stop))


def scenario_text(c: Column) -> Column:
    """Of a JSON list of {title, describe} (or one such object): descriptions, else titles, numbered and joined.

    Text that is no such JSON is searched for the two fields; what has neither comes out without
    tags. Null and blank cells stay as they are.
    """
    whole = F.when(blank_trim(c).startswith("{"), F.concat(F.lit('{"x":['), c, F.lit("]}"))).otherwise(F.concat(F.lit('{"x":'), c, F.lit("}")))  # text behind the JSON is an error then
    parsed = F.from_json(whole, "x array<struct<title string, describe string>>", {"allowSingleQuotes": "false"})["x"]
    field = r'(?s)"title"\s*:\s*"(.*?)".*?"describe"\s*:\s*"(.*?)"'
    found = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(field), i).alias(n) for i, n in ((1, "title"), (2, "describe"))])
    one = lambda x: F.coalesce(F.nullif(blank_trim(F.translate(x["describe"], "\r\n\t\u3000\xa0", "")), F.lit("")), blank_trim(F.translate(filled(x["title"]), "\r\n\t\u3000\xa0", "")))
    texts = F.filter(F.transform(F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), found), one), lambda x: x != "")
    numbered = F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), blank_trim(sub(x, INDEX_MARK))))
    plain = blank_trim(F.translate(strip_tags(c), "\r\n\t\u3000\xa0", ""))
    return F.when(is_blank(c), c).when(F.size(texts) > 0, strip_tags(F.array_join(numbered, ""))).otherwise(plain)


# What a demand's description is made of, in the order tried: an encircled number, a number in brackets, a number with its mark, white space, the rest.
NEED_TOKENS = r"(?U)[\x{2460}-\x{24FF}]|（\d+）|\d+(?:\.(?![\da-zA-Z\x{2460}-\x{24FF}])|[，,）)])?|\s+|（|[^\d\s（\x{2460}-\x{24FF}]+"
NEED_HEADS = [r"(?s)（[一二三四五六七八九十]+）.", r"(?U)(?s)\d+\.."]
NEED_ENTRY = r"(?U)(?<![；;，,。！？、])(?=(?:[2-9]\d*|1\d+)、)"
NEED_LEAD, NEED_STOPS = r"^[，,；;。！？、:：\-—](?=[^，,；;。！？、:：\-—])", r"[，,；;。.！？、]+$"


def need_content(c: Column) -> Column:
    """A demand's description: tags to colons behind headings, list marks of all kinds to 'n、', '；' between entries, one full stop at the end; null gives ''.

    Read as tokens, each of which says by itself what becomes of it.
    """
    s = filled(c)
    pieces = F.split(s, "<", -1)
    colons = lambda x: reduce(lambda acc, h: F.when(acc.rlike(h), F.concat(acc, F.lit("："))).otherwise(acc), NEED_HEADS, x)
    headed = F.array_join(F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, colons(x)).otherwise(x)), "<")
    s = F.when(s.rlike("<[^>]+>"), sub(sub(headed, "<[^>]+>"), f"{SPACE}+")).otherwise(s)
    tokens = F.regexp_extract_all(F.replace(s, F.lit("寻："), F.lit("")), F.lit(NEED_TOKENS), 0)

    def said(x: Column) -> Column:
        n, first = F.length(x), F.substring(x, 1, 1)
        return (
            F.when(x.rlike(r"^[\x{2460}-\x{24FF}]$"), F.concat((F.ascii(x) - 0x245F).cast("string"), F.lit("、"))).when(x.rlike(f"^{SPACE}"), "")
            .when((first == "（") & (n > 1), F.concat(F.substring(x, F.lit(2), n - 2), F.lit("、")))
            .when(first.rlike(r"(?U)\d") & ~x.rlike(r"(?U)\d$"), F.concat(F.substring(x, F.lit(1), n - 1), F.lit("、"))).otherwise(x)
        )

    s = sub(F.array_join(F.transform(tokens, said), ""), NEED_ENTRY, "；")
    s = sub(s, NEED_LEAD)
    return F.when(s == "", s).otherwise(F.concat(sub(s, NEED_STOPS), F.lit("。")))
