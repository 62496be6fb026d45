"""Problem 3: mapping freely typed values to the entries of a reference list.

Distinct values are normalised to words. An inverted index of character n-grams over the list's
words gives, for each distinct word typed, the words it may stand for, with a similarity: 1 for the
same word, a little less for an abbreviation or a few slips. Values and entries are then vectors of
words weighted by rarity in the list, and a value scores its candidates by the cosine of these soft
vectors (a pair of words counts by its similarity). The best entry is taken if its cosine
passes the threshold and leads the next entry's by the margin; else the value is unmatched.

Candidates come by a prefix filter: an entry is indexed by its rarest words only, as many as are
needed that the rest alone could not reach the threshold. So a value meets few entries, and none
that could pass is lost.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomwright.session import cut, small, spread

# Words that carry no meaning in a venue's name.
STOP = frozenset("a an and der die das et for für in la le of on the to und".split())
# What people put around a venue's name.
AROUND = frozenset("proceedings proceeding proc vol volume no nr issue iss num number pp pages page part series ser ed edition eds online print press accepted appear published in".split())
# Usual abbreviations whose first letters do not tell the word, or tell two words.
SHORT_WORDS = {
    "int": "international", "intl": "international", "internat": "international", "conf": "conference", "symp": "symposium", "wksp": "workshop", "wkshp": "workshop", "ws": "workshop",
    "trans": "transactions", "j": "journal", "jnl": "journal", "jour": "journal", "mtg": "meeting", "ann": "annual", "eur": "european", "lett": "letters", "adv": "advances", "arch": "archives",
    "syst": "systems", "sys": "systems", "pract": "practice",
}
#: A word not in the list is what a word of the list was meant for if they agree but for so many edits: one in four letters begun.
EDIT_STEP = 4
#: What an edit, and an abbreviation, takes off the similarity of two words.
EDIT_LOSS, SHORT_LOSS = 0.01, 0.001
#: Least cosine of a match, and its least lead over the next entry.
THRESHOLD, MARGIN = 0.97, 0.0004
#: Weight of a word of one entry; a word of all entries weighs 1.
HEAVIEST = 1.25
#: Two letters: words a few slips apart, even swaps, share one.
GRAM = 2


def words_of(value: str | None) -> list[str]:
    """The words of a value: lower case, without marks, numbers and stop words; abbreviations spelt out."""
    if value is None:
        return []
    s = unicodedata.normalize("NFKC", html.unescape(value)).casefold()
    s = re.sub(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?", lambda m: m[0].replace(".", "") + " ", s)  # dotted initials
    s = re.sub(r"['’](?=\d\d\b)", " ", s)  # a short year
    out = []
    for w in re.findall(r"[^\W_]+", s.replace("'", "").replace("’", "")):
        if w in STOP or re.fullmatch(r"\d+(st|nd|rd|th)?", w):
            continue
        out.append(SHORT_WORDS.get(w, w))
    return out


def grams_of(words: list[str]) -> list[str]:
    out = set()
    for w in words:
        p = f"^{w}$"
        out.update(p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1)))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_column(values: pd.Series) -> pd.Series:
    return values.map(words_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def grams_column(words: pd.Series) -> pd.Series:
    return words.map(lambda w: grams_of(list(w)))


def edits(a: str, b: str, most: int) -> int:
    """Edits (also swaps of neighbours) from a to b, worked out in a band; most + 1 if above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def word_similarity(typed: str, meant: str) -> float:
    """1 for the same word, less for an abbreviation or slips of the finger, 0 for another word."""
    if typed == meant:
        return 1.0
    if 2 <= len(typed) < len(meant) and meant.startswith(typed):
        return 1 - SHORT_LOSS
    most = -(-len(meant) // EDIT_STEP)
    d = edits(typed, meant, most)
    if d <= most:
        return max(0.0, 1 - EDIT_LOSS * d)
    if 4 <= len(typed) < len(meant) - 2 and edits(typed, meant[: len(typed)], 1) <= 1:  # an abbreviation with a slip
        return 1 - EDIT_LOSS - SHORT_LOSS
    return 0.0


@F.pandas_udf(T.DoubleType())
def similarity_column(typed: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([word_similarity(a, b) for a, b in zip(typed, meant)], dtype="float64")


def soft_cosine(typed: list[str], meant: list[str], weights: list[float], short: list[str], exact: bool, alone: float) -> float:
    """Cosine of the words typed and an entry's words; a pair of words counts by its similarity.

    weights are those of the entry's words, `alone` that of a typed word that stands for none of them.
    What people put around a name, and an entry's short name beside its full one, weigh nothing.
    exact: only equal words count (a short name with another letter is another short name).
    """
    have = set(meant)
    words = [w for w in typed if w in have or w not in AROUND]
    if not exact and short and len(words) > len(meant) and all(w in words and w not in have for w in short):
        for w in short:
            words.remove(w)
    if not words:
        words = list(typed)
    left, rest, dot, size = list(words), [], 0.0, 0.0
    for m, w in zip(meant, weights):
        if m in left:
            left.remove(m)
            dot += w * w
            size += w * w
        else:
            rest.append((m, w))
    # the pairs of best similarity first
    pairs = [] if exact else sorted(((-x, i, j) for i, (m, _) in enumerate(rest) for j, t in enumerate(left) if (x := word_similarity(t, m)) > 0))
    used_m, used_t = set(), set()
    for x, i, j in pairs:
        if i not in used_m and j not in used_t:
            used_m.add(i)
            used_t.add(j)
            dot += rest[i][1] ** 2 * -x
            size += rest[i][1] ** 2
    size += alone * alone * (len(left) - len(used_t))
    whole = sum(w * w for w in weights)
    return dot / (size * whole) ** 0.5 if size and whole else 0.0


def map_values(values: DataFrame, column: str, entries: DataFrame, entry_id: str, full_name: str, short_name: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, words, n, entry_id, cosine): each distinct value that is not null or blank.

    entry_id is null where the list has no such entry, or where two entries fit within the
    margin. n counts the rows of a value. Values are compared as typed, so ties and repeated
    rows end in one row; an empty table or list gives an empty or all-null result.
    """
    v = values.select(F.col(column).cast("string").alias("value")).where(r"value rlike '(?U)\\S'").groupBy("value").agg(F.count("*").alias("n"))
    v = cut(spread(v, "value").withColumn("words", words_column("value")))
    scored = _scored(v, entries, entry_id, full_name, short_name, threshold)
    w = Window.partitionBy("value").orderBy(F.desc("cosine"), "entry")
    best = scored.withColumns({"r": F.row_number().over(w), "next": F.lead("cosine").over(w)}).where("r = 1").where(F.col("next").isNull() | (F.col("cosine") - F.col("next") >= margin))
    return v.join(best.select("value", "entry", "cosine"), "value", "left").withColumnRenamed("entry", entry_id)


def candidates(v: DataFrame, entries: DataFrame, entry_id: str, full_name: str, short_name: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((value, entry, form), the forms): the pairs to score; every pair of `threshold` or more is among them.

    A pair's cosine is at most the share of the entry's length that has a partner, so a word that makes up more
    than 1 - threshold squared of it is required. An entry is looked up by its rarest required word (where none is
    required, by its rarest words until the others alone can't pass), and all its required words must be covered.
    """
    names = entries.select(F.col(entry_id).alias("entry"), words_column(full_name).alias("full"), words_column(short_name).alias("short"))
    names = names.groupBy("entry").agg(F.first("full").alias("full"), F.first("short").alias("short"))
    one = lambda form: names.select("entry", F.lit(form).alias("form"), F.posexplode(form).alias("i", "word"), "short")
    words = cut(one("full").unionByName(one("short")))
    # weights from 1 (a word of all entries) to HEAVIEST (a word of one)
    total = words.agg(F.greatest(F.count_distinct("entry", "form"), F.lit(2)).alias("total"))
    df = words.groupBy("word").agg(F.count_distinct("entry", "form").alias("df")).crossJoin(F.broadcast(total))
    weight = df.select("word", (1 + (HEAVIEST - 1) * F.log(F.col("total") / F.col("df")) / F.log("total")).alias("w"))
    forms = words.join(weight, "word").groupBy("entry", "form").agg(F.sort_array(F.collect_list(F.struct("i", "word", "w"))).alias("x"), F.first("short").alias("short"))
    forms = cut(forms.select("entry", "form", "short", F.col("x.word").alias("meant"), F.col("x.w").alias("weights")))
    rare = F.expr("array_sort(arrays_zip(weights, meant), (a, b) -> case when a.weights > b.weights then -1 when a.weights < b.weights then 1 when a.meant < b.meant then -1 else 1 end)")
    after = F.expr("transform(x, (y, i) -> aggregate(slice(x, i + 1, size(x)), 0D, (a, z) -> a + z.weights * z.weights))")
    least = threshold * threshold
    index = forms.select("entry", "form", rare.alias("x")).withColumn("after", after)
    index = index.withColumn("required", F.expr(f"array_distinct(transform(filter(x, y -> y.weights * y.weights > {1 - least} * after[0]), y -> y.meant))"))
    prefix = F.expr(f"transform(filter(transform(x, (y, i) -> struct(y.meant as m, after[i] >= {least} * after[0] as needed)), y -> y.needed), y -> y.m)")
    keys = F.when(F.size("required") > 0, F.slice("required", 1, 1)).otherwise(F.array_distinct(prefix))
    index = cut(index.select("entry", "form", "required", F.explode(keys).alias("meant")))
    # what each distinct word typed may stand for
    typed = v.select(F.explode("words").alias("typed")).distinct()
    gram = lambda df, c: df.select(c, F.explode(grams_column(F.array(c))).alias("gram"))
    near = gram(typed, "typed").join(gram(words.select(F.col("word").alias("meant")).distinct(), "meant"), "gram").select("typed", "meant").distinct()
    most = F.ceil(F.length("meant") / EDIT_STEP).cast("int")
    close = F.col("meant").startswith(F.col("typed")) | (F.abs(F.length("typed") - F.length("meant")) <= most) & (F.levenshtein("typed", "meant") <= 2 * most)
    begun = (F.length("typed") < F.length("meant") - 2) & (F.levenshtein("typed", F.expr("substr(meant, 1, length(typed))")) <= 2)
    stands = cut(spread(near.where(close | begun)).where(similarity_column("typed", "meant") > 0))
    said = v.select("value", F.explode("words").alias("typed"))
    cover = said.join(stands, "typed").groupBy("value").agg(F.collect_set("meant").alias("cover"), F.collect_set("typed").alias("said"))
    met = cover.select("value", "cover", "said", F.explode("cover").alias("meant")).join(index, "meant")
    by = F.when(F.col("form") == "short", F.col("said")).otherwise(F.col("cover"))  # a short name must be there as it is
    return met.where(F.size(F.array_except("required", by)) == 0).select("value", "entry", "form").distinct(), forms


def _scored(v: DataFrame, entries: DataFrame, entry_id: str, full_name: str, short_name: str, threshold: float) -> DataFrame:
    """(value, entry, cosine) of the pairs of `threshold` or more, an entry by its better form."""
    near, forms = candidates(v, entries, entry_id, full_name, short_name, threshold)

    @F.pandas_udf(T.DoubleType())
    def cosine(typed: pd.Series, meant: pd.Series, weights: pd.Series, short: pd.Series, form: pd.Series) -> pd.Series:
        none = lambda x: [] if x is None else list(x)
        return pd.Series([soft_cosine(list(a), list(b), list(w), none(s), f == "short", HEAVIEST) for a, b, w, s, f in zip(typed, meant, weights, short, form)], dtype="float64")

    met = near.join(v.select("value", "words"), "value").join(forms, ["entry", "form"])
    met = met.withColumn("cosine", cosine.asNondeterministic()("words", "meant", "weights", "short", "form"))  # else Catalyst works it out in the filter too
    return met.where(F.col("cosine") >= threshold).groupBy("value", "entry").agg(F.max("cosine").alias("cosine"))


def map_rows(rows: DataFrame, key: str, column: str, entries: DataFrame, entry_id: str, full_name: str, short_name: str, none: int = 0) -> DataFrame:
    """(key, entry_id): each row whose value is not null or blank, `none` where unmatched."""
    mapped = small(cut(map_values(rows, column, entries, entry_id, full_name, short_name).select("value", entry_id)))
    src = rows.select(F.col(key), F.col(column).cast("string").alias("value")).where(r"value rlike '(?U)\\S'")
    return src.join(mapped, "value", "left").select(key, F.coalesce(F.col(entry_id), F.lit(none)).cast("long").alias(entry_id))
