"""Problem 5: variant spellings of one organisation's name.

Pigeonhole segment join. A name is reduced to its brand: legal forms go, and so do generic words,
which are learned from all names as character n-grams (Latin script: words) in a share of all
organisations. A name of generic words only is its own brand. Brands within k edits are sought by
segments: cut into k+1 parts, one part of the shorter brand stays whole in the longer one, shifted by
k places at most. Parts and the substrings that look them up meet in an inverted
index together with what the two rows must agree in besides the name (see `linked`), so a common
part stays selective; where that is a date or address of very many rows, two parts must meet at once. Banded edit distance decides every pair: none beyond k is linked.
Rows alike in all that counts are one profile; links between profiles are closed to classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm.canon import edits
from loomwright.llm.components import classes
from loomwright.session import cut, spread, widen

# Legal forms, longest first.
LEGAL_HAN = "股份有限责任公司 集团有限责任公司 集团股份有限公司 股份有限公司 集团有限公司 有限责任公司 控股有限公司 有限公司 集团公司 股份公司 责任公司 控股 集团 股份 公司".split()
LEGAL_LATIN = frozenset("co company corp corporation inc incorporated ltd limited llc gmbh mbh gesellschaft ag plc sa srl bv kg the and of".split())
# Traditional forms frequent in names, and their simplified ones.
TRADITIONAL = "長东東車馬門風飛魚鳥麥黃齊龍龜電備機業遠寧聯銳輝華銘澤鋒鳳達潤雲義樂慶優鈞鴻萬國際學藝術發開關動務勞區醫藥產經濟營銷貿實驗術樓榮葉蘇陳劉張楊趙劍紅綠藍絲線網絡維縱橫興舊鐵鋼銀錢鍵鏡顯訊誠識證讀貝財貨質貴賓賢贏軟輪農進運選郵鄭鄧鄉錦鎮鑫鑽閩陽陰際隊階雙雜離難靈靜韓順預領頭題願風飯飲館驛驗體鮮鶴鷹麗齡億價傳儀倉偉備傑傢償兒內兩剛創劃勝勵匯協單厲參號嘯團園圓圖場塊壓報塗墻夢奪奧獎婦媽孫寬寶將對導專層嶺島崗嵐幣師帶幫庫廠廣廢張彈彙徑從復德恆懷戰戲擴據擇"
SIMPLIFIED = "长东东车马门风飞鱼鸟麦黄齐龙龟电备机业远宁联锐辉华铭泽锋凤达润云义乐庆优钧鸿万国际学艺术发开关动务劳区医药产经济营销贸实验术楼荣叶苏陈刘张杨赵剑红绿蓝丝线网络维纵横兴旧铁钢银钱键镜显讯诚识证读贝财货质贵宾贤赢软轮农进运选邮郑邓乡锦镇鑫钻闽阳阴际队阶双杂离难灵静韩顺预领头题愿风饭饮馆驿验体鲜鹤鹰丽龄亿价传仪仓伟备杰家偿儿内两刚创划胜励汇协单厉参号啸团园圆图场块压报涂墙梦夺奥奖妇妈孙宽宝将对导专层岭岛岗岚币师带帮库厂广废张弹汇径从复德恒怀战戏扩据择"
_SIMPLER = str.maketrans(TRADITIONAL, SIMPLIFIED)
#: An n-gram in the names of this share of all organisations is a generic word; a place named by this share of all addresses too.
#: Counts are taken three standard deviations low, so that a few of few organisations are no share yet: the rule is one at every size.
GENERIC_SHARE, PLACE_SHARE = 0.0015, 0.0005
#: A date or address of more profiles than this is looked up by two segments at once. Either way finds all pairs.
HOT = 200
_HAN = re.compile(r"[一-鿿]")


def plain_name(name: str | None) -> tuple[str, bool]:
    """(name in one form, without legal forms; words apart by blanks, whether it is in Han script)."""
    s = unicodedata.normalize("NFKC", name or "").casefold().translate(_SIMPLER)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn"))
    han = bool(_HAN.search(s))
    if han:
        s = re.sub(r"[^\w]+", " ", s)
        s = re.sub("|".join(LEGAL_HAN), " ", s)
        return " ".join(s.split()), True
    s = re.sub(r"(?<=\w)-(?=\w)", "", s)
    words = re.findall(r"[^\W_]+", s)
    return " ".join(w for w in words if w not in LEGAL_LATIN), False


def generic_grams(plain: str, han: bool) -> set[str]:
    if not han:
        return {w for w in plain.split() if len(w) > 2}
    return {w[i : i + n] for w in plain.split() for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)}


def clipped(generic: frozenset[str]) -> frozenset[str]:
    """Two-character short forms of generic words of four: first with second, third or fourth character."""
    return frozenset(x for g in generic if len(g) == 4 and _HAN.match(g) for x in (g[:2], g[0] + g[2], g[0] + g[3]))


def brand_of(plain: str, han: bool, generic: frozenset[str], short: frozenset[str]) -> tuple[str, str]:
    """(brand, the generic rest) of a plain name; short: short forms of generic words."""
    if not han:
        words = plain.split()
        own = [w for w in words if w not in generic and not (len(w) > 2 and w in short)]
        # an initial with the rest of the name
        return "".join(own), " ".join(sorted(w for w in words if w not in own))
    brand, rest = [], []
    for w in plain.split():
        hidden = [False] * len(w)
        for n in (5, 4, 3, 2):
            for i in range(len(w) - n + 1):
                if w[i : i + n] in generic:
                    hidden[i : i + n] = [True] * n
        if (len(w) > 3 or w in short and " " in plain) and w[-2:] in short and not hidden[-1]:
            hidden[-2:] = [True, True]
        for i in range(1, len(w)):
            if w[i] in "省市" and hidden[i - 1]:
                hidden[i] = True
        brand.append("".join(c for c, h in zip(w, hidden) if not h))
        rest.append("".join(c for c, h in zip(w, hidden) if h and c not in "省市"))
    b = "".join(brand)
    while len(b) > 2 and b[0] == "老":
        b = b[1:]
    return b, "".join(rest)


_ROAD = "(?:路|街|道|巷|大道)"
_STREETS = [re.compile(rf"([一-鿿]{{2}}(?:区|县|镇|乡|街道)[一-鿿]{{1,5}}{_ROAD}\d+号)"), re.compile(rf"([一-鿿]{{1,4}}{_ROAD}\d+号)")]


def plain_address(a: str | None) -> str:
    """District, street and number, without room, province and city, which are often left out; '' if none."""
    s = unicodedata.normalize("NFKC", a or "").casefold().translate(_SIMPLER)
    if _HAN.search(s):
        s = re.sub(r"\s+", "", s)
        for street in _STREETS:
            if m := street.search(s):
                return m[1]
        return s if re.search(r"\d", s) else ""
    s = re.sub(r"\brd\b\.?", "road", s.split(",")[0])
    s = re.sub(r"\bst\b\.?", "street", s)
    s = " ".join(re.findall(r"[^\W_]+", s))
    return s if re.search(r"\d", s) else ""


def capital(c: str | None) -> str:
    m = re.match(r"\s*([\d,]+(?:\.\d+)?)\s*(万|亿)?", unicodedata.normalize("NFKC", c or ""))
    return str(round(float(m[1].replace(",", "")) * {"万": 1e4, "亿": 1e8, None: 1}[m[2]])) if m else ""


def org_type(t: str | None) -> str:
    return re.sub(r"[\s()（）]", "", unicodedata.normalize("NFKC", t or ""))


def tolerance(length: int, han: bool) -> int:
    """Edits k allowed between two brands, the longer of this length: half of a Han brand, a third of a Latin one."""
    return max(1, length // 2 if han else length // 3)


def found_by(brands: DataFrame) -> DataFrame:
    """brands (b, k, ...) with (l, part): a row for each of the k + 1 parts b, of length l, is cut into."""
    d = brands.withColumn("__i", F.explode(F.expr("sequence(0, least(k + 1, length(b)) - 1)"))).withColumn("l", F.length("b"))
    return _placed(d).withColumn("part", F.expr("substr(b, __p + 1, __q - __p)")).drop("__i", "__p", "__q")


def looked_up(brands: DataFrame) -> DataFrame:
    """brands (b, k, ...) with (l, part): a row for each substring that may be a part of a brand of length l, no longer and within k edits: parts shifted by up to k.

    A swap of neighbours is one edit but may touch two parts; its letters are found one place aside, or, where parts
    are longer, k must count it as two. Rows may repeat.
    """
    d = brands.withColumn("l", F.explode(F.expr("sequence(greatest(1, length(b) - k), length(b))")))
    d = _placed(d.withColumn("__i", F.explode(F.expr("sequence(0, least(k + 1, l) - 1)"))))
    d = d.withColumn("__t", F.explode(F.expr("sequence(greatest(-k, -__p), least(k, length(b) - __q))")))
    return d.withColumn("part", F.expr("substr(b, __p + __t + 1, __q - __p)")).drop("__i", "__p", "__q", "__t")


def _placed(d: DataFrame) -> DataFrame:
    """With the place of the i-th of k + 1 parts of a brand of length l."""
    return d.withColumns({"__p": F.expr("cast(__i * l div least(k + 1, l) as int)"), "__q": F.expr("cast((__i + 1) * l div least(k + 1, l) as int)")})


_PART = "substr(b, {x} * l div least(4, l) + {shift} + 1, ({x} + 1) * l div least(4, l) - {x} * l div least(4, l))"
#: Parts and substrings, as found_by and looked_up have them, for one edit at most, a swap among them: of four parts two stay whole, and both must meet.
TWO_SEGMENTS = f"case when length(b) < 2 then array() else flatten(transform(array(length(b)), l -> flatten(transform(sequence(0, least(4, l) - 2), i -> transform(sequence(i + 1, least(4, l) - 1), j -> concat_ws('|', l, i, j, {_PART.format(x='i', shift=0)}, {_PART.format(x='j', shift=0)})))))) end"
TWO_SUBSTRINGS = (
    "case when length(b) < 2 then array() else array_distinct(flatten(transform(sequence(greatest(2, length(b) - 1), length(b)), l -> flatten(transform(sequence(0, least(4, l) - 2), i -> flatten(transform(sequence(i + 1, least(4, l) - 1), "
    f"j -> transform(array(struct(0 as s, 0 as t), struct(0 as s, length(b) - l as t), struct(length(b) - l as s, length(b) - l as t)), x -> concat_ws('|', l, i, j, {_PART.format(x='i', shift='x.s')}, {_PART.format(x='j', shift='x.t')}))))))))) end"
)
#: Edits allowed between two brands, the longer of length(b) + d.
TOLERANCE = "cast(greatest(1, if(han, (length(b) + {d}) div 2, (length(b) + {d}) div 3)) as int)"


def short_forms(b: str, han: bool) -> set[str]:
    """The usual short forms of a brand within its tolerance: its beginning or end; in Latin script also its initial with the end."""
    k, least = tolerance(len(b), han), 2 if han else 4
    out = {x for n in range(max(least, len(b) - k), len(b)) for x in ((b[:n], b[-n:]) if han else (b[:n], b[0] + b[-(n - 1) :]))}
    return out - {b}


def same_place(x: str, y: str) -> bool:
    """Whether the generic rest of one name lies within the other's: nothing speaks against."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    it = set(b.split()) if " " in b or " " in a else set(b)
    parts = a.split() if " " in b or " " in a else a
    return all(p in it for p in parts)


def linked(b1: str, b2: str, han: bool, bare1: bool, bare2: bool, r1: str, r2: str, p1: str, p2: str, est: int, addr: int, cap: int, kind: int) -> bool:
    """The decision on a pair: edit distance, within k to the name or 1 to a short form of it, the less the less else agrees.

    est, addr, cap, kind: 1 agree, -1 differ, 0 not known. bare: the name is of generic words only; against a
    name with a brand the whole names (p1, p2) are compared.
    """
    if min(est, addr, cap, kind) < 0:
        return False
    agree = (est > 0) * 2 + (addr > 0) * 2 + (cap > 0)
    if bare1 and bare2:
        return b1 == b2 and agree >= 1
    if bare1 or bare2:
        p1, p2 = p1.replace(" ", ""), p2.replace(" ", "")
        k = tolerance(max(len(p1), len(p2)), han)
        return est > 0 and addr > 0 and edits(p1, p2, k) <= k
    if b1 == b2:
        return agree >= 2 or (same_place(r1, r2) and (agree >= 1 or r1 == r2))
    x, y = (b1, b2) if len(b1) <= len(b2) else (b2, b1)
    k = tolerance(len(y), han)
    d = edits(b1, b2, k)
    if d > k:  # a short form with a slip is as far from the name as from its true short form
        return agree >= 5 and any(edits(x, z, 1) <= 1 for z in short_forms(y, han))
    if d <= 1 and len(y) > 2 or x in short_forms(y, han):
        return agree >= 2
    return agree >= 4 or (agree >= 3 and len(y) > 2)


def keys(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((x, key) to be found by, (y, key) to look up) of profiles, keys as digests.

    By a date or an address (kinds e, a): brands within two edits, or one where very many have it, and short forms.
    By two things that agree (b, p): brands within k edits, as far as the first way does not find them. Without a
    mark: equal brands by the capital, or by the rest of the name. By date and address (p) also names of generic
    words only against names with a brand.
    """
    b = full.where("marks is not null").select("id", "han", "bare", F.col("brand").alias("b"), "marks")
    b = b.withColumn("hot", F.exists("marks", lambda m: m["kind"].isin("e", "a") & (m["n"] > HOT))).withColumn("tol", F.expr(TOLERANCE.format(d=0)))
    marked = b.withColumn("m", F.explode("marks")).select("id", "han", "bare", "b", "hot", "tol", "m.kind", "m.mark", (F.col("m.kind").isin("e", "a") & (F.col("m.n") > HOT)).alias("very"))
    single, least_k = F.col("kind").isin("e", "a"), F.expr("if(hot, 1, 3)")  # up to two edits are found by one mark already, unless very many have it: then short brands are not
    # k of a pair goes by the longer brand: a brand is cut for every k that a longer one may have
    ks = F.expr("array_distinct(transform(sequence(0, length(b) + 1), d -> " + TOLERANCE.format(d="d") + "))")
    plain = marked.where(single & ~F.col("very")).withColumn("k", F.lit(2))
    cut_for = plain.unionByName(marked.where(~single).withColumn("k", F.explode(ks)).where(F.col("k") >= least_k))
    asked_for = plain.unionByName(marked.where(~single).withColumn("k", F.col("tol")).where(F.col("k") >= least_k))
    short = F.expr(
        "case when length(b) < 2 then array() else array_distinct(transform(flatten(transform(filter(sequence(1, length(b) - 1), n -> n >= greatest(if(han, 2, 4), length(b) - tol)), "
        "n -> array(struct(n, true as head), struct(n, false as head)))), x -> if(x.head, left(b, x.n), if(han, right(b, x.n), concat(left(b, 1), right(b, x.n - 1)))))) end"
    )

    def side(name: str, parts: DataFrame, two: str, short: F.Column, whole: F.Column) -> DataFrame:
        key = lambda *cs: F.xxhash64("han", "mark", *cs).alias("key")
        own = F.col("id").alias(name)
        out = parts.select(own, key(F.lit("x"), "k", "l", "part"))
        out = out.unionByName(marked.where("very").select("id", "han", "mark", F.explode(F.expr(two)).alias("part")).select(own, key(F.lit("t"), "part")))
        swapped = marked.where("very and length(b) = 3").withColumn("part", F.array_join(F.array_sort(F.split("b", "")), ""))  # a swap leaves one of three letters in place
        out = out.unionByName(swapped.select(own, key(F.lit("u"), "part")))
        out = out.unionByName(marked.where(single).select("id", "han", "mark", F.explode(short).alias("part")).select(own, key(F.lit("s"), "part")))
        return out.unionByName(marked.where((F.col("kind") == "p") & whole).select(own, key(F.lit("w"))))

    own = side("x", found_by(cut_for), TWO_SEGMENTS, F.array("b"), ~F.col("bare"))
    seek = side("y", looked_up(asked_for), TWO_SUBSTRINGS, short, F.col("bare"))
    equal = F.array_compact(F.array(F.when(F.col("cap") != "", F.xxhash64(F.lit("c"), "han", "brand", "cap")), F.when(~F.col("bare"), F.xxhash64(F.lit("r"), "han", "brand", "rest"))))
    # a short form with a slip is further than k: by date, address and capital together
    three = F.col("id"), F.xxhash64(F.lit("q"), "han", "est", "addr", "cap").alias("key")
    known = full.where("est <> '' and addr <> '' and cap <> ''")
    own, seek = (d.unionByName(known.select(three[0].alias(c), three[1])) for d, c in ((own, "x"), (seek, "y")))
    thin = F.col("bare") | (F.col("est") == "") | (F.col("addr") == "")
    return own.unionByName(full.select(F.col("id").alias("x"), F.explode(equal).alias("key"))), seek.unionByName(full.where(thin).select(F.col("id").alias("y"), F.explode(equal).alias("key")))


def link_names(rows: DataFrame, key: str, name: str, founded: str, address: str, capital_: str, type_: str) -> DataFrame:
    """(key, class): every row with a name; rows of one class are one organisation.

    The class is the smallest key of its rows. Rows without a name (null, empty, blank) have
    none and don't come out. Other columns may be null; repeated rows fall into one class; an
    empty table gives an empty result.
    """
    cols = [F.col(c).cast("string").alias(a) for c, a in ((name, "name"), (address, "addr"), (capital_, "cap"), (type_, "type"))]
    src = rows.select(F.col(key).alias("key"), *cols, F.substring(F.trim(F.col(founded).cast("string")), 1, 10).alias("est")).where(r"name rlike '(?U)\\w'")

    def tidy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            plain = [plain_name(x) for x in f["name"]]
            yield pd.DataFrame({"key": f["key"], "plain": [p for p, _ in plain], "han": [h for _, h in plain], "est": f["est"].fillna(""), "addr": f["addr"].map(plain_address), "cap": f["cap"].map(capital), "type": f["type"].map(org_type)})

    kind = rows.schema[key].dataType.simpleString()
    tidied = cut(widen(src).mapInPandas(tidy, f"key {kind}, plain string, han boolean, est string, addr string, cap string, type string"))
    profiles = tidied.groupBy("plain", "han", "est", "addr", "cap", "type").agg(F.min("key").alias("id"))
    profiles = cut(profiles)

    # generic words: an n-gram of at least a fixed share of the organisations; their number is bounded by n-grams a name / share.
    # An organisation counts once however often it is typed: by the first two it has of address, date and capital, as one
    # alone is that of many organisations in a large table; names without any of them count as one, or, where no row has any, each as its own.
    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(g, h, o) for p, h, o in zip(f["plain"], f["han"], f["org"]) for g in generic_grams(p, h)], columns=["gram", "han", "org"])

    marked = profiles.where("addr <> '' or est <> '' or cap <> ''").limit(1).count()
    mark = F.slice(F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c} "), c)) for c in ("addr", "est", "cap")])), 1, 2)
    orgs = profiles.select("plain", "han", F.xxhash64(mark if marked else F.col("plain")).alias("org")).distinct()
    total = orgs.select("han", "org").distinct().groupBy("han").agg(F.count("*").alias("total"))
    df = orgs.mapInPandas(grams, "gram string, han boolean, org long").distinct().groupBy("gram", "han").count()
    surely = F.col("count") - 3 * F.sqrt("count")
    first = [F.regexp_extract("addr", "^(?:([一-鿿]{2,3}?)省)?(?:([一-鿿]{2,4}?)市)?", i) for i in (1, 2)]
    places = src.select(F.explode(F.array(*first)).alias("gram")).where("gram <> ''").groupBy("gram").count()
    many = src.where("addr is not null").agg(F.count("*").alias("total"))
    common = df.join(F.broadcast(total), "han").where(surely >= F.col("total") * GENERIC_SHARE)
    named = places.crossJoin(F.broadcast(many)).where(surely >= F.col("total") * PLACE_SHARE).select("gram", F.lit(True).alias("han"))
    words = [(r.gram, r.han) for r in common.select("gram", "han").unionByName(named).collect()]
    han_words = frozenset(g for g, h in words if h)
    latin_words = frozenset(g for g, h in words if not h)
    stems = frozenset(w[:n] for w in latin_words for n in range(3, len(w)))
    short = clipped(han_words)

    # what a profile may share with others: a date, an address, or two things of three; only what several profiles have
    known = {c: F.when(F.col(c) != "", F.col(c)) for c in ("est", "addr", "cap")}
    one = lambda letter, *cs: F.when(F.concat(*[known[c] for c in cs]).isNotNull(), F.struct(F.lit(letter).alias("kind"), F.xxhash64(F.lit("".join(cs)), *cs).alias("mark")))
    all_marks = F.array_compact(F.array(one("e", "est"), one("a", "addr"), one("p", "est", "addr"), one("b", "est", "cap"), one("b", "addr", "cap")))
    shared = profiles.select("id", "han", F.explode(all_marks).alias("m")).select("id", "han", "m.kind", "m.mark")
    shared = shared.withColumn("n", F.count("*").over(Window.partitionBy("mark", "han"))).where("n > 1")
    marks = shared.groupBy("id").agg(F.collect_list(F.struct("kind", "mark", "n")).alias("marks"))

    def branded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, h in zip(f["plain"], f["han"]):
                b, r = brand_of(p, h, han_words, short) if h else brand_of(p, h, latin_words, stems)
                out.append((b, False, r) if b else (p.replace(" ", ""), True, ""))
            yield f.assign(**{c: [o[i] for o in out] for i, c in enumerate(("brand", "bare", "rest"))})

    fields = profiles.schema.simpleString()[7:-1].replace(":", " ") + ", brand string, bare boolean, rest string"
    full = cut(spread(profiles, "id").mapInPandas(branded, fields).join(marks, "id", "left"))
    own, seek = keys(full)
    met = own.join(seek, "key").where("x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    facts = ["plain", "brand", "han", "bare", "rest", "est", "addr", "cap", "type"]
    sides = [full.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in facts]) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    agree = lambda c: F.when((F.col(f"{c}_a") == "") | (F.col(f"{c}_b") == ""), 0).when(F.col(f"{c}_a") == F.col(f"{c}_b"), 1).otherwise(-1).alias(c)
    # addresses one slip apart, with the same numbers, neither agree nor differ
    digits = [F.regexp_replace(f"addr_{s}", r"\D", "") for s in "ab"]
    near = (F.levenshtein("addr_a", "addr_b", 1) >= 0) & (digits[0] == digits[1]) & (F.length("addr_a") > 4)
    place = F.when((F.col("addr_a") == "") | (F.col("addr_b") == ""), 0).when(F.col("addr_a") == F.col("addr_b"), 1).when(near, 0).otherwise(-1).alias("addr")
    facts_of = both.select("a", "b", "brand_a", "brand_b", "han_a", "bare_a", "bare_b", "rest_a", "rest_b", "plain_a", "plain_b", agree("est"), place, agree("cap"), agree("type")).where("est >= 0 and addr >= 0 and cap >= 0 and type >= 0")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [linked(*x) for x in zip(*[f[c] for c in ("brand_a", "brand_b", "han_a", "bare_a", "bare_b", "rest_a", "rest_b", "plain_a", "plain_b", "est", "addr", "cap", "type")])]
            yield f.loc[ok, ["a", "b"]]

    links = cut(spread(facts_of).mapInPandas(verify, f"a {kind}, b {kind}"))
    label = classes(links).withColumnsRenamed({"key": "id"})
    of = profiles.join(label, "id", "left").withColumn("class", F.coalesce("class", "id")).drop("id")
    on = ["plain", "han", "est", "addr", "cap", "type"]
    return tidied.join(of, on).select(F.col("key").alias(key), "class")


def class_pairs(members: DataFrame, key: str, cls: str = "class") -> DataFrame:
    """(key_a, key_b): all pairs of rows of one class, the smaller key first."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col(f"a.{cls}") == F.col(f"b.{cls}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b"))
