"""Problem 1: broken prompt and response pairs.

Ordered rules, each emitting its defect: empty, refusal, copied, language, truncated. Whether an
output without an end mark breaks off is judged from the corpus: how often a clause with such a
beginning, and a clause with such an ending, ends a sentence in all outputs. These counts cover
all rows; they are sums over shuffled keys, joined to the few outputs that need them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.leaks import one_form
from loomwright.session import cut, widen

#: Order of the rules; the first that fires names the record's one defect.
ORDER = ("empty", "refusal", "copied", "language", "truncated")

# Labels before an answer, and words that stand for none.
LABELS = r"答案?|回答|回复|输出|结果|问题?|输入|指令|提问|answer|response|output|reply|question|input|instruction|prompt|a|q|antwort|ausgabe|frage|eingabe|回答文|出力|質問|入力|答え"
NOTHING = frozenset("none null nil na nan n/a undefined empty tbd todo unknown 空 无 無 暂无 暂缺 缺失 略 待补充 待定 未填 没有 なし 該当なし 未定 keine keins leer nichts entfällt xxx".split())
# Phrases that decline, by language; they count where they make up the answer.
REFUSALS = {  # language: (letters and words of which a phrase has one, phrases)
    "zh": (
        "不 无 恕 拒 敏感 话题 咨询 去问 没 难 超出",
        [r"(?:抱歉|对不起|很遗憾|不好意思|恕)[^。！!]{0,30}(?:不能|无法|不便|难以|恕难|没有能力|不予|不可以)",
        r"(?:我|本人|本模型|作为[^。]{0,12}(?:模型|助手|AI))[^。：:]{0,14}(?:不便|无法|不能|没有能力|没办法|不予|拒绝)[^。：:]{0,6}(?:回答|提供|完成|给出|协助|作出|判断|满足|讨论|处理|给您|对此|相关|您的|该)",
        r"恕(?:我)?(?:不能|难|不便|无法)",
        r"(?:暂不|不予|拒绝)(?:作答|回答|答复|置评)",
        r"不符合[^。]{0,10}规范",
        r"敏感内容",
        r"(?:换个?|换一个)话题",
        r"(?:请您?去问|咨询)[^。]{0,8}(?:专业人士|专业机构|专家)",
        r"无可奉告",
        r"超出了?我?的?(?:服务|能力|知识)?范围"],
    ),
    "en": (
        "sorry afraid can't can’t cannot can|not unable not|able won't will|not decline refuse not|have n't|have rather no|comment off|limit not|something against no|answer let please|ask outside model assistant an|ai",
        [r"\b(?:i|we)(?:'m| am)? ?(?:really |very |so )?(?:sorry|afraid)[^.]{0,20}\b(?:can(?:'|no)?t|can not|cannot|unable|not able|won't)\b",
        r"\bi (?:can(?:no|')t|can not|am unable to|am not able to|won't|will not|must decline|have to decline|refuse|do not have enough information|don't have enough information)",
        r"\bi(?:'d| would) rather not\b",
        r"\bmust decline\b",
        r"\bnot able to (?:complete|answer|help|provide|assist)",
        r"\bas an? (?:ai|language model|assistant)\b[^.]{0,40}\b(?:not|unable|can't|cannot)\b",
        r"\bno comment\b",
        r"\boff limits\b",
        r"\bnot something i (?:will|can|want)",
        r"\bgoes? against (?:the |our |my )?(?:policy|policies|guidelines|rules)",
        r"\bno answer will be given\b",
        r"\blet'?s (?:talk about|change)\b[^.]{0,20}\b(?:else|subject|topic)\b",
        r"\bplease ask (?:a|an|someone)\b[^.]{0,20}(?:expert|professional|else)",
        r"\boutside (?:of )?my (?:guidelines|scope|remit)"],
    ),
    "ja": (
        "ませ かね 控え 断 相談 尋ね 問い合わせ 話題 質問 ノーコメント 情報",
        [r"(?:お答え|回答|対応|提供|お手伝い|コメント|判断|ご案内)[^。]{0,10}(?:できません|できかね|いたしかね|致しかね|しかねます|控え|差し控え|お断り)",
        r"(?:申し訳|恐れ入り)[^。]{0,25}(?:できません|できかね|いたしかね|かねます|ございません。?$|お断り)",
        r"(?:専門家|専門機関)[^。]{0,12}(?:ご相談|お尋ね|お問い合わせ)",
        r"(?:別|ほか|他)の(?:話題|質問)",
        r"お断り(?:し|いた|させ)",
        r"ノーコメント",
        r"情報が(?:不足|足り)[^。]{0,14}"],
    ),
    "de": (
        "nicht kein ablehn wenden fach experten gegen thema unmöglich",
        [r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|will|werde)\b[^.]{0,60}\b(?:nicht|keine?n?)\b",
        r"\b(?:ablehnen|ablehne)\b",
        r"\bkeine (?:auskunft|angaben|antwort)\b",
        r"\bkein kommentar\b",
        r"\b(?:leider|bedauere|bedaure|tut mir leid|entschuldigung)\b[^.]{0,60}\b(?:nicht|keine?n?|unmöglich)\b",
        r"\bnicht möglich\b[^.]{0,20}\bzu (?:helfen|antworten|beantworten)",
        r"\b(?:fachmann|fachleute|fachperson|experten)\b[^.]{0,20}\b(?:wenden|fragen)",
        r"\bwenden sie sich\b",
        r"\bgegen (?:die |unsere )?(?:richtlinien|regeln)\b",
        r"\banderes thema\b"],
    ),
    "fr, es, pt, it": (
        "je|ne je|refuse je|dois je|préfère désol regrette malheureusement commentaire puedo podemos podré me|es|posible estoy|en lo|siento lamentablemente disculpe comentarios não non|poss non|sono dispiace purtroppo",
        [r"\bje (?:ne (?:peux|pourrai|suis)|refuse|dois (?:refuser|décliner)|préfère ne pas)\b",
        r"\b(?:désolée?|regrette|malheureusement)\b[^.]{0,60}\b(?:ne (?:peux|pouvons|suis|puis)|impossible|pas)\b",
        r"\b(?:aucun|sans) commentaire\b",
        r"\bno (?:puedo|podemos|podré|me es posible|estoy en condiciones)\b",
        r"\b(?:lo siento|lamentablemente|disculpe)\b[^.]{0,60}\b(?:no|imposible)\b",
        r"\bsin comentarios\b",
        r"\bnão (?:posso|podemos|consigo|me é possível)\b",
        r"\b(?:sinto muito|infelizmente|desculpe)\b[^.]{0,60}\bnão\b",
        r"\bnon (?:posso|possiamo|sono in grado)\b",
        r"\b(?:mi dispiace|purtroppo)\b[^.]{0,60}\bnon\b"],
    ),
    "ko": (
        "없 불가 어렵 못 거절 거부",
        [r"(?:죄송|유감|미안)[^.]{0,40}(?:없|불가|어렵|못)",
        r"(?:답변|제공|도와|안내|말씀)[^.]{0,14}(?:수 없|어렵|불가|못)",
        r"(?:거절|거부)(?:하|합)"],
    ),
    "ru": (
        "не без",
        [r"(?:извините|простите|к сожалению|сожалею)[^.]{0,60}\bне\b",
        r"\bя не (?:могу|смогу|в состоянии|буду)\b",
        r"\bбез комментариев\b"],
    ),
    "th": (
        "ไม่",
        [r"(?:ขออภัย|ขอโทษ|เสียใจ)[^\n]{0,60}(?:ไม่สามารถ|ไม่ได้)",
        r"ไม่สามารถ(?:ตอบ|ให้|ช่วย|ดำเนินการ)"],
    ),
}
_REFUSES = [([k.replace("|", " ") for k in keys.split()], re.compile("|".join(phrases), re.I)) for keys, phrases in REFUSALS.values()]
# Polite closings that add nothing to a refusal.
_CLOSING = re.compile(r"感谢您?的?理解|如有其他|随时告诉我|请换一个?话题|敬请谅解|let me know|anything else|thank you|thanks for|happy to help|ご了承|ご理解|ありがとう|他にご|verständnis|gerne? (?:bei|mit|eine)|vielen dank|weitere fragen|sonst noch", re.I)
# Tasks that ask for the input back in a corrected form.
_CORRECTS = re.compile(r"校对|校正|改正|纠正|更正|修正|订正|错别字|润色|病句|proof-?read|correct (?:the|any|all|this)|fix (?:the|any|all)|spelling|typo|korrigier|rechtschreib|verbesser\w* (?:den|die|das)|誤字|訂正|添削|直して", re.I)
# Languages a task may ask for.
_NAMED = {"en": r"英文|英语|英語|\benglish\b|\benglisch\w*", "zh": r"中文|汉语|漢語|中国語|简体|\bchinese\b|\bchinesisch\w*", "ja": r"日文|日语|日本語|\bjapanese\b|\bjapanisch\w*", "de": r"德文|德语|ドイツ語|\bgerman\b|\bdeutsch\w*", "th": r"泰文|泰语|タイ語|\bthai\b", "fr": r"法文|法语|フランス語|\bfrench\b|\bfranzösisch\w*"}
_ASKS = re.compile(r"译|翻|用.{0,4}(?:文|语)|以.{0,4}(?:文|语)|translat|\bin(?:to)?\b|\bauf\b|\bins\b|übersetz|訳|で(?:書|答|説明)|に(?:書|訳|翻)", re.I)
# Frequent small words of two languages of one script.
_EN = frozenset("the a an of to and is are was were for with by that our we its it this these in on at from most after has have how what which explain write helps not be as".split())
_DE = frozenset("der die das und den dem des ein eine einen ist sind mit für von im am um bei nach wir auf zu wurde über nicht werden beschreibe wie".split())
_OPEN, _CLOSE = "([{（【《“「『〔〈［｛", ")]}）】》”」』〕〉］｝"
_ENDS = "。.!?！？…"
_CLAUSE = re.compile(r"(?:[^。!?！？，,；;：:、\n.]|\.(?=\d))+([。!?！？，,；;：:、\n.]?)")
MIN_TAIL, MIN_HEAD = 0.03, 0.02


_TAGS, _ESCAPES = re.compile(r"<[^<>]*>|&nbsp;?"), re.compile(r"\\[nrt]")
_LABEL = re.compile(rf"^\W{{0,3}}(?:{LABELS})\s*[:：]", re.I)
_SENTENCE_END = re.compile(r"(?<=[。！？!?])|(?<=\.)\s+|\n")


_form = lru_cache(16)(one_form)


@lru_cache(16)
def _bare(text: str) -> str:
    """An output without tags, labels and list headings."""
    s = _ESCAPES.sub(" ", _TAGS.sub(" ", text))
    return _LABEL.sub(" ", s.strip()).strip()


def is_empty(output: str | None) -> bool:
    if output is None:
        return True
    s = _bare(output)
    t = re.sub(r"【[^【】]{0,12}】", "", s)
    words = _form(t)
    if not words:
        return True
    inner = t.strip(" \t\r\n()（）[]【】<>《》\"'“”.。…-—_*#").casefold()
    return inner in NOTHING or words in NOTHING or not inner


@lru_cache(16)
def sentences(text: str) -> list[str]:
    return [x for p in _SENTENCE_END.split(text) if (x := p.strip())]


@lru_cache(100_000)
def _declines(sentence: str) -> bool:
    low = sentence.casefold()
    return any(any(k in low for k in keys) and phrases.search(sentence) for keys, phrases in _REFUSES)


@lru_cache(100_000)
def _closes(sentence: str) -> bool:
    return bool(_CLOSING.search(sentence))


def is_refusal(output: str) -> bool:
    """The answer declines, and beyond closings nothing of substance follows."""
    said = sentences(_bare(output))
    if not any(map(_declines, said)):
        return False
    parts = [s for s in said if _declines(s) or not _closes(s)]
    hits = [_declines(s) for s in parts]
    for s, h in zip(parts, hits):  # a clause that goes on to answer
        m = re.search(r"[：:；;](.{12,})$", s)
        if h and m and not _declines(m[1]) and not re.match(r"\s*(?:please|bitte|请)", m[1]):
            return False
    declining = sum(len(s) for s, h in zip(parts, hits) if h)
    return declining >= 0.5 * sum(map(len, parts))


def _grams(a: str, n: int) -> list[str]:
    return [a[i : i + n] for i in range(len(a) - n + 1)]


def _covered(a: str, b: str, least: float, n: int = 5) -> bool:
    """Whether at least this share of a lies in b, by n-grams; given up where too many are missing."""
    if len(a) < n:
        return bool(a) and (a in b) >= least
    grams, own = set(_grams(b, n)), _grams(a, n)
    room = len(own) * (1 - least) + 1e-9
    for at in range(0, len(own), 64):
        part = own[at : at + 64]
        room -= len(part) - sum(map(grams.__contains__, part))
        if room < 0:
            return False
    return True


def is_copied(instruction: str, inp: str, output: str) -> bool:
    o, i, n = _form(_bare(output)), _form(instruction), _form(inp)
    if not o:
        return False
    if len(o) >= 4 and (o == i or (o == n and len(o) >= 6)):
        return True
    if len(o) < 8 or not _covered(o, f"{i}\n{n}", 0.85):
        return False
    whole_prompt = _covered(i, o, 0.6)
    if whole_prompt and _covered(o, i, 0.85):
        return True
    if _CORRECTS.search(instruction) and n:
        return o == n + n or o in (i + n, n + i)
    return _covered(n, o, 0.5) or (whole_prompt and _covered(o, i + n, 0.95))


_SCRIPTS = {"han": "一-鿿㐀-䶿", "kana": "぀-ヿ", "th": "฀-๿", "ko": "가-힯", "ru": "Ѐ-ӿ", "ar": "؀-ۿ", "el": "Ͱ-Ͽ", "hi": "ऀ-ॿ"}
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_RUNS = re.compile("|".join([f"(?P<la>[{_LETTER}][{_LETTER} ]*)", *(f"(?P<{k}>[{v}]+)" for k, v in _SCRIPTS.items())]))
_UMLAUT = re.compile("[äöüß]")


@lru_cache(100_000)
def _script_of(sentence: str) -> tuple[str, float]:
    """(language, weight) of a sentence by the script most of it is in."""
    size: dict[str, float] = {}
    words = []
    for m in _RUNS.finditer(sentence):
        k = m.lastgroup
        if k == "la":
            words += m[0].casefold().split()
        else:
            size[k] = size.get(k, 0.0) + len(m[0])
    kana = size.pop("kana", 0.0)
    size["cj"] = size.pop("han", 0.0) + kana
    size["la"] = sum(map(len, words)) / 2.5
    lang = max(["cj", "la", "th", "ko", "ru", "ar", "el", "hi"], key=lambda k: size.get(k, 0.0))
    best = size.get(lang, 0.0)
    if lang == "cj":
        lang = "ja" if kana >= 0.1 * best else "zh"
    elif lang == "la":
        e, d = sum(w in _EN for w in words), sum((w in _DE) + bool(_UMLAUT.search(w)) for w in words)
        lang = "de" if d > e else "en" if e else "la"
    return lang, best


def scripts(text: str) -> dict[str, float]:
    """Weight of each language in a text, by sentences; a Latin word weighs like its letters / 2.5."""
    out: dict[str, float] = {}
    for s in sentences(text):
        lang, weight = _script_of(s)
        if weight >= 1:
            out[lang] = out.get(lang, 0.0) + weight
    return out


@lru_cache(50_000)
def wanted_language(instruction: str) -> str | None:
    named = [k for k, p in _NAMED.items() if re.search(p, instruction, re.I)]
    if len(named) == 1 and _ASKS.search(instruction):
        return named[0]
    have = scripts(instruction)
    if not have:
        return None
    if "ja" in have:
        return "ja"
    best = max(have, key=lambda k: have[k])
    return "en" if best == "la" else best


def is_foreign(instruction: str, output: str) -> bool:
    """More than half of the output is in another language than the one wanted."""
    body = _bare(output)
    if body[:1] in "{[" and body[-1:] in "}]":
        return False
    want = wanted_language(instruction)
    have = scripts(body)
    total = sum(have.values())
    if want is None or total < 3:
        return False
    fits = have.get(want, 0.0) + have.get("la", 0.0) * (want in ("en", "de", "fr"))
    if set(have) <= {"la"} and want not in ("en", "de", "fr"):
        return total > 12 and not re.search(r"\d", body)
    return fits < 0.5 * total


def _list_like(text: str) -> bool:
    items = [x for x in re.split(r"[、,，;；]", text) if x.strip()]
    return len(items) > 1 and max(map(len, items)) <= 14 and not re.search(r"[。!?！？：:]", text)


_WORDS, _LATIN = re.compile(r"[^\W_]+"), re.compile(r"[\x00-ɏ]+")


@lru_cache(200_000)
def _ends(clause: str) -> tuple[str, str]:
    """(beginning, ending) of a clause: words in Latin script, two characters else."""
    c = clause.strip(" \t\r\n”’」』）)】》\"'")
    words = _WORDS.findall(c)
    if len(words) > 1 and _LATIN.fullmatch(words[-1]) and _LATIN.fullmatch(words[0]):
        return words[0].casefold(), "#" if words[-1].isdigit() else words[-1].casefold()
    c = re.sub(r"\d", "0", c)
    return c[:2].casefold(), c[-2:].casefold()


def clauses(text: str) -> list[tuple[str, str, bool]]:
    """(beginning, ending, ends a sentence) of the clauses of an output; items of a list end like sentences."""
    listed = _list_like(text)
    out = []
    for m in _CLAUSE.finditer(text):
        if m[1] and m[0][:-1].strip():
            out.append((*_ends(m[0][: -len(m[1])]), m[1] in "。.!?！？" or listed))
    return out


def broken_off(output: str) -> tuple[bool | None, str, str]:
    """Whether an output breaks off; None if its last clause (beginning, ending) has to tell."""
    s = output.rstrip()
    if not s:
        return False, "", ""
    if re.search(r"(?:未完|待续|to be continued|fortsetzung folgt|続く)\W*$", s, re.I) or s.endswith(("…", "...", "-", "—", "，", ",", "、", "：", ":", "；", ";", "（", "(", "【", "“", "「")):
        return True, "", ""
    if s[0] in "{[" and '"' in s:
        try:
            json.loads(s)
            return False, "", ""
        except ValueError:
            return s[-1] not in "}]", "", ""
    stack = []
    for i, c in enumerate(s):
        if c in _OPEN:
            stack.append((c, i))
        elif c in _CLOSE and stack and stack[-1][0] == _OPEN[_CLOSE.index(c)]:
            stack.pop()
    if stack and s[-1] not in _ENDS:
        return True, "", ""
    if s.count("```") % 2:
        return True, "", ""
    if s.endswith("】") or re.search(r"[；;。]\s*\d{1,2}\s*[.、．]?$", s):  # a label or list mark without its text
        return True, "", ""
    if s[-1] in _ENDS or re.fullmatch(r"[\d\s.,%+-]+", s) or len(_form(s)) <= 3:
        return False, "", ""
    if len(s) > 1 and s[-1] in "”’」』）)》\"'" and s[-2] in _ENDS:
        return False, "", ""
    last = re.split(r"[。!?！？，,；;：:、\n]|\.(?!\d)", s)[-1]
    return (None, *_ends(last))


def find_defects(rows: DataFrame, key: str, instruction: str, inp: str, output: str) -> DataFrame:
    """(key, defects ARRAY<STRING>): every record with a defect, all its defects in the order of the rules.

    Null instructions and inputs are empty; a null output is `empty`, and an empty output has no
    other defect. Each row is judged by its own texts and the corpus's counts, so repeated rows
    get the same defects. Very long texts are read whole. An empty table gives an empty result.
    """
    kind = rows.schema[key].dataType.simpleString()
    src = widen(rows).select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((instruction, "i"), (inp, "n"))], F.col(output).cast("string").alias("o"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of judged records, and rows (part, gram, n, ends) of the clauses counted, in one reading of a text."""
        for f in frames:
            out, seen, ended = [], Counter(), Counter()
            for k, i, n, o in zip(f["key"], f["i"], f["n"], f["o"]):
                for h, t, e in clauses(o) if o is not None else ():
                    for gram in (("h", h), ("t", t)):
                        seen[gram] += 1
                        ended[gram] += e
                if is_empty(o):
                    out.append((k, ["empty"], "", "", None, None, 0, 0))
                    continue
                found = [d for d, hit in (("refusal", is_refusal(o)), ("copied", is_copied(i, n, o)), ("language", is_foreign(i, o))) if hit]
                off, head, tail = broken_off(o)
                if off:
                    found.append("truncated")
                if found or off is None:
                    out.append((k, found, *((head, tail) if off is None else ("", "")), None, None, 0, 0))
            out += [(None, None, None, None, part, gram, n, ended[part, gram]) for (part, gram), n in seen.items()]
            yield pd.DataFrame(out, columns=["key", "defects", "head", "tail", "part", "gram", "n", "ends"])

    read = cut(src.mapInPandas(judge, f"key {kind}, defects array<string>, head string, tail string, part string, gram string, n long, ends long"))
    judged = read.where("part is null").select("key", "defects", "head", "tail")
    share = read.where("part is not null").groupBy("part", "gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # a beginning that never ended a sentence speaks the more against one the more often it was seen
    heads = share.where("part = 'h'").select(F.col("gram").alias("head"), ((F.col("ends") + 0.4) / F.col("n")).alias("head_share"))
    tails = share.where("part = 't'").select(F.col("gram").alias("tail"), (F.col("ends") / F.col("n")).alias("tail_share"))
    open_ = judged.where("tail <> ''").join(heads, "head", "left").join(tails, "tail", "left")
    off = (F.coalesce("tail_share", F.lit(0.0)) < MIN_TAIL) | (F.coalesce("head_share", F.lit(1.0)) < MIN_HEAD)
    settled = open_.select("key", F.when(off, F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects")).alias("defects"))
    return judged.where("tail = ''").select("key", "defects").unionByName(settled).where("size(defects) > 0").withColumnRenamed("key", key)
