"""Pieces of ANSI SQL for the checks of the queries: the cleaners spelt as regular expressions of RE2."""

from __future__ import annotations

from functools import reduce

from loomwright.functions import text as tx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def trim(c: str) -> str:
    return rep(c, f"^{tx.SPACE}+|{tx.SPACE}+$")


def squeeze(c: str) -> str:
    return rep(c, f"{tx.SPACE}+", " ")


def fill(c: str) -> str:
    return f"coalesce({c}, '')"


def non_blank(c: str) -> str:
    return f"nullif({trim(c)}, '')"


def is_blank(c: str) -> str:
    return f"coalesce({trim(c)} = '', true)"


def translate(c: str, a: str, b: str) -> str:
    return f"translate({c}, {lit(a)}, {lit(b)})"


def without(c: str, literals: list[str]) -> str:
    return reduce(lambda acc, x: f"replace({acc}, {lit(x)}, '')", literals, c)


def words(c: str) -> str:
    s = rep(squeeze(trim(c)), r"[，,；;/\\|]+", " ")
    return trim(squeeze(rep(s, tx.WORD_CLASS, " ")))


def tags_out(c: str) -> str:
    s = translate(rep(rep(c, tx.OPEN_TAG), tx.CLOSE_TAG), tx.STRAY, "")
    return trim(without(rep(s, tx.SUPPORT_LISTS), tx.RESIDUE))


def html(c: str) -> str:
    return tags_out(rep(c, tx.SPACE_ENTITIES))


def edge(c: str) -> str:
    return rep(rep(c, f"^{tx.EDGE_PUNCT}+"), f"{tx.EDGE_PUNCT}+$")


def cut_bracket(c: str) -> str:
    return trim(rep(c, r"(?s)[（(].*$"))


def first_word(c: str) -> str:
    return f"case when {trim(c)} = '' then {c} else regexp_split_to_array({trim(c)}, {lit(tx.SPACE + '+')})[1] end"


def scale(c: str) -> str:
    return f"case {trim(c)} when '1' then '小型' when '2' then '中型' when '3' then '大型' else {trim(c)} end"


def category(c: str) -> str:
    return rep(squeeze(trim(c)), r"[，,。.；;：:\s]+$")


def duty(c: str) -> str:
    return rep(rep(c, tx.DUTY_SEPARATORS, "；"), "^；+|；+$")


def application(c: str) -> str:
    s = rep(f"replace({trim(c)}, '，', ',')", r"(?s)^\[(.*)\]$", r"\1")
    s = f"""array_to_string(list_transform(string_split({s}, '"'), lambda x, i: case when i % 2 = 1 then replace(x, ',', ';') else x end), '')"""
    return rep(rep(rep(s, f"{tx.SPACE}*;{tx.SPACE}*", ";"), ";+", ";"), "^[ ;]+|[ ;]+$")


def field(c: str) -> str:
    s = reduce(rep, tx.NUMBERINGS, trim(c))
    s = translate(translate(s, tx.BULLETS, ""), "，；", ",;")
    return rep(rep(rep(rep(s, tx.ENCLOSED), f"{tx.SPACE}+"), r"[,.;]+", ","), "^,+|,+$")


def label(c: str) -> str:
    return rep(rep(trim(fill(c)), tx.LABEL_PUNCT, "，"), "^，+|，+$")


def spacing(c: str) -> str:
    w = f"list_filter(string_split({squeeze(c)}, ' '), lambda x: x <> '')"
    plain = "'^[A-Za-z0-9]+$'"
    return f"array_to_string(list_transform({w}, lambda x, i: case when i > 1 and regexp_matches(x, {plain}) and regexp_matches(({w})[i - 1], {plain}) then ' ' || x else x end), '')"


def title(c: str) -> str:
    s = squeeze(rep(trim(fill(c)), f"成果{tx.SPACE}*[:：]{tx.SPACE}*"))
    s = f"(case when length({s}) - length(replace({s}, '\"', '')) = 1 then replace({s}, '\"', '') else {s} end)"
    return spacing(s)


def business(c: str, depth: int = 24) -> str:
    """Brackets by as many rounds as no text here needs; the operator itself counts none."""
    s = rep(translate(without(fill(c), tx.BUSINESS_LITERALS), "#*&^$�", ""), r"[\r\n\t\x0b\x0c]")
    s = translate(s, tx.OPENING + tx.CLOSING, "（" * 6 + "）" * 6)
    s = reduce(lambda acc, _: rep(acc, "（[^（）]*）"), range(depth), s)
    s = trim(squeeze(rep(translate(s, "（）", ""), r"[，。,.!?；;:：]{2,}", "。")))
    s = rep(rep(s, f"^{tx.BUSINESS_HEAD}"), f"{tx.BUSINESS_TAIL}$")
    return f"(select case when b = '' then b else b || '。' end from (select {s} as b))"


def append(base: str, addition: str, sep: str = "") -> str:
    b, a = fill(base), fill(addition)
    return f"case when {a} = '' or contains({b}, {a}) then {b} when {b} = '' then {a} else {b} || {lit(sep)} || {a} end"


def profile(cols: dict[str, str]) -> str:
    v = {c: f"coalesce({x}, 'nan')" for c, x in cols.items()}
    kinds = f"concat_ws(' | ', {v['category']}, {v['category_big']}, {v['category_middle']})"
    return f"{v['org_name']} || '，成立于' || {v['establish_time']} || '，位于' || {v['address']} || '，是一家' || {v['company_org_type']} || '，规模为' || {v['scale']} || '企业。主营业务包括：' || {v['business']} || '。所属行业领域为：' || {kinds} || '。注册资金：' || {v['reg_capital']} || '。'"


def list_cell(c: str) -> str:
    """By counts of brackets and quotes before each comma, not by a running state."""
    before = lambda marks: f"len(list_filter(k[1:i], lambda y: y in ({marks})))"
    step = f"""case when x in ('[', ']', '"', '“', '”') then '' when x = ',' and {before("'['")} > {before("']'")} and {before("'\"', '“', '”'")} % 2 = 0 then '；' else x end"""
    listed = f"(select {trim(f"array_to_string(list_transform(k, lambda x, i: {step}), '')")} from (select regexp_extract_all({tags_out(c)}, {lit(r'[[]|[]]|["“”]|,|[^][\"“”,]+')}) as k))"
    return f"case when {is_blank(c)} then {c} when contains({c}, '[') and contains({c}, ']') then {listed} else {rep(tags_out(c), tx.LIST_SEPARATORS, '；')} end"


def renumbered(c: str) -> str:
    """By the number of marked lines up to each line, not by a running state."""
    lines = f"list_filter(list_transform(regexp_split_to_array({html(fill(c))}, '\\r\\n|\\r|\\n'), lambda x: {trim('x')}), lambda x: x <> '')"
    body = lambda x: translate(rep(x, tx.LINE_MARK), "\u3000\xa0", "")
    marked = lambda x: f"regexp_matches({x}, {lit(tx.LINE_MARK)})"
    gap = f"case when i = 1 or regexp_matches({body('k[i - 1]')}, {lit(tx.PAUSES)}) then '' else '；' end"
    part = f"case when {marked('x')} then len(list_filter(k[1:i], lambda y: {marked('y')})) || '.' || {body('x')} else {body('x')} end"
    joined = f"array_to_string(list_transform(k, lambda x, i: {gap} || {part}), '')"
    stop = f"case when s = '' or regexp_matches(s, '。{tx.SPACE}*$') then s else {rep('s', tx.SPACE + '+$')} || '。' end"
    return f"(select case when contains(t, ' ') then {stop} else t end from (select t, {spacing('t')} as s from (select {squeeze(joined)} as t from (select {lines} as k))))"


def scenario(c: str) -> str:
    pattern = lit(r'(?s)"title"\s*:\s*"(.*?)".*?"describe"\s*:\s*"(.*?)"')
    found = f"list_transform(regexp_extract_all({c}, {pattern}, 1), lambda x, i: {{'title': x, 'describe': regexp_extract_all({c}, {pattern}, 2)[i]}})"
    parsed = f"case when json_valid({c}) then case when {trim(c)}[1] = '{{' then from_json('[' || {c} || ']', '[{{\"title\":\"VARCHAR\",\"describe\":\"VARCHAR\"}}]') when {trim(c)}[1] = '[' then from_json({c}, '[{{\"title\":\"VARCHAR\",\"describe\":\"VARCHAR\"}}]') end end"
    tidy = lambda x: trim(translate(x, "\r\n\t\u3000\xa0", ""))
    texts = f"list_filter(list_transform(coalesce({parsed}, {found}), lambda x: coalesce(nullif({tidy('x.describe')}, ''), {tidy("coalesce(x.title, '')")})), lambda x: x <> '')"
    joined = f"array_to_string(list_transform(k, lambda x, i: i || '.' || {trim(rep('x', tx.INDEX_MARK))}), '')"
    return f"(select case when {is_blank(c)} then {c} when len(k) > 0 then {tags_out(joined)} else {tidy(tags_out(c))} end from (select {texts} as k))"


def need_content(c: str) -> str:
    """As tokens that look at their neighbours in the list, where a pattern would look around."""
    heads = ["(?s)（[一二三四五六七八九十]+）.", r"(?s)\p{Nd}+\.."]
    first = f"case when regexp_matches(x, {lit(heads[0])}) then x || '：' else x end"
    second = f"regexp_matches({first}, {lit(heads[1])})"
    headed = f"(select array_to_string(list_transform(p, lambda x, i: case when i = len(p) then x when {second} then ({first}) || '：' else ({first}) end), '<') from (select string_split({fill(c)}, '<') as p))"
    plain = f"case when regexp_matches({fill(c)}, '<[^>]+>') then {rep(rep(headed, '<[^>]+>'), tx.SPACE + '+')} else {fill(c)} end"
    tokens = lit(r"[\x{2460}-\x{24FF}]|（\p{Nd}+）|\p{Nd}+[.，,）)]?|" + tx.SPACE + r"+|（|[^\p{Nd}（\x{2460}-\x{24FF}" + tx.SPACE[1:-1] + "]+")
    follows = "regexp_matches(coalesce(k[i + 1], ''), '^[\\p{Nd}a-zA-Z\\x{2460}-\\x{24FF}]')"
    said = f"""case when regexp_full_match(x, '[\\x{{2460}}-\\x{{24FF}}]') then (unicode(x) - 9311)::VARCHAR || '、' when regexp_matches(x, {lit('^' + tx.SPACE)}) then ''
when x[1] = '（' and length(x) > 1 then x[2:-2] || '、' when regexp_full_match(x, '\\p{{Nd}}+\\.') and {follows} then x when regexp_full_match(x, '\\p{{Nd}}+[.，,）)]') then x[:-2] || '、' else x end"""
    flat = f"(select array_to_string(list_transform(k, lambda x, i: {said}), '') from (select regexp_extract_all(replace({plain}, '寻：', ''), {tokens}) as k))"
    # a semicolon before every digit from which an entry's number of two or more may be read
    entry = """case when regexp_full_match(x, '\\p{Nd}+、') then array_to_string(list_transform(range(1, length(x)), lambda j: case when regexp_full_match(x[j:], '([2-9]\\p{Nd}*|1\\p{Nd}+)、')
and (j > 1 or i = 1 or k[i - 1][-1] not in ('；', ';', '，', ',', '。', '！', '？', '、')) then '；' else '' end || x[j]), '') || '、' else x end"""
    parted = f"(select array_to_string(list_transform(k, lambda x, i: {entry}), '') from (select regexp_extract_all({flat}, '\\p{{Nd}}+、|[^\\p{{Nd}}]+|\\p{{Nd}}+') as k))"
    marks = r"，,；;。！？、:：\-—"
    led = f"(select case when regexp_matches(s, {lit(f'^[{marks}][^{marks}]')}) then s[2:] else s end from (select {parted} as s))"
    return f"(select case when s = '' then s else {rep('s', tx.NEED_STOPS)} || '。' end from (select {led} as s))"
