"""Hand-traced rows of the text rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import stateful
from loomwright.functions import text as tx
from loomwright.operators import assemble as asm
from loomwright.operators import stats as ss

GOLDEN = [
    ("words", "AI，机器/学习;云(x)+-", "AI 机器 学习 云 x +-"),
    ("words", "Café au lait", "Caf au lait"),
    ("duty", "教授, 博导（院士）", "教授；博导；院士"),
    ("application", '["a,b","c,d"]', "a,b;c,d"),
    ("application", "x，y , z", "x;y;z"),
    ("field", "1.算法，2、机器学习；（3）3D打印", "算法,机器学习,3D打印"),
    ("field", "①大数据 ; 5，云", "大数据,5,云"),
    ("business", "一般项目：软件开发（不含[许可(证)]）；；咨询", "软件开发。咨询。"),
    ("business", "", ""),
    ("need_title", "需求：寻求高效电机", "高效电机"),
    ("need_title", "千寻位置", "千位置"),
    ("title", '成果：新型 "电池', "新型电池"),
    ("title", 'a"b"c"d', 'a"b"c"d'),
    ("label", "A、B/C；", "A，B，C"),
    ("org_type", "有限责任公司(自然人独资)", "有限责任公司"),
    ("scale", " 2 ", "中型"),
    ("scale", "9", "9"),
    ("first_word", " 2020-01-02 00:00", "2020-01-02"),
    ("spacing", "基于 AI model 的平台", "基于AI model的平台"),
]
CLEANERS = {
    "words": tx.normalize_words, "duty": tx.normalize_duty, "application": tx.normalize_application_list, "field": tx.normalize_field_list, "business": tx.clean_business,
    "need_title": tx.need_title, "title": tx.standard_title, "label": tx.normalize_label, "org_type": tx.cut_bracket, "scale": lambda c: tx.map_codes(c, {"1": "小型", "2": "中型", "3": "大型"}), "first_word": tx.first_word, "spacing": tx.ascii_spacing,
}


def test_native_rules(spark):
    df = spark.createDataFrame([(i, n, x) for i, (n, x, _) in enumerate(GOLDEN)], "i int, n string, x string")
    got = df.select("i", *[f(F.col("x")).alias(n) for n, f in CLEANERS.items()]).orderBy("i").collect()
    assert [r[n] for r, (n, _, _) in zip(got, GOLDEN)] == [y for _, _, y in GOLDEN]


# Expected by hand from the rules, not from either implementation.
DESCRIBED = [
    ("need", "①轻量化②低成本", "1、轻量化；2、低成本。"), ("need", "12、测试", "1；2、测试。"), ("need", "<p>1.材料</p><p>轻</p>", "1、材料：轻。"), ("need", "成本1,000元", "成本1、000元。"), ("need", None, ""), ("need", "", ""),
    ("need", "（一）背景<br>1.5倍", "（一）背景：1.5倍。"), ("need", "要求 ； ", "要求。"), ("need", "，寻：电机！", "电机。"), ("need", "甲（3）乙4）丙", "甲；3、乙；4、丙。"), ("need", "版本1. ①", "版本1、1。"),
    ("renumbered", "<p>1.高效</p>\n<p>2.节能</p>", "1.高效；2.节能"), ("renumbered", "基于 AI model 的平台", "基于AI model的平台。"), ("renumbered", "3.5倍提升", "1.5倍提升"), ("renumbered", None, ""), ("renumbered", "  ", ""),
    ("renumbered", "背景：\n◆甲\n\n◆乙&nbsp;。\n说明", "背景：1.甲；2.乙。说明"), ("renumbered", "甲\r\n乙 丙", "甲；乙丙。"),
    ("list", '["a,b","c"]', "a,b；c"), ("list", "x,y/z", "x；y；z"), ("list", None, None), ("list", " ", " "), ("list", "[a,[b],c],d", "a；b；c,d"), ("list", "]a,b[c,d", "a,bc；d"), ("list", "<b>甲</b>、、乙", "甲；乙"),
    ("scenario", '[{"title":"生产","describe":"区域。\\n"},{"title":"技术","describe":""}]', "1.区域。2.技术"), ("scenario", "<p>x</p>", "x"), ("scenario", None, None), ("scenario", '{"title":"甲","describe":"（2）乙"}', "1.乙"),
    ("scenario", '{"title":"甲","describe":"乙"} {"title":"丙","describe":"丁"}', "1.乙2.丁"), ("scenario", '[{"title":null,"describe":null}]', '[{"title":null,"describe":null}]'), ("scenario", '[]', "[]"),
    ("business", "甲" + "（" * 9 + "乙" + "）" * 9 + "丙", "甲丙。"), ("business", "甲）乙（丙", "甲乙丙。"), ("business", "！", ""), ("business", "(一(二)三)甲；；", "甲。"),
]
DESCRIBERS = {"need": tx.need_content, "renumbered": tx.renumbered, "list": tx.list_cell, "scenario": tx.scenario_text, "business": tx.clean_business}


def test_described_rules(spark):
    df = spark.createDataFrame([(i, x) for i, (_, x, _) in enumerate(DESCRIBED)], "i int, x string")
    got = df.select("i", *[f(F.col("x")).alias(n) for n, f in DESCRIBERS.items()]).orderBy("i").collect()
    assert [(x, r[n]) for r, (n, x, _) in zip(got, DESCRIBED)] == [(x, y) for _, x, y in DESCRIBED]


def test_metrics_of_equal_and_disjoint_texts():
    assert stateful.bleu4("a b c d e", "a b c d e") == 100.0
    assert stateful.bleu4("a", "b") == 0.0 == stateful.bleu4(None, "b")
    assert stateful.rouge_l("a b c", "a x c") == pytest.approx(66.6667, abs=1e-3)


def test_assembly_rules(spark):
    df = spark.createDataFrame([(1, "a;b"), (1, "b; c"), (2, "a；b"), (3, None)], "k int, t string")
    assert {tuple(r) for r in asm.group_set_concat(df, "k", "t").collect()} == {(1, "a；b；c"), (2, "a；b")}
    df = spark.createDataFrame([(1, "B", "y"), (1, "A", "x"), (1, "A", "x")], "k int, a string, b string")
    assert asm.group_numbered(df, "k", "a", "b").first()[1] == "成果1：A————x成果2：B————y"
    a, b = tx.between_labels(F.col("x"), "【可采纳预测】", "【不可采纳预测】")
    assert tuple(spark.createDataFrame([("【可采纳预测】x【不可采纳预测】y",)], "x string").select(a, b).first()) == ("x", "y")
    s = ss.cost_estimate(spark.sql("select 1L n, 1000L sum_input, 1000L sum_output"), 0.002, 0.008).first()
    assert s["cost"] == 0.01
    row = spark.createDataFrame([("教授", "教授"), ("教授", "博导")], "a string, b string").select(tx.append_if_missing(F.col("a"), F.col("b"), ";")).collect()
    assert [r[0] for r in row] == ["教授", "教授;博导"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=40))
def test_described_rules_never_fail(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = df.select("x", *[f(F.col("x")).alias(n) for n, f in DESCRIBERS.items()]).collect()
    assert len(got) == len(texts) and all(r[n] is not None for r in got for n in DESCRIBERS)


def test_normalized_text_and_entities(spark):
    import html
    import unicodedata

    texts = ["ＡＩ，机器/学习;云（x）+-", "Ⅳ号①㎡ﬁ", None, "", "&amp;lt; &eacute;&#x4e2d;&nbsp; ", "&#38;", " \u3000", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = df.select("i", stateful.normalize_text(F.col("x")).alias("n"), stateful.nfkc(F.col("x")).alias("k"), stateful.html_unescape(F.col("x")).alias("u")).orderBy("i").collect()
    assert got[0]["n"] == "AI 机器 学习 云 x +-" and got[1]["n"] == "IV号1m2fi" and got[2]["n"] is None and got[3]["n"] == ""
    assert [r["k"] for r in got] == [x and unicodedata.normalize("NFKC", x) if x else x for x in texts]
    assert [r["u"] for r in got] == [None if x is None else html.unescape(x.strip()).strip() or None for x in texts]
