"""The language-model operators on small tables: brute force, exact round trips, nulls, ties, empty tables."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import canon, defects, encode, leaks, looks, names, oracle, pack, queries, quota, sentences
from loomwright.llm.components import classes

BPE = f"{encode.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


# -- encoding ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(library, s):
    assert encode.encode_texts([s], encode.encoder(BPE))[0] == library(s)


def test_encoding_of_the_corpus(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = encode.encode_corpus(docs.withColumn("ids", F.lit(1)).withColumn("k", F.lit(1))).collect()
    assert len(got) == len(text)
    assert all(list(r["ids"]) == (library(text[r["doc_id"]]) if text[r["doc_id"]] else []) for r in got)
    assert encode.encode_corpus(docs.limit(0)).count() == 0


def test_encoding_of_special_strings_and_null(spark, library):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, " \n"), (4, "x" * 50_000)], "doc_id int, text string")
    got = {(r[0], tuple(r[1])) for r in encode.encode_corpus(df).collect()}
    assert {(1, ()), (2, ()), (3, tuple(library("<|endoftext|>"))), (4, tuple(library(" \n")))} < got and len(got) == 5


# -- packing -----------------------------------------------------------------------------------------------------------
def _check_packing(rows, sizes, capacity):
    room, got = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
        if r["container_id"] is not None:
            room.setdefault(r["container_id"], []).append((r["container_offset"], r["token_end"] - r["token_start"]))
    for spans in room.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    for k, n in sizes.items():
        spans = sorted(got[k])
        assert spans[0][0] == 0 and spans[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or n > capacity
    return len(room)


def test_packing(spark):
    r = random.Random(1)
    sizes = {i: r.choice([0, None, 1, 7, r.randint(1, 100), r.randint(90, 350), 100]) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(9)
    rows = pack.pack(df, capacity=100, fan_in=2).collect()
    bins = _check_packing(rows, sizes, 100)
    assert bins <= 1.02 * sum(n or 0 for n in sizes.values()) / 100 + 1
    assert pack.pack(df.limit(0)).count() == 0
    tight = pack.pack(df, capacity=100, fan_in=2, carry=1).collect()
    _check_packing(tight, sizes, 100)


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, 60)] * 5 + [(2, 250)] * 2, "doc_id long, n_tokens long")
    rows = pack.pack(df, capacity=100).collect()
    assert sum(r["token_end"] - r["token_start"] for r in rows) == 800
    report = pack.packing_report(pack.pack(df, capacity=100), 100).first()
    assert report["tokens"] == 800 and report["largest_fill"] <= 100


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit(sizes):
    bins = pack.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert sum(sum(sizes[i] for i in b) <= 50 for b in bins) <= 1


# -- look-alike text ---------------------------------------------------------------------------------------------------
SAME = [("ＡＢＣ：１", "ABC:1"), ("café", "café"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("ΜΕS", "MES"), ("рlаnt", "plant"), ("⼟⽔", "土水"), ("ﬁt", "fit"), ("5G‑1", "5G-1"), ("料", "料")]
APART = [("m2", "m²"), ("1", "①"), ("CO2", "CO₂"), ("cafe", "café"), ("a b", "a  b"), ("Ab", "ab")]


def test_looks(spark):
    rows = [(i * 2 + k, x) for i, p in enumerate(SAME + APART) for k, x in enumerate(p)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("form", F.lit("old")).withColumn("c0", F.lit(7))
    got = {r["id"]: r["form"] for r in looks.same_look(df, "text").collect()}
    for i in range(len(SAME)):
        assert got[2 * i] == got[2 * i + 1], SAME[i]
    for i in range(len(SAME), len(SAME) + len(APART)):
        assert got[2 * i] != got[2 * i + 1], (SAME + APART)[i]
    assert got[900] is None and got[901] == ""
    assert looks.same_look(df.limit(0), "text").count() == 0


def test_look_alikes_of_further_scripts(spark):
    df = spark.createDataFrame([(1, "ᎪꓮA ﬓ ŉ ﬄ ﷲ"), (2, "Il1O0 ƨ"), (3, "σ 工 口 ー 一")], "id long, text string")
    got = {r["id"]: r["form"] for r in looks.same_look(df, "text").collect()}
    assert got[1].startswith("AAA մն ʼn".replace("ʼ", "’")) and got[1].split()[3:4] == ["ffl"] and "ﷲ" not in got[1]
    assert got[2].startswith("Il1O0") and got[3][2:] == "工 口 ー 一"


def test_look_alike_pairs_equal_brute_force(spark, folder):
    df = spark.read.parquet(f"{folder}/papers.parquet").select(F.lit("p").alias("g"), "row_idx", F.col("title").alias("text"))
    form = {r["row_idx"]: (r["text"], r["form"]) for r in looks.same_look(df, "text").collect()}
    want = {(a, b) for a in form for b in form if a < b and form[a][1] and form[a][1] == form[b][1] and form[a][0] != form[b][0] and min(len(form[a][0]), len(form[b][0])) > 1}
    assert {(r[1], r[2]) for r in looks.look_alike_pairs(df, ["g"], "row_idx").collect()} == want


def test_batches_of_whole_texts(spark, tmp_path):
    word = " market"
    rows = [(1, "Be brief.", "Name it", "a\nb", "Yes, it is."), (2, None, word * 1020, None, word * 30), (3, None, word * 1100, None, "lost"), (4, "", "Q", "", None), (5, "", "Q", "", "A"), (6, "", None, None, "B"), (7, "", "Q", "", "C C")]
    spark.createDataFrame(rows, "sft_id long, system string, instruction string, input string, output string").write.parquet(str(tmp_path / "sft.parquet"))
    enc = encode.encoder(BPE)
    want, live = {}, []
    for k, *parts in rows:
        system, ins, inp, out = [x or "" for x in parts]
        prompt = sum(encode.encode_texts([system, ins + (f"\n{inp}" if inp else "")], enc), [])
        ids = (prompt + encode.encode_texts([out], enc)[0])[:1024]
        labels = [-100 if i < len(prompt) else x for i, x in enumerate(ids)]
        if any(x != -100 for x in labels):
            live.append((k, ids, labels))
    for at in range(0, len(live), 4):
        n = max(len(ids) for _, ids, _ in live[at : at + 4])
        for k, ids, labels in live[at : at + 4]:
            room = n - len(ids)
            want[k] = (at // 4, ids + [0] * room, [1] * len(ids) + [0] * room, labels + [-100] * room)
    got = {r["sft_id"]: (r["batch"], r["input_ids"], r["attention_mask"], r["labels"]) for r in queries.build_batches_sft(spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {1, 2, 5, 6, 7} and len(got[2][1]) == 1024


# -- quotas ------------------------------------------------------------------------------------------------------------
def test_share_out():
    assert quota.share_out(10, [1, 1, 2], [9, 9, 9]) == [3, 2, 5]
    assert quota.share_out(10, [1.0, 1.0], [2, 20]) == [2, 8]
    assert quota.share_out(10, [1.0, 0.0], [3, 3]) == [3, 3]
    assert quota.share_out(0, [], []) == []
    assert quota.share_out(7, [0.0, 0.0], [9, 9]) == [4, 3]


def test_unmet_quota_goes_to_siblings_before_cousins():
    leaves = [(("x", "1"), 1), (("x", "2"), 9), (("y", "1"), 9), (("y", "2"), 9)]
    assert quota.descend(leaves, 12) == {("x", "1"): 1, ("x", "2"): 5, ("y", "1"): 3, ("y", "2"): 3}  # the sibling takes it
    leaves = [(("x", "1"), 1), (("x", "2"), 2), (("y", "1"), 9), (("y", "2"), 9)]
    assert quota.descend(leaves, 12) == {("x", "1"): 1, ("x", "2"): 2, ("y", "1"): 5, ("y", "2"): 4}  # siblings spent: the cousins do
    got = {c: (q, u) for c, _, _, q, u in quota.top_quotas([("a", 0.5, 1, 2), ("b", 0.3, 1, 50), ("c", 0.2, 1, 50)], 10)}
    assert got == {"a": (2, 3), "b": (5, 0), "c": (3, 0)}


def test_quota_sample(spark):
    rows = [(i, c, f"b{i % 3}") for i, c in enumerate(["a"] * 600 + [" b。"] * 200 + ["c"] * 3 + [None] * 50 + ["-"] * 47)]
    df = spark.createDataFrame(rows, "row_idx long, category string, big string").withColumn("target_share", F.lit(1))
    goal = spark.createDataFrame([("a", 0.4, 5), ("b", 0.4, 5), ("c", 0.2, 5), ("d", 0.0, 2)], "category string, target_share double, min_rows long")
    report = {r["category"]: r for r in quota.quota_report(df, goal, 0.2).collect()}
    assert {c for c, r in report.items() if r["shortfall"]} == {"c", "d"}
    got = quota.quota_sample(df, goal, "row_idx", 0.2, levels=["big"]).collect()
    assert len(got) == 180 == sum(r["quota"] for r in report.values())
    assert len({r["row_idx"] for r in got}) == 180
    again = quota.quota_sample(df.repartition(7), goal, "row_idx", 0.2, levels=["big"]).collect()
    assert {r["row_idx"] for r in got} == {r["row_idx"] for r in again}
    assert quota.quota_sample(df.limit(0), goal, "row_idx").count() == 0
    assert {r["category"] for r in quota.quota_report(df.limit(0), goal).where("shortfall > 0").collect()} == {"a", "b", "c", "d"}


# -- value mapping -----------------------------------------------------------------------------------------------------
ENTRIES = [(1, "JRTR", "JOURNAL OF RURAL TRANSPORT"), (2, "ISPA", "INTERNATIONAL SYMPOSIUM ON POLAR AGRONOMY"), (3, None, "TRANSACTIONS ON LATTICE INFORMATICS"), (4, "", "ARCHIVES OF URBAN SENSING AND PRACTICE")]


TYPED = [
    ("Jouranl of Rural Transport", 1), ("Rural Transport, Journal of", 1), ("JRTR'21", 1), ("J.R.T.R.", 1), ("In: JRTR 2020", 1), ("Proc. 3rd Int. Symp. on Polar Agron.", 2), ("Trans. Lattice Inform.", 3), ("arch urban sensing & pract", 4),
    ("Journal of Polar Agronomy", 0), ("International Conference on Polar Agronomy", 0), ("arXiv", 0), ("-", 0), ("内部资料", 0), ("JRTX", 0), ("Journal of Rural Transport (JRTR)", 1), ("Journal of Rural", 0),
]


def test_values_of_a_list(spark):
    e = spark.createDataFrame(ENTRIES, "ccf_id long, short_name string, full_name string")
    p = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TYPED)], "row_idx long, pub string")
    got = {r[0]: r[1] for r in canon.map_rows(p, "row_idx", "pub", e, "ccf_id", "full_name", "short_name").collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(TYPED)] == TYPED


def test_a_long_name_with_many_slips_is_mapped(spark):
    name = "INTERNATIONAL ARCHIVES OF COMPARATIVE HYDRODYNAMICS SEDIMENTATION CARTOGRAPHY VOLCANOLOGY CLIMATOLOGY OCEANOGRAPHY AND SEISMOLOGY"
    e = spark.createDataFrame([(1, None, name), (2, None, "ARCHIVES OF SEISMOLOGY")], "ccf_id long, short_name string, full_name string")
    typed = "Internatoinal Archvies Comparatvie Hydrodynmaics Sedimentatoin Cartogrpahy Volcanolgoy Climatolgoy Oceanogrpahy Seismolgoy"
    p = spark.createDataFrame([(1, typed), (2, typed.replace("Volcanolgoy", "Botany"))], "row_idx long, pub string")
    assert {r[0]: r[1] for r in canon.map_rows(p, "row_idx", "pub", e, "ccf_id", "full_name", "short_name").collect()} == {1: 1, 2: 0}


def test_candidates_hold_every_pair_that_passes(spark, folder):
    p, e = spark.read.parquet(f"{folder}/papers.parquet"), spark.read.parquet(f"{folder}/ccf_mapping.parquet")
    v = p.selectExpr("pub as value").where(r"value rlike '(?U)\\S'").distinct().withColumn("words", canon.words_column("value"))
    near, forms = canon.candidates(v, e, "ccf_id", "full_name", "short_name")
    got = {tuple(r) for r in near.collect()}
    fit = {
        (a.value, f.entry, f.form) for a in v.collect() for f in forms.collect()
        if canon.soft_cosine(list(a.words), list(f.meant), list(f.weights), list(f.short or []), f.form == "short", canon.HEAVIEST) >= canon.THRESHOLD
    }
    assert len(fit) > 100 and fit <= got and len(got) < 4 * v.count()


def test_map_rows(spark):
    e = spark.createDataFrame(ENTRIES, "ccf_id long, short_name string, full_name string")
    typed = ["Jouranl of Rural Transport", "JRTR 2020", "Trans. Lattice Inform.", "arXiv", None, "", " \n", "JRTR 2020"]
    p = spark.createDataFrame(list(enumerate(typed)), "row_idx long, pub string").withColumn("value", F.lit(1))
    got = {r[0]: r[1] for r in canon.map_rows(p, "row_idx", "pub", e, "ccf_id", "full_name", "short_name").collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 0, 7: 1}
    assert canon.map_rows(p.limit(0), "row_idx", "pub", e, "ccf_id", "full_name", "short_name").count() == 0
    assert {r[1] for r in canon.map_rows(p, "row_idx", "pub", e.limit(0), "ccf_id", "full_name", "short_name").collect()} == {0}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 4))
def test_banded_edits(a, b, most):
    def full(x, y):
        d = [[max(i, j) if not min(i, j) else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    assert canon.edits(a, b, most) == min(full(a, b), most + 1)


# -- copies across splits ----------------------------------------------------------------------------------------------
def test_copies_across_splits(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("阿波次德额夫哥何衣机克勒模恩") for _ in range(n))
    base = [(text(30), text(60), text(150)) for _ in range(30)]
    rows = [(i, *b, "train") for i, b in enumerate(base)]
    rows += [(100, *base[0], "val"), (101, base[1][0] + " ", base[1][1], base[1][2][:70] + "X" + base[1][2][70:], "test")]
    rows += [(102, base[2][0], base[2][1], text(150), "test"), (103, text(30), base[3][1], base[3][2][::-1], "val")]
    rows += [(104, None, None, None, "val"), (105, None, None, "", "train"), (106, *base[4], None), (107, *base[0], "train")]
    df = spark.createDataFrame(rows, "sft_id long, instruction string, input string, output string, split_name string").withColumn("key", F.lit(0))
    got = {(x[0], x[1]) for x in leaks.cross_split_copies(df, "sft_id", ["instruction", "input"], "output", "split_name").select("sft_id_a", "sft_id_b").collect()}
    assert got == {(0, 100), (100, 107), (1, 101)}
    assert leaks.cross_split_copies(df.limit(0), "sft_id", ["instruction", "input"], "output", "split_name").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_chunks_cover_the_text(s):
    assert sum(n for _, n in leaks.chunks(s)) == len(s)
    assert leaks.chunks(s) == leaks.chunks(s)


def test_copies_equal_brute_force(spark, folder):
    df = spark.read.parquet(f"{folder}/sft.parquet")
    p = df.toPandas()
    form = {x.sft_id: (leaks.one_form(f"{x.instruction or ''}\n{x.input or ''}"), leaks.one_form(x.output), x.split_name) for x in p.itertuples()}
    want = {tuple(sorted((a, b))) for a in form for b in form if form[a][2] == "train" != form[b][2] and "".join(form[a][:2]) and leaks.is_copy(*form[a][:2], *form[b][:2])}
    got = {(x[0], x[1]) for x in leaks.cross_split_copies(df, "sft_id", ["instruction", "input"], "output", "split_name").select("sft_id_a", "sft_id_b").collect()}
    assert got == want
    links = {}
    for a, b in want:
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    rows = leaks.copy_classes(df, "sft_id", ["instruction", "input"], "output", "split_name").collect()
    assert {r["sft_id"]: r["links"] for r in rows} == links and len(rows) == len(links)
    cls = {r["sft_id"]: r["class"] for r in rows}
    assert all(cls[a] == cls[b] <= min(a, b) for a, b in want)


def test_copies_among_many_alike_write_no_pairs(spark):
    """Records of few phrases all meet each other: what is shuffled stays a small part of the texts."""
    r = random.Random(8)
    phrases = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(12)) for _ in range(40)]
    text = lambda: "".join(r.sample(phrases, 12))
    rows = [(i, text(), text(), "train" if i % 4 else "val") for i in range(2000)]
    rows += [(5000, rows[1][1], rows[1][2], "test"), (5001, rows[2][1], rows[2][2][:70] + rows[2][2][71:], "val")]
    df = spark.createDataFrame(rows, "sft_id long, instruction string, output string, split_name string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        out, files = {}, disk.getAllFiles().iterator()
        while files.hasNext():
            f = files.next()
            out[f.getName()] = f.length() if f.getName().startswith("shuffle") else 0
        return out

    before = shuffled()
    got = {(x[0], x[1]) for x in leaks.cross_split_copies(df, "sft_id", ["instruction"], "output", "split_name").select("sft_id_a", "sft_id_b").collect()}
    assert got >= {(1, 5000), (2, 5001)}
    assert sum(n for f, n in shuffled().items() if f not in before) < 0.15 * sum(len((a + b).encode()) for _, a, b, _ in rows)


def test_overlaps_of_blocks_equal_brute_force(tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(9)
    words = ["".join(r.choice("阿波次德额夫哥何衣机克勒") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(r.choice(words) for _ in range(r.randrange(1, 16))) for _ in range(160)]
    texts = list(dict.fromkeys(texts + [t[:-3] + t[-2:] for t in texts if len(t) > 5]))
    sets = [Counter() for _ in texts]
    for t, c in zip(texts, sets):
        for d, n in leaks.chunks(t):
            c[d] += n
    owner, digest, n = leaks.chunk_sets(texts)
    assert all(dict(zip(digest[owner == i], n[owner == i])) == c for i, c in enumerate(sets))
    sides = range(0, len(texts), 3), [i for i in range(len(texts)) if i % 3]
    counters = np.zeros(1 << leaks.COUNTER_BITS, np.int32)
    for i in sides[1]:
        counters[leaks._buckets(np.array(list(sets[i]), np.int64))] += 1
    for at, part in enumerate((sides[0][:30], sides[0][30:])):
        own = [texts[i] for i in part]
        owner, digest, n = leaks.chunk_sets(own)
        times = counters[leaks._buckets(digest)]
        order, head = leaks.in_head(owner, digest, n, np.array([len(t) for t in own]), times, leaks.TAIL)
        order, head = order[times[order] > 0], head[times[order] > 0]
        by = [[k for k in order if owner[k] == i] for i in range(len(own))]
        heads = [int(head[owner[order] == i].sum()) for i in range(len(own))]
        pq.write_table(pa.table({"id": list(part), "size": [len(t) for t in own], "head": pa.array(heads, pa.int32()), "chunk": [digest[k].tolist() for k in by], "n": pa.array([n[k].tolist() for k in by], pa.list_(pa.int32()))}), tmp_path / f"{at}.parquet")
    files = tuple((tmp_path / f"{at}.parquet").as_uri() for at in (0, 1))
    want = {(i, j) for i in sides[0] for j in sides[1] if sum((sets[i] & sets[j]).values()) / max(len(texts[i]), len(texts[j])) >= leaks.OVERLAP}
    assert len(want) > 50
    for block, met in ((7, 20), (40_000, 2_000_000)):
        monkeypatch.setattr(leaks, "BLOCK", block)
        monkeypatch.setattr(leaks, "MET", met)
        found = leaks._overlapping(np.array(sides[1]), [texts[j] for j in sides[1]], files, counters, leaks.OVERLAP, leaks.TAIL)
        assert {(int(a), int(b)) for x, y in found for a, b in zip(x, y)} == want


def test_short_and_periodic_outputs():
    prompt = "请用一个短语说明该公司的主营方向并给出理由"
    assert leaks.is_copy(prompt, "高端温控阀门研发", prompt, "高端温控阀门研发商")
    assert not leaks.is_copy(prompt, "产能约十二月3日", prompt, "产能约十二月4日")
    assert not leaks.is_copy(prompt, "是", prompt, "否")
    text = "ab" * 5000
    assert sum(n for _, n in leaks.chunks(text)) == len(text)


# -- names -------------------------------------------------------------------------------------------------------------
def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1), (1, 2)]
    got = {r[0]: r[1] for r in classes(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_pigeonhole_finds_every_edit(spark):
    r = random.Random(5)
    pairs = []
    for i in range(4000):
        a = b = "".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(2, 9)))
        for _ in range(1 + i % 3):
            j = r.randrange(len(b) or 1)
            b = r.choice([b[:j] + b[j + 1 :], b[:j] + "己" + b[j + 1 :], b[:j] + "己" + b[j:], b[: max(j - 1, 0)] + b[max(j - 1, 0) : j + 1][::-1] + b[j + 1 :]]) or b
        pairs.append((i, a, b))
    df = spark.createDataFrame(pairs, "i int, a string, b2 string")
    sides = {s: df.select("i", F.col(c).alias("b")) for s, c in (("a", "a"), ("b", "b2"))}
    parts = lambda t, f, k: {(r["i"], r["l"], r["part"]) for r in f(t.withColumn("k", F.lit(k))).select("i", "l", "part").collect()}
    two = lambda t, e: {(r["i"], r["x"]) for r in t.select("i", F.explode(F.expr(e)).alias("x")).collect()}
    by: dict = {i: {"one": False, "two": False, "three": False} for i, _, _ in pairs}
    for way, k in (("one", 2), ("three", 3), ("two", 0)):
        own, seek = (({s: parts(t, names.found_by, k) for s, t in sides.items()}, {s: parts(t, names.looked_up, k) for s, t in sides.items()}) if k
                     else ({s: two(t, names.TWO_SEGMENTS) for s, t in sides.items()}, {s: two(t, names.TWO_SUBSTRINGS) for s, t in sides.items()}))
        for key in (own["a"] & seek["b"]) | (own["b"] & seek["a"]):
            by[key[0]][way] = True
    for i, a, b in pairs:
        d = names.edits(a, b, 9)
        lev = _levenshtein(a, b)
        if lev >= min(len(a), len(b)):  # no letter of the shorter one need be left
            continue
        assert d > 1 or by[i]["one"], (a, b)
        assert lev > 2 or by[i]["one"], (a, b)
        assert lev > 3 or by[i]["three"], (a, b)
        assert d > 1 or min(len(a), len(b)) < 4 or by[i]["two"], (a, b)
        assert a == b or not {a, b} & (names.short_forms(a, True) | names.short_forms(b, True)) or d > 2 or by[i]["one"]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distance_decides_every_link():
    def link(a, b, est=1, addr=1, cap=1, bare=(False, False)):
        return names.linked(a, b, True, *bare, "", "", a, b, est, addr, cap, 1)

    assert link("耀丰昊恒", "丰昊恒") and not link("耀丰昊恒", "耀甲乙丙") and not link("耀丰昊恒", "耀丰昊恒", addr=-1)
    assert link("电子科技", "晨曦电子科技", bare=(True, False)) and not link("电子科技", "晨曦山河松竹生物医药", bare=(True, False))


def test_links(spark):
    cols = ["row_idx", "org_name", "establish_time", "address", "reg_capital", "company_org_type"]
    home = "湖北省武汉市东湾区云帆路12号"
    rows = [
        (1, "武汉晨曦鼎力电子科技有限公司", "2001-02-03", home, "100万元", "其他有限责任公司"),
        (2, "晨曦鼎力（武汉）电子科技有限公司", "2001-02-03 00:00:00", "湖北武汉东湾区云帆路12号", "1000000", None),
        (3, "武汉晨曦丁力电子科技公司", "2001-02-03", None, "100万人民币", None),
        (4, "长沙晨曦鼎力食品有限公司", "2010-05-06", "湖南省长沙市白沙区拾光路9号", "500万元", None),
        (5, "Hezim Medical Devices Ltd.", "1999-09-09", "12 Mill Road, Velmont", "50", None),
        (6, "The H.Zim Medical Devices", "1999-09-09", "12 Mill Rd, Velmont", None, None),
        (7, None, "1999-09-09", home, None, None), (8, "", None, None, None, None), (9, "...", None, None, None, None),
    ]
    got = {r[0]: r[1] for r in names.link_names(spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'row_idx' else 'string'}" for c in cols)).withColumn("class", F.lit(0)), *cols).collect()}
    assert got[1] == got[2] == got[3] != got[4] and got[5] == got[6] and not {7, 8, 9} & set(got)
    empty = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'row_idx' else 'string'}" for c in cols)).limit(0)
    assert names.link_names(empty, *cols).count() == 0


def _linked(spark, rows):
    cols = ["row_idx", "org_name", "establish_time", "address", "reg_capital", "company_org_type"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'row_idx' else 'string'}" for c in cols))
    return {r[0]: r[1] for r in names.link_names(df, *cols).collect()}


def test_dates_and_addresses_of_very_many_lose_no_link(spark, monkeypatch):
    """What one date or address finds of few rows is found where very many have it: short brands with an edit, swaps, short forms with a slip."""
    pairs = [("普", "普耀"), ("旭曦", "旭珂"), ("甲乙丙", "乙甲丙"), ("甲乙丙", "甲丙乙"), ("永曦腾", "永曦"), ("abcdefghi", "abcdxfghi")]
    rows = []
    for i, (a, b) in enumerate(pairs):
        facts = (f"20{i:02d}-03-04", f"长桥路{i + 1}号", "100万" if i != 2 else None, None)
        rows += [(10 * i, a + "有限公司", *facts), (10 * i + 1, b + "有限公司", *(facts if i != 2 else (facts[0], None, None, None)))]
    df = spark.createDataFrame(rows, "k long, n string, e string, a string, c string, t string")
    link = lambda: {r[0]: r[1] for r in names.link_names(df, "k", "n", "e", "a", "c", "t").collect()}
    few = link()
    assert all(few[10 * i + 1] == 10 * i for i in range(len(pairs)))
    monkeypatch.setattr(names, "HOT", 0)
    assert link() == few


def test_a_hot_organisation_keeps_its_brand(spark):
    home, day, cap = "湖北省武汉市东湾区云帆路12号", "2001-02-03", "100万元"
    spelt = ["武汉晨曦鼎力电子科技有限公司", "晨曦鼎力（武汉）电子科技有限公司", "武汉晨曦鼎立电子科技公司", "武汉晨曦丁力电子科技公司", "武汉市晨曦鼎力电子科技集团"]
    known = [(day, home, cap), (day, home, None), (None, home, cap), (day, None, cap), (None, home, None), (day, None, None)]
    hot = [(n, *k) for n in spelt for k in known]
    own = "春夏秋冬山川河湖松竹梅兰红黄蓝白金银铜铁风雨雷电"
    rest = [(f"武汉{own[i]}{own[(i * 7 + 3) % 24]}{own[(i * 5 + 1) % 24]}电子科技有限公司", f"1990-01-{i + 1:02}", f"湖北省武汉市白沙区拾光路{i + 1}号", f"{i + 2}万元") for i in range(24)]
    got = _linked(spark, [(i, *r, None) for i, r in enumerate(hot + rest)])
    assert {got[i] for i in range(len(hot))} == {0} and len(set(got.values())) == 1 + len(rest)


def test_many_organisations_of_an_address_keep_their_brands(spark):
    """Eighty firms at each of ten addresses: a word in the name of one of each address's firms is a brand, as few firms have it."""
    r, day = random.Random(1), lambda i: str(date(1990, 1, 1) + timedelta(i))
    other = lambda n: "".join(chr(r.randrange(0x5000, 0x9000)) for _ in range(n))
    rows = [(i, ("晨曦" + other(2) if i < 9 else other(4)) + "有限公司", day(i), f"长桥路{i % 10 + 1}号", None, None) for i in range(800)]
    got = _linked(spark, [*rows, (800, "晨曦山河有限公司", day(800), "长桥路10号", None, None), (801, "晨曦山禾有限公司", day(800), None, None, None)])
    assert got == {i: min(i, 800) for i in range(802)}


def test_names_of_generic_words_meet(spark):
    own = "春夏秋冬山川河湖松竹梅兰红黄蓝白金银铜铁风雨雷电"
    rest = [(f"{own[i]}{own[(i * 7 + 3) % 24]}{own[(i * 5 + 1) % 24]}电子科技有限公司", f"1990-01-{i + 1:02}", f"白沙区拾光路{i + 1}号", f"{i + 2}万元") for i in range(24)]
    pairs = [
        (("电子科技公司", None, "东湾区云帆路1号", "77万元"), ("电子科技有限公司", None, "东湾区云帆路1号", None)),  # by address
        (("电子科技公司", None, "东湾区云帆路3号", "88万元"), ("电子科技公司", None, None, "88万元")),  # equal, by capital
        (("电子科技公司", "2003-03-03", "东湾区云帆路5号", None), ("晨曦电子科技公司", "2003-03-03", "东湾区云帆路5号", None)),  # against a brand
    ]
    rows = [r for p in pairs for r in p] + rest + [("电子科技公司", None, None, None)]
    got = _linked(spark, [(i, *r, None) for i, r in enumerate(rows)])
    assert [got[i] for i in range(6)] == [0, 0, 2, 2, 4, 4] and len(set(got.values())) == 3 + len(rest) + 1


def test_long_passages_stay_whole():
    said = "This is what was said. It isn’t short. " * 30
    for o, c in ("“”", "‘’", "「」", "()", '""'):
        for inner in (said, f"{said}(as noted) {said}"):
            text = f"He wrote: {o}{inner.strip()}{c} Then he left."
            assert sentences.protected(text) == [(10, text.rindex(c) + 1)]
    stray = f'A screen of 5" is small. {said}One of 7" is not.'
    assert not any(z - a > 400 for a, z in sentences.protected(stray))
    blank = f"An (opener. {said}\n\nIts closer) is in another paragraph."
    assert not any(z - a > 400 for a, z in sentences.protected(blank))


# -- defects -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("i", "n", "o", "want"), [
    ("请说明原理。", None, None, ["empty"]), ("请说明原理。", "", "答：", ["empty"]), ("x", "", "<p></p>", ["empty"]), ("x", "", "【方向一】", ["empty"]), ("只回答是或否。", "", "否", []),
    ("请说明原理。", "", "抱歉，我无法完成您的请求。", ["refusal"]), ("Explain it.", "", "I'm sorry, but I can't help with that.", ["refusal"]), ("Explain it.", "", "Sorry for the earlier mix-up; here is the corrected note. The pump works with 30 bar.", []),
    ("説明してください。", "", "申し訳ございませんが、お答えできません。", ["refusal"]), ("Beschreibe die Pumpe.", "", "Leider kann ich diese Frage nicht beantworten.", ["refusal"]),
    ("怎样降低自愈云母搅拌机的制造成本？", "", "怎样降低自愈云母搅拌机的制造成本？怎样降低自愈云母搅拌机的制造成本？", ["copied"]),
    ("请改正错别字。", "核心部件采采用多孔夹具。", "核心部件采用多孔夹具。", []), ("怎样降低成本？", "", "The pump improves yield by 5% over one season.", ["language"]),
    ("请把下面的内容译成英文：", "核心部件采用多孔夹具。", "The core part uses a porous clamp.", []), ("请说明原理。", "", "核心部件采用多孔夹具，流量由（未完", ["truncated"]), ("输出参数，格式为JSON。", "", '{"a": 1, "b"', ["truncated"]), ("输出参数，格式为JSON。", "", '{"a": 1}', []),
])
def test_rules(spark, i, n, o, want):
    df = spark.createDataFrame([(1, i, n, o)], "sft_id int, instruction string, input string, output string")
    got = defects.find_defects(df, "sft_id", "instruction", "input", "output").collect()
    assert (list(got[0]["defects"])[:1] if got else []) == want


def test_rules_know_no_lengths():
    assert defects.broken_off("说明（" + "该装置运行平稳" * 50)[0] is True
    assert defects.is_refusal("抱歉，我无法回答这个问题。" * 3 + "我不便提供相关信息。" * 4)
    assert not defects.is_refusal("抱歉，我无法回答这个问题。" + "水泵的工作压力为三十巴，寿命约十年。" * 6)
    assert defects.is_empty(f'<p class="{"x" * 400}"></p>')


@pytest.mark.parametrize("o", [
    "Désolé, je ne peux pas répondre à cette question.", "Lo siento, no puedo ayudar con eso.", "죄송하지만 답변을 제공할 수 없습니다.", "К сожалению, я не могу ответить на этот вопрос.", "Sinto muito, não posso responder.", "Mi dispiace, non posso rispondere.", "ขออภัย ไม่สามารถตอบคำถามนี้ได้",
])
def test_refusals_of_further_languages(o):
    assert defects.is_refusal(o)


def test_breaking_off_is_judged_by_the_corpus(spark):
    full = [(i, "请说明原理。", "", f"核心部件采用多孔夹具{i}，流量由自研算法控制。该成果适用于城市排水。") for i in range(60)]
    rows = [*full, (100, "请说明原理。", "", "该成果适用于城市排水。核心部件采用多孔夹具1，流量由自研算法控制"), (101, "请说明原理。", "", "该成果适用于城市排水。核心部件采用多孔夹具1，流量由自研算"), (102, "请说明原理。", "", "长" * 200_000 + "。")]
    df = spark.createDataFrame(rows, "sft_id int, instruction string, input string, output string")
    assert {r[0]: list(r[1]) for r in defects.find_defects(df, "sft_id", "instruction", "input", "output").collect()} == {101: ["truncated"]}
    assert defects.find_defects(df.limit(0), "sft_id", "instruction", "input", "output").count() == 0


# -- sentences ---------------------------------------------------------------------------------------------------------
CASES = [
    ["Dr. Muveji checked the furnace at 6.2 mm, i.e. below the limit.", "We coupled it."],
    ["“Is it ready? We doubt it,” said the auditor.", "The pump works."],
    ["他在会上说“先做小试，再谈产线。成本最重要。”，这一意见已被采纳。", "《白皮书。第4版》将于下月发布。"],
    ["技术路线为：1.研制网关；2.优化参数；3.开展3.9万小时验证。", "结束！！"],
    ["「止めるな！」", "本当に足りるのか？"],
    ["# 项目概况", "1. 第一条", "2. 第二条；"],
]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = sentences.word_statistics(docs)
    return stats, sentences.train(docs, stats)


@pytest.mark.parametrize("parts", CASES)
def test_boundaries(trained, parts):
    stats, model = trained
    text = ("\n" if parts[0].startswith("#") else " ").join(parts)
    assert [text[a:b] for a, b in sentences.split_text(text, model, stats)] == parts


@settings(max_examples=200, deadline=None)
@given(st.text("ab。.!? \n“”（）Dr1中文、;ไท", max_size=60))
def test_spans_cover_all_but_white_space(trained, s):
    stats, model = trained
    spans = sentences.split_text(s, model, stats)
    assert "".join("".join(s[a:b].split()) for a, b in spans) == "".join(s.split())
    assert all(a < b and s[a:b] == s[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_sentences_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "好。好。"), (4, "好。好。")], "doc_id long, text string").withColumn("k", F.lit(1))
    assert sorted(tuple(r) for r in sentences.sentence_spans(df).collect()) == [(4, 0, 2), (4, 0, 2), (4, 2, 4), (4, 2, 4)]
    assert sentences.sentence_spans(df.limit(0)).count() == 0


# -- queries -----------------------------------------------------------------------------------------------------------
def _rows(spark, folder, name):
    return [tuple(r) for r in queries.queries()[name](spark, folder).collect()]


def _table(spark, folder, name, *columns):
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()


def test_defects_of_records(spark, folder):
    ids = {r[0] for r in _table(spark, folder, "sft", "sft_id")}
    found, every = _rows(spark, folder, "p1_found"), _rows(spark, folder, "p1_defects")
    assert found and len({k for k, _ in found}) == len(found) and {k for k, _ in found} <= ids and set(found) <= set(every)
    order = {k: [d for x, d in every if x == k] for k, _ in found}
    assert all(d == min(order[k], key=defects.ORDER.index) for k, d in found)


def test_every_venue_is_mapped_or_reported(spark, folder):
    rows = {r["row_idx"]: r["pub"] for r in _table(spark, folder, "papers", "row_idx", "pub") if r["pub"] and r["pub"].strip()}
    found = _rows(spark, folder, "p3_found")
    assert sorted(k for k, _ in found) == sorted(rows)
    none = dict(_rows(spark, folder, "p3_unmatched"))
    assert {rows[k] for k, c in found if c == 0} == set(none) and sum(none.values()) == sum(c == 0 for _, c in found)


def test_copies_lie_on_both_sides(spark, folder):
    split = dict(map(tuple, _table(spark, folder, "sft", "sft_id", "split_name")))
    found = _rows(spark, folder, "p4_found")
    assert len(set(found)) == len(found) and all(a < b and (split[a] == "train") != (split[b] == "train") for a, b in found)
    copied = {x for p in found for x in p if split[x] != "train"}
    report = queries.p4_report(spark, folder).collect()
    assert sum(r["copied"] for r in report) == len(copied) and sum(r["records"] for r in report) == sum(s is not None and s != "train" for s in split.values())


def test_organisations_are_classes(spark, folder):
    cls = dict(_rows(spark, folder, "p5_classes"))
    by: dict = {}
    for k, c in cls.items():
        by.setdefault(c, []).append(k)
    assert all(min(ks) == c for c, ks in by.items())
    assert sorted(_rows(spark, folder, "p5_found")) == sorted((a, b) for ks in by.values() for a in ks for b in ks if a < b)


def test_forms_decide_the_pairs(spark, folder):
    form = {(r[0], r[1], r[2]): r[3] for r in _rows(spark, folder, "p7_forms")}
    found = _rows(spark, folder, "p7_found")
    assert found and all(a < b and form[t, f, a] == form[t, f, b] for t, f, a, b in found) and len(set(found)) == len(found)


def test_containers_hold_every_token(spark, folder):
    ids = dict(_rows(spark, folder, "p8_ids"))
    pieces = _rows(spark, folder, "p9_packed")
    spans: dict = {}
    for doc, _, _, a, z, _ in pieces:
        spans.setdefault(doc, []).append((a, z))
    assert set(spans) == set(ids)
    assert all(sorted(x)[0][0] == 0 and max(z for _, z in x) == len(ids[d]) and sum(z - a for a, z in x) == len(ids[d]) and (len(x) == 1 or len(ids[d]) > pack.CAPACITY) for d, x in spans.items())
    report = queries.p9_report(spark, folder).first()
    assert report["tokens"] == sum(map(len, ids.values())) and report["largest_fill"] <= pack.CAPACITY and report["least_containers"] <= report["containers"]


def test_sentences_cover_the_documents(spark, folder):
    text = dict(map(tuple, _table(spark, folder, "documents", "doc_id", "text")))
    by: dict = {}
    for d, a, z in _rows(spark, folder, "p10_found"):
        by.setdefault(d, []).append((a, z))
    for d, t in text.items():
        spans = sorted(by.get(d, []))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and all(t[a:z] == t[a:z].strip() != "" for a, z in spans)
        assert "".join("".join(t[a:z] for a, z in spans).split()) == "".join((t or "").split())


def test_batches_hold_whole_rows(spark, folder):
    rows = queries.build_batches_sft(spark, folder).collect()
    assert rows and all(len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) <= 1024 for r in rows)
    assert all(x in (-100, i) for r in rows for x, i in zip(r["labels"], r["input_ids"]))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_agrees_with_its_sql(spark, folder, name):
    from compare import connection, same

    assert same(queries.queries()[name](spark, folder), oracle.oracle_sql()[name], connection(folder)) == ""
