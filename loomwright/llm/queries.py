"""The queries of the language-model operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import canon, defects, encode, leaks, looks, names, pack, quota, sentences
from loomwright.operators import assemble as asm
from loomwright.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = defects.find_defects(table(spark, d, "sft"), "sft_id", "instruction", "input", "output")
    return found.select("sft_id", F.col("defects")[0].alias("defect"))


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect type of each record."""
    found = defects.find_defects(table(spark, d, "sft"), "sft_id", "instruction", "input", "output")
    return found.select("sft_id", F.explode("defects").alias("defect"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_rows(table(spark, d, "papers"), "row_idx", "pub", table(spark, d, "ccf_mapping"), "ccf_id", "full_name", "short_name")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct value the list has no entry for, with the number of its rows."""
    m = canon.map_values(table(spark, d, "papers"), "pub", table(spark, d, "ccf_mapping"), "ccf_id", "full_name", "short_name")
    return m.where("ccf_id is null").select("value", F.col("n").alias("n_rows"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return leaks.cross_split_copies(table(spark, d, "sft"), "sft_id", ["instruction", "input"], "output", "split_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).select("sft_id_a", "sft_id_b")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record found in train and in val or test, with its class and its number of copies on the other side."""
    return leaks.copy_classes(table(spark, d, "sft"), "sft_id", ["instruction", "input"], "output", "split_name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Records of each split and source, and how many of them occur in train."""
    return leaks.overlap_report(_copies(spark, d), table(spark, d, "sft"), "sft_id", "split_name", "source")


def _organisations(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "enterprises_full"), "row_idx", "org_name", "establish_time", "address", "reg_capital", "company_org_type")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.class_pairs(_organisations(spark, d), "row_idx")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row with its organisation."""
    return _organisations(spark, d)


_LEVELS = ["category_big", "category_middle"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    report = quota.quota_report(table(spark, d, "enterprises_full"), table(spark, d, "category_targets"), 0.2)
    return report.where("shortfall > 0").select("category")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample drawn: row and category."""
    got = quota.quota_sample(table(spark, d, "enterprises_full"), table(spark, d, "category_targets"), "row_idx", 0.2, "category", _LEVELS)
    return got.select("row_idx", quota.clean_category(F.col("category")).alias("category"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, available and drawn rows, and what could not be met, of each target category."""
    return quota.quota_report(table(spark, d, "enterprises_full"), table(spark, d, "category_targets"), 0.2)


def _looks(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("source_table"), F.lit(f).alias("field_name"), "row_idx", F.col(f).alias("text")) for t, f in looks.FIELDS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_alike_pairs(_looks(spark, d), ["source_table", "field_name"], "row_idx")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each text in its one form."""
    return looks.same_look(_looks(spark, d).where("text is not null"), "text").select("source_table", "field_name", "row_idx", "form")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def build_batches_sft(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts of sft as token ids, cut at 1,024, the prompt masked, padded in batches of 4.

    System, user turn and output are encoded each by itself; a row whose labels are all masked is dropped.
    """
    s = table(spark, d, "sft")
    user = asm.sft_user(F.col("instruction"), F.col("input"))
    s = s.select("sft_id", "output", F.coalesce("system", F.lit("")).alias("system"), user.alias("user"))
    ids = s.select(F.struct("sft_id", "user", "output").alias("k"), "system")
    ids = encode.encode_corpus(ids, "k", "system").select(F.struct("k.sft_id", "k.output", F.col("ids").alias("system")).alias("k"), "k.user")
    ids = encode.encode_corpus(ids, "k", "user").select(F.struct("k.sft_id", F.concat("k.system", "ids").alias("prompt")).alias("k"), "k.output")
    ids = encode.encode_corpus(ids, "k", "output").select("k.sft_id", F.concat("k.prompt", "ids").alias("ids"), F.size("k.prompt").alias("n"))
    short, labels = asm.masked_labels(F.col("ids"), F.col("n"), 1024)
    rows = cut(ids.select("sft_id", short.alias("i"), labels.alias("l")))  # read several times below, encoded once
    return asm.pad_batches(rows, "sft_id", "i", "l", 4)


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused room of the packing."""
    return pack.packing_report(pack.pack_documents(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_defects, p3_found, p3_unmatched, p4_found, p4_classes, p4_report, p5_found, p5_classes, p6_found, p6_sample, p6_report, p7_found, p7_forms, p8_ids, build_batches_sft, p9_packed, p9_report, p10_found]
    return {f.__name__: f for f in found}
