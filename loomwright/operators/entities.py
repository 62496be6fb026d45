"""The cleaning pipelines of the entity tables, composed of native filters and cleaners.

Columns outside `keep` never leave the scan; every step is a Column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import rows as ro
from loomwright.session import cut

# The columns that stay after cleaning, and codes of company size.
ENTERPRISE_COLUMNS = ["org_name", "business", "category", "category_big", "category_middle", "scale", "address", "reg_capital", "company_org_type", "establish_time"]
EXPERT_COLUMNS = ["user_name", "research_field", "application", "duty", "btype_name", "introduction"]
ACHIEVEMENT_COLUMNS = ["title", "analyse_contect"]
SCALES = {"1": "小型", "2": "中型", "3": "大型"}


def clean_enterprises(df: DataFrame, order: str = "row_idx", keep: list[str] | None = None) -> DataFrame:
    """First row of each name; fields cleaned; rows with a numeric category or an empty field dropped."""
    df = ro.rename_or_fill(df, "estiblish_time", "establish_time")
    cols = [c for c in (keep or ENTERPRISE_COLUMNS) if c in df.columns]
    d = ro.keep_first(df, ["org_name"], order).select(order, *[tx.filled(F.col(c).cast("string")).alias(c) for c in cols])
    fixes = {
        "scale": lambda c: tx.map_codes(c, SCALES),
        "establish_time": tx.first_word,
        "company_org_type": tx.cut_bracket,
        "business": tx.clean_business,
    }
    d = d.withColumns({c: tx.strip_edge_punct(fixes[c](F.col(c)) if c in fixes else F.col(c)) for c in cols})
    kinds = [c for c in ("category", "category_big", "category_middle") if c in cols]
    d = d.withColumns({c: tx.normalize_category(F.col(c)) for c in kinds})
    return ro.keep_filled(ro.drop_numeric(d, kinds), cols)


def clean_experts(df: DataFrame, order: str = "row_idx", keep: list[str] | None = None) -> DataFrame:
    """Rows with name, field, brief and introduction; lists in one form; title and college appended."""
    d = ro.ensure_columns(df, ["research_field", "professional_title", "duty", "college", "btype_name"])
    d = d.select(*[tx.filled(F.col(c).cast("string")).alias(c) if c != order else F.col(c) for c in d.columns])
    for c in ("user_name", "research_field", "brief_intr", "introduction"):
        if c in d.columns:
            d = d.where(~tx.is_blank(F.col(c)))
    d = d.where(~F.col("research_field").rlike("^[一-龥]$"))
    d = d.withColumns({
        "duty": tx.normalize_duty(tx.append_if_missing(F.col("duty"), F.col("professional_title"), ";")),
        "btype_name": tx.append_if_missing(F.col("btype_name"), F.col("college")),
        "application": tx.normalize_application_list(F.col("application")),
        "research_field": tx.normalize_field_list(F.col("research_field")),
    })
    return ro.select_available(d, [order, *(keep or EXPERT_COLUMNS)])


def clean_achievements(df: DataFrame, order: str = "row_idx", keep: list[str] | None = None, delete_titles: tuple[str, ...] = ()) -> DataFrame:
    """Descriptions renumbered and joined, titles in one form; first row of each title, then rows without a description dropped."""
    cols = [c for c in (keep or ACHIEVEMENT_COLUMNS) if c in df.columns]
    d = df.select(order, *[tx.filled(F.col(c).cast("string")).alias(c) for c in cols])
    fixes = {"analyse_contect": tx.renumbered, "application": tx.list_cell, "aplication_field_scenario": tx.scenario_text, "main_function": tx.plain_html, "main_advantage": tx.plain_html, "scene_lable": tx.normalize_label, "chain_lable": tx.normalize_label}
    for c in cols:
        if c in fixes:
            d = d.withColumn(c, fixes[c](F.col(c)))
    if "analyse_contect" in cols:
        d = d.where(tx.blank_trim(F.col("analyse_contect")) != "无")
        if "title" in cols:
            d = d.where(F.col("title") != F.col("analyse_contect"))
    if "title" in cols:
        d = d.withColumn("title", tx.standard_title(F.col("title")))
        if delete_titles:
            d = d.where(~F.col("title").isin(*delete_titles))
        d = ro.keep_first(cut(d), ["title"], order)  # written once, else every cleaner runs for the keys and for the rows
    return ro.keep_filled(d, ["analyse_contect"])


def clean_needs(df: DataFrame, order: str = "row_idx", required: tuple[str, ...] = ("title", "analyse_contect", "pub_dept")) -> DataFrame:
    """Demands: titles without their label, contents in one form; first row of each title, then blank rows dropped."""
    d = df.select(*[F.col(c) if c == order else tx.filled(F.col(c).cast("string")).alias(c) for c in df.columns])
    d = d.withColumn("title", tx.need_title(F.col("title"))).withColumn("application", F.replace(F.col("application"), F.lit("/"), F.lit(";"))).withColumn("analyse_contect", tx.need_content(F.col("analyse_contect")))
    d = ro.keep_first(d, ["title"], order).where(tx.blank_trim(F.col("title")) != "1")
    for c in required:
        if c in d.columns:
            d = d.where(~tx.is_blank(F.col(c)))
    return d
