"""Building prompts, profiles and training records from matched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text as tx
from loomwright.session import cut, small, written_once


def group_set_concat(df: DataFrame, key: str, column: str, sep: str = ";", out_sep: str = "；") -> DataFrame:
    """(key, tags): the distinct trimmed entries of a key's lists, sorted by code point and joined.

    Entries are distinct before they meet in one array, so a hot key holds its vocabulary, not its rows.
    """
    parts = df.select(key, F.explode(F.split(F.col(column), sep)).alias("x")).select(key, tx.non_blank(F.col("x")).alias("tag")).where("tag is not null").distinct()
    return parts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("tag")), out_sep).alias("tags"))


def title_and_text(title: Column, text: Column) -> Column:
    """title：text, whichever exists, or ''."""
    return F.concat_ws("：", tx.non_blank(title), tx.non_blank(text))


def numbered_achievements(items: Column) -> Column:
    """成果1：title————text… of a sorted set of 'title：text'; parted at the first '：', else at the first ':', and trimmed."""

    def one(x: Column, i: Column) -> Column:
        mark = F.when(x.contains("："), "：").when(x.contains(":"), ":")
        at = F.instr(x, F.coalesce(mark, F.lit("：")))
        title = tx.blank_trim(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x))
        text = tx.blank_trim(F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise(""))
        both = F.concat_ws("————", F.nullif(title, F.lit("")), F.nullif(text, F.lit("")))
        return F.when(both == "", "").otherwise(F.concat(F.lit("成果"), (i + 1).cast("string"), F.lit("："), both))

    return F.array_join(F.transform(items, one), "")


def group_numbered(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, achievements): the distinct 'title：text' of a key, numbered in sorted order."""
    t = df.select(key, title_and_text(F.col(title), F.col(text)).alias("item")).where("item <> ''").distinct()
    return t.groupBy(key).agg(numbered_achievements(F.array_sort(F.collect_list("item"))).alias("achievements"))


def by_key(df: DataFrame, key: str, row: str) -> DataFrame:
    """df with the rows of a key in neighbouring partitions, a hot key in several: before long texts of the keys are attached.

    A task then holds the texts of few keys, and a columnar file writes each of them once, for which `attach` makes room.
    """
    spark = df.sparkSession
    return df.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key, row)


def attach(base: DataFrame, extra: DataFrame, key: str, column: str) -> DataFrame:
    """base with a column of extra, '' where the key is missing. The rows of base stay where they are if extra is small, as measured."""
    texts = written_once(cut(extra.select(key, column)), column)
    return base.join(small(texts), key, "left").withColumn(column, F.coalesce(column, F.lit("")))


def company_profile(df: DataFrame) -> Column:
    """A company in one paragraph; a missing value reads 'nan', as it always has in this text."""
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) if c in df.columns else F.lit("")
    kinds = F.concat_ws(" | ", v("category"), v("category_big"), v("category_middle"))
    parts = [v("org_name"), "，成立于", v("establish_time"), "，位于", v("address"), "，是一家", v("company_org_type"), "，规模为", v("scale"), "企业。主营业务包括：", v("business"), "。所属行业领域为：", kinds, "。注册资金：", v("reg_capital"), "。"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places as a Column."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            parts.append(tx.filled(values[piece].cast("string")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def sft_user(instruction: Column, inp: Column, joiner: str = "\n") -> Column:
    """The user turn: the instruction, and the input behind a joiner if there is one."""
    i = tx.filled(inp)
    return F.when(i == "", tx.filled(instruction)).otherwise(F.concat(tx.filled(instruction), F.lit(joiner), i))


def messages(system: Column, user: Column, answer: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), tx.filled(c).alias("content")) for r, c in (("system", system), ("user", user), ("assistant", answer))])


def preference_to_sft(df: DataFrame, system: str) -> DataFrame:
    """(instruction, input, output, system) of records whose chosen answer is not null."""
    return df.where("chosen is not null").select(*[tx.filled(F.col(c)).alias(a) for c, a in (("instruction", "instruction"), ("input", "input"), ("chosen", "output"))], F.lit(system).alias("system"))


def eval_rows(df: DataFrame) -> DataFrame:
    """(instruction, input, label, system) of records to evaluate: the output is the label, what is missing is ''."""
    return df.select(*[(tx.filled(F.col(c)) if c in df.columns else F.lit("")).alias(a) for c, a in (("instruction", "instruction"), ("input", "input"), ("output", "label"), ("system", "system"))])


def trainable(df: DataFrame, output: str = "output") -> DataFrame:
    """Records with an output that is not blank."""
    return df.where(~tx.is_blank(F.col(output)))


def both_present(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows with both of two gathered texts."""
    return df.where((tx.filled(F.col(first)) != "") & (tx.filled(F.col(second)) != ""))


def match_items(payload: Column) -> Column:
    """Array of the matches in a record's JSON text: under `matches`, under `match`, or the record itself; one match alone is an array of one."""
    inner = F.coalesce(F.get_json_object(payload, "$.matches"), F.get_json_object(payload, "$.match"), payload)
    return F.when(tx.blank_trim(inner).startswith("["), F.from_json(inner, "array<string>")).when(tx.is_blank(inner), F.array().cast("array<string>")).otherwise(F.array(inner))


def match_text(item: Column, entity: str, fields: list[str], sep: str = "：") -> Column:
    """The text of a match: the fields of its entity (an object, or a text), or the match itself if it is a text."""
    own = F.coalesce(F.get_json_object(item, f"$.{entity}"), item)
    parts = [tx.non_blank(F.get_json_object(own, f"$.{f}")) for f in fields]
    return F.when(tx.blank_trim(own).startswith("{"), F.concat_ws(sep, *parts)).otherwise(tx.filled(tx.non_blank(own)))


def preference_records(df: DataFrame, answer: str, first: str, second: str) -> DataFrame:
    """(instruction, input, chosen, rejected): a joint answer cut at its two labels."""
    chosen, rejected = tx.between_labels(F.col(answer), first, second)
    return df.select(tx.filled(F.col("instruction")).alias("instruction"), tx.filled(F.col("input")).alias("input"), chosen.alias("chosen"), rejected.alias("rejected"))


def masked_labels(ids: Column, prompt_len: Column, max_length: int, ignore: int = -100) -> tuple[Column, Column]:
    """(ids cut at max_length, labels): the prompt's labels are ignored."""
    cut = F.slice(ids, 1, max_length)
    return cut, F.transform(cut, lambda x, i: F.when(i < prompt_len, F.lit(ignore)).otherwise(x))


def pad_batches(df: DataFrame, key: str, ids: str, labels: str, batch: int, pad: int = 0, ignore: int = -100, drop_last: bool = False) -> DataFrame:
    """Rows padded to the longest of their batch (batches follow the key), with an attention mask; rows with no label left are dropped first.

    The batch number comes from with_row_position, so no task sorts the table.
    """
    from loomwright.operators.rows import with_row_position

    live = df.where(F.exists(F.col(labels), lambda x: x != ignore))
    b = with_row_position(live, key, "__pos").withColumn("batch", F.floor(F.col("__pos") / batch))
    w = Window.partitionBy("batch")
    b = b.withColumns({"__len": F.max(F.size(ids)).over(w), "__n": F.count("*").over(w)})
    if drop_last:
        b = b.where(F.col("__n") == batch)
    room = F.col("__len") - F.size(ids)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), room.cast("int")))
    return b.select(key, "batch", fill(F.col(ids), pad).alias("input_ids"), fill(F.transform(F.col(ids), lambda x: F.lit(1)), 0).alias("attention_mask"), fill(F.col(labels), ignore).alias("labels"))
