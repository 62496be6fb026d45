"""The queries of the pipeline's own operators, each with the SQL that gives the same rows, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import encoders as enc
from loomwright.functions import stateful as st
from loomwright.functions import text as tx
from loomwright.functions import vectors as vx
from loomwright.operators import assemble as asm
from loomwright.operators import entities as ent
from loomwright.operators import matching as mt
from loomwright.operators import rows as ro
from loomwright.operators import sampling as sm
from loomwright.operators import stats as ss
from loomwright.operators import venues as vn
from loomwright.plans import sql as q
from loomwright.session import table
from loomwright.streaming.cleaning import windowed_counts

#: Vocabulary file and published pre-tokenisation pattern of the tokenizer whose tokens are counted.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def cell(name: str, source: str, key: str, column: str, cleaner: Callable, sql: Callable[[str], str] | None) -> None:
    """A cleaner over one column of a table: (key, value)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).select(key, cleaner(F.col(column)).alias("value"))

    QUERIES[name] = run
    if sql:
        SQL[name] = f"select {key}, {sql(column)} as value from {source}"


# -- cleaners of one column ------------------------------------------------------------------------------------------
ENT, EXP, ACH = ("enterprises_full", "row_idx"), ("experts_full", "row_idx"), ("achievements_full", "row_idx")
cell("text_words", "documents", "doc_id", "text", lambda c: F.md5(tx.normalize_words(c)), lambda c: f"md5({q.words(c)})")
cell("text_normalized", "papers", "row_idx", "title", st.normalize_text, None)
cell("text_strip_tags", *ACH, "main_function", tx.strip_tags, q.tags_out)
cell("text_plain_html", *ACH, "main_advantage", tx.plain_html, q.html)
cell("text_space_entities", *ACH, "main_advantage", tx.strip_space_entities, lambda c: q.rep(c, tx.SPACE_ENTITIES))
cell("text_unescape", *ACH, "main_advantage", tx.unescape_basic, lambda c: q.non_blank(f"replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"))
cell("text_unescape_full", *ACH, "main_advantage", st.html_unescape, None)
cell("text_nfkc", "papers", "row_idx", "title", st.nfkc, None)
cell("text_edge_punct", *ENT, "category", tx.strip_edge_punct, q.edge)
cell("text_org_type", *ENT, "company_org_type", tx.cut_bracket, q.cut_bracket)
cell("text_first_word", *ENT, "establish_time", tx.first_word, q.first_word)
cell("text_scale", *ENT, "scale", lambda c: tx.map_codes(c, ent.SCALES), q.scale)
cell("text_category", *ENT, "category", tx.normalize_category, q.category)
cell("text_business", *ENT, "business", tx.clean_business, q.business)
cell("text_duty", *EXP, "duty", tx.normalize_duty, q.duty)
cell("text_application_list", *EXP, "application", tx.normalize_application_list, q.application)
cell("text_field_list", *EXP, "research_field", tx.normalize_field_list, q.field)
cell("text_label", *ACH, "scene_lable", tx.normalize_label, q.label)
cell("text_separators", *ACH, "application", tx.collapse_separators, lambda c: q.rep(c, tx.LIST_SEPARATORS, "；"))
cell("text_title", *ACH, "title", tx.standard_title, q.title)
cell("text_ascii_spacing", "papers", "row_idx", "title", tx.ascii_spacing, q.spacing)
cell("text_need_title", *ACH, "title", tx.need_title, lambda c: q.without(c, tx.TITLE_LITERALS))
cell("text_upper_key", "papers", "row_idx", "pub", tx.upper_key, lambda c: f"upper({q.translate(q.trim(c), chr(13) + chr(10), '')})")
cell("text_full_width", *EXP, "application", tx.full_width_marks, lambda c: q.translate(c, ",;", "，；"))
cell("text_safe_name", "papers", "row_idx", "arxiv_id", tx.safe_name, lambda c: q.rep(c, "[^0-9A-Za-z]+", "_"))
cell("text_one_line", "papers", "row_idx", "abstract", lambda c: F.md5(F.translate(c, "\n", " ")), lambda c: f"md5(replace({c}, chr(10), ' '))")
cell("text_slash_list", *EXP, "application", lambda c: F.replace(c, F.lit("/"), F.lit(";")), lambda c: f"replace({c}, '/', ';')")
cell("text_list_cell", *ACH, "application", tx.list_cell, q.list_cell)
cell("text_renumbered", *ACH, "analyse_contect", tx.renumbered, q.renumbered)
cell("text_scenario", *ACH, "aplication_field_scenario", tx.scenario_text, q.scenario)
cell("text_need_content", *ACH, "analyse_contect", tx.need_content, q.need_content)


@query(f"select row_idx, {q.append('duty', 'professional_title', ';')} as duty, {q.append('btype_name', 'college')} as btype_name from experts_full")
def text_append(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experts_full").select("row_idx", tx.append_if_missing(F.col("duty"), F.col("professional_title"), ";").alias("duty"), tx.append_if_missing(F.col("btype_name"), F.col("college")).alias("btype_name"))


@query(f"select row_idx, concat_ws('；', {q.non_blank('title')}, {q.non_blank('scene_lable')}, {q.non_blank('application')}) as value from achievements_full")
def text_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "achievements_full").select("row_idx", tx.concat_non_blank([F.col("title"), F.col("scene_lable"), F.col("application")]).alias("value"))


@query(f"""select sft_id, md5({q.trim("case when contains(t, '【方向二】') then string_split(t, '【方向二】')[1] else t end")}) as chosen, md5({q.trim("case when contains(output, '【方向二】') then string_split(output, '【方向二】')[-1] else '' end")}) as rejected
from (select sft_id, output, case when contains(output, '【方向一】') then string_split(output, '【方向一】')[-1] else output end as t from sft)""")
def text_joint_answer(spark: SparkSession, d: str) -> DataFrame:
    a, b = tx.between_labels(F.col("output"), "【方向一】", "【方向二】")
    return table(spark, d, "sft").select("sft_id", F.md5(a).alias("chosen"), F.md5(b).alias("rejected"))


@query(r"""with j as (select row_idx, regexp_extract(regexp_replace(research_field, '```(?:json)?', '', 'g'), '(?s)\[.*\]') as x from experts_full)
select row_idx, unnest(from_json(x, '["VARCHAR"]')) as item from j where x <> '' and json_valid(x)""")
def text_json_list(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the cells that hold a JSON list."""
    return table(spark, d, "experts_full").select("row_idx", F.explode(tx.json_list(F.col("research_field"))).alias("item")).where("item is not null")


# -- rows ------------------------------------------------------------------------------------------------------------
@query("select row_idx, org_name from enterprises_full qualify row_number() over (partition by org_name order by row_idx) = 1")
def rows_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return ro.keep_first(table(spark, d, "enterprises_full"), ["org_name"], "row_idx").select("row_idx", "org_name")


@query(f"select row_idx from achievements_full where not {q.is_blank('title')} and {q.trim('title')} <> '-' and not {q.is_blank('application')} and {q.trim('application')} <> '-'")
def rows_keep_filled(spark: SparkSession, d: str) -> DataFrame:
    return ro.keep_filled(table(spark, d, "achievements_full"), ["title", "application"]).select("row_idx")


@query(f"select row_idx, category from enterprises_full where not coalesce(regexp_full_match({q.trim('category')}, '[0-9]+'), false)")
def rows_drop_numeric(spark: SparkSession, d: str) -> DataFrame:
    return ro.drop_numeric(table(spark, d, "enterprises_full"), ["category"]).select("row_idx", "category")


_STEPS = ["user_name", "research_field", "brief_intr", "introduction"]


@query(f"""with k as (select {', '.join(f'not {q.is_blank(c)} as k{i}' for i, c in enumerate(_STEPS))} from experts_full),
s as (select count(*) as s0, count(*) filter (k0) as s1, count(*) filter (k0 and k1) as s2, count(*) filter (k0 and k1 and k2) as s3, count(*) filter (k0 and k1 and k2 and k3) as s4 from k)
{' union all '.join(f"select {i} as step_no, '{c}' as step, s{i - 1} - s{i} as n_removed, s{i} as n_left from s" for i, c in enumerate(_STEPS, 1))}""")
def rows_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return ro.waterfall(table(spark, d, "experts_full"), [(c, ~tx.is_blank(F.col(c))) for c in _STEPS])


@query(f"select row_idx, case {q.rep(q.trim('scale'), '[.]0$')} when '1' then 'small' when '2' then 'middle' end as route from enterprises_full where {q.rep(q.trim('scale'), '[.]0$')} in ('1', '2')")
def rows_route(spark: SparkSession, d: str) -> DataFrame:
    return ro.route(table(spark, d, "enterprises_full"), "scale", {"1": "small", "2": "middle"}).select("row_idx", "route")


@query(f"select row_idx, case when {q.is_blank('pub')} then 'none' when pub = 'arXiv' then 'sole' else 'rest' end as part from papers")
def rows_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("row_idx", ro.partition_label(F.col("pub"), "arXiv").alias("part"))


@query("select o_orderkey, o_orderpriority from orders where year(o_orderdate) between 1993 and 1995")
def rows_year_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_custkey, o_totalprice, o_orderpriority, row_number() over (order by o_orderkey) - 1 as row_pos from orders")
def rows_position(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows numbered: what every match of the pipeline is keyed on."""
    return ro.with_row_position(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


@query("select e.row_idx as ask_order, d.doc_id, d.doc_type from enterprises_full e join documents d on d.doc_id = length(e.org_name) % 97")
def rows_positional_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "enterprises_full").select("row_idx", (F.length("org_name") % 97).cast("long").alias("k"))
    return ro.positional_lookup(keys, "k", "row_idx", table(spark, d, "documents").select("doc_id", "doc_type"), "doc_id")


@query("select row_idx, arxiv_id from papers where arxiv_id in (select arxiv_id from papers where citations > 100) qualify row_number() over (partition by arxiv_id order by row_idx) = 1")
def rows_semi_first(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return ro.semi_first(p, "arxiv_id", "row_idx", p.where("citations > 100")).select("row_idx", "arxiv_id")


@query("select arxiv_id as key, arg_max(citations, row_idx) filter (citations is not null) as value from papers where arxiv_id is not null group by 1 having arg_max(citations, row_idx) filter (citations is not null) is not null")
def rows_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ro.last_wins(table(spark, d, "papers").where("citations is not null"), F.col("arxiv_id"), "citations", "row_idx")


@query("select row_idx, title from achievements_full where title <> '1' and not regexp_full_match(title, '[一-龥]') and title <> coalesce(analyse_contect, '')")
def rows_literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "achievements_full").where((F.col("title") != "1") & ~F.col("title").rlike("^[一-龥]$") & (F.col("title") != tx.filled(F.col("analyse_contect")))).select("row_idx", "title")


@query("select title from achievements_full where title is not null except select title from papers")
def rows_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "achievements_full").select("title").where("title is not null").distinct(), table(spark, d, "papers").select("title")
    return a.join(b, "title", "left_anti")


@query("select distinct c_custkey as custkey from customer where c_custkey in (select o_custkey from orders)")
def rows_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("select user_name as name from experts_full where user_name is not null union select org_name from enterprises_full where org_name is not null")
def rows_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experts_full").select(F.col("user_name").alias("name")).union(table(spark, d, "enterprises_full").select("org_name")).where("name is not null").distinct()


@query("select text from documents where length(text) >= 5 group by text")
def rows_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") >= 5).select("text").distinct()


@query("select tag from (select trim(unnest(string_split(application, ';'))) as tag from experts_full) where length(tag) > 1 and not regexp_full_match(tag, '[0-9]+') group by tag")
def rows_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "experts_full").select(F.explode(F.split("application", ";")).alias("x")).select(F.trim("x").alias("tag"))
    return t.where((F.length("tag") > 1) & ~F.col("tag").rlike(r"^[0-9]+\z")).distinct()


@query(f"select row_idx, case when {q.is_blank('category')} then category_big else category end as category, '' as note from enterprises_full")
def rows_columns(spark: SparkSession, d: str) -> DataFrame:
    e = ro.rename_or_fill(table(spark, d, "enterprises_full"), "category_big", "category")
    return ro.select_available(ro.ensure_columns(ro.drop_columns(e, ["business", "absent"]), ["note"]), ["row_idx", "category", "note", "business"])


@query("select doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+|[一-鿿]+'), lambda x: length(x) > 1), ' ')) as terms from documents")
def text_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat_ws(" ", enc.terms(F.col("text")))).alias("terms"))


@query("select user_id, count(*) as n_lines, count(*) filter (value > 50) as n_hit, bool_or(value > 50) as any_hit from events group by 1")
def stats_presence_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a match, and whether the key has any."""
    hit = F.col("value") > 50
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("n_hit"), F.bool_or(hit).alias("any_hit"))


@query("select row_idx, case when pub = 'arXiv e-prints' then 'arXiv' else pub end as pub from papers")
def rows_replaced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("row_idx", tx.replace_value(F.col("pub"), "arXiv e-prints", "arXiv").alias("pub"))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 500")
def rows_first(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in input order: a limit is what is asked for."""
    return ro.first_rows(table(spark, d, "orders"), "o_orderkey", 500).select("o_orderkey", "o_totalprice")


@query("select row_idx, page from papers cross join (select unnest([1, 2]) as page) where (contains(lower(coalesce(title, '')), 'system') or contains(lower(coalesce(abstract, '')), 'system')) and year(submitted_at) between 2015 and 2030")
def rows_search(spark: SparkSession, d: str) -> DataFrame:
    return vn.search(table(spark, d, "papers"), "system", ["title", "abstract"], F.year("submitted_at"), 2015, 2030, 2).select("row_idx", "page")


# -- counts and summaries --------------------------------------------------------------------------------------------
@query(" union all ".join(f"select '{c}' as column_name, {c} as label, count(*) as n from enterprises_full where {c} is not null group by {c}" for c in ("category", "scale", "category_big")))
def stats_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return ss.value_counts(table(spark, d, "enterprises_full"), ["category", "scale", "category_big"])


@query(" union all ".join(f"select '{c}' as column_name, count(*) filter (not {q.is_blank(c)}) as n from experts_full" for c in ("research_field", "application", "duty", "college")))
def stats_filled(spark: SparkSession, d: str) -> DataFrame:
    return ss.filled_counts(table(spark, d, "experts_full"), ["research_field", "application", "duty", "college"])


@query(f"select tag, count(*) as n from (select {q.trim('x')} as tag from (select unnest(case when contains(application, ';') then string_split(application, ';') when contains(application, '；') then string_split(application, '；') else [application] end) as x from experts_full where application is not null)) where tag <> '' group by tag")
def stats_tags(spark: SparkSession, d: str) -> DataFrame:
    return ss.tag_counts(table(spark, d, "experts_full"), "application")


@query(f"select distinct {q.trim('x')} as tag from (select unnest(regexp_split_to_array(application, '[;；]+')) as x from experts_full) where {q.trim('x')} <> ''")
def stats_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ss.vocabulary(table(spark, d, "experts_full"), "application")


@query("with c as (select category as l, count(*) as n, row_number() over (order by count(*) desc, category) as r from enterprises_full where category is not null group by 1), m as (select case when r <= 5 then l else '其他' end as label, sum(n)::BIGINT as n from c group by 1) select label, n, round(n / sum(n) over (), 6) as share from m")
def stats_top_other(spark: SparkSession, d: str) -> DataFrame:
    return ss.top_and_other(table(spark, d, "enterprises_full"), "category")


_PAIRS = "select q.vec_id, t.vec_id as match_id, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) as s from embeddings q join embeddings t on q.vec_id <> t.vec_id where q.vec_id % 50 = 0"
_NEAR = f"select vec_id, match_id, s, row_number() over (partition by vec_id order by s desc, match_id) as rank from ({_PAIRS}) where s >= 0.3 qualify rank <= 3"


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0")
    return queries, mt.cosine_candidates(queries, e, "vec_id", "vec_id", "embedding", 3, 0.3)


@query(f"with p as (select vec_id, count(*) filter (s > 0.35) as h, count(*) filter (s > 0.3) as l, count(*) as p from ({_NEAR}) group by 1) select count(*) as n_queries, coalesce(sum(p), 0)::BIGINT as n_pairs, coalesce(sum(h), 0)::BIGINT as n_high, coalesce(sum(l), 0)::BIGINT as n_low, count(*) filter (h > 0) as q_high, count(*) filter (l > 0) as q_low, round(case when count(*) > 0 then count(*) filter (h > 0) / count(*) * 100 else 0.0 end, 4) as pct_high, round(case when count(*) > 0 then count(*) filter (l > 0) / count(*) * 100 else 0.0 end, 4) as pct_low from p")
def stats_match_scores(spark: SparkSession, d: str) -> DataFrame:
    return ss.match_score_stats(_near(spark, d)[1], "vec_id", "score", 0.35, 0.3)


@query("select count(*) filter (a is not null and b is not null) as n_both, count(*) filter (b is null) as n_left_only, count(*) filter (a is null) as n_right_only, count(*) as n_any from (select distinct c_custkey as a from customer) full join (select distinct o_custkey as b from orders) on a = b")
def stats_presence(spark: SparkSession, d: str) -> DataFrame:
    return ss.presence(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


_TOK = lambda c: f"coalesce(len(regexp_extract_all({c}, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')), 0)"
_TOKENS = f"select {_TOK('instruction')} + {_TOK('input')} as i, {_TOK('output')} as o from sft"
_TOKEN_STATS = f"select count(*) as n, coalesce(sum(i), 0)::BIGINT as sum_input, coalesce(min(i), 0)::BIGINT as min_input, coalesce(max(i), 0)::BIGINT as max_input, coalesce(sum(o), 0)::BIGINT as sum_output, coalesce(min(o), 0)::BIGINT as min_output, coalesce(max(o), 0)::BIGINT as max_output, coalesce(sum(i + o), 0)::BIGINT as sum_total, coalesce(min(i + o), 0)::BIGINT as min_total, coalesce(max(i + o), 0)::BIGINT as max_total from ({_TOKENS})"


def _token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sft").select((ss.simple_tokens(F.col("instruction")) + ss.simple_tokens(F.col("input"))).alias("i"), ss.simple_tokens(F.col("output")).alias("o"))
    return ss.token_stats(t, "i", "o")


@query(_TOKEN_STATS)
def stats_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _token_stats(spark, d)


@query(f"with s as ({_TOKEN_STATS}) select n, round(sum_input / 1000 * 0.002::DOUBLE + sum_output / 1000 * 0.008::DOUBLE, 6) as cost, round(case when n > 0 then (sum_input / 1000 * 0.002::DOUBLE + sum_output / 1000 * 0.008::DOUBLE) / n else 0.0 end, 9) as cost_per_record from s")
def stats_cost(spark: SparkSession, d: str) -> DataFrame:
    return ss.cost_estimate(_token_stats(spark, d), 0.002, 0.008)


@query("select l_returnflag, round(avg(m), 6) as mean_of_means from (select l_returnflag, l_linenumber, avg(l_quantity) as m from lineitem group by 1, 2) group by 1")
def stats_batch_means(spark: SparkSession, d: str) -> DataFrame:
    return ss.group_means(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity")


@query("select event_type, count(*) as n, round(avg((value < 50)::INT), 6) as rate, round(avg(value), 6) as avg_score, round(avg(user_id), 6) as avg_queries from events group by 1")
def stats_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return ss.success_rate(table(spark, d, "events"), "event_type", "value", 50, "user_id")


@query("with a as (select l_returnflag as k, avg(l_discount) as v from lineitem group by 1), b as (select l_linestatus as k, avg(l_discount) as v from lineitem group by 1) select coalesce(a.k, b.k) as k, round(coalesce(a.v, 0.0), 6) as pre, round(coalesce(b.v, 0.0), 6) as post, round(coalesce(b.v, 0.0) - coalesce(a.v, 0.0), 6) as delta from a full join b on a.k = b.k")
def stats_deltas(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = (li.groupBy(F.col(c).alias("k")).agg(F.avg("l_discount").alias("v")) for c in ("l_returnflag", "l_linestatus"))
    return ss.deltas(a, b, "k", "v").withColumns({c: F.round(c, 6) for c in ("pre", "post")})


@query("select event_id, min(value) over w as best_before, coalesce(value < min(value) over w, true) as is_best from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)")
def stats_running_best(spark: SparkSession, d: str) -> DataFrame:
    b = ss.running_best(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return b.select("event_id", "best_before", F.coalesce("is_best", F.lit(True)).alias("is_best"))


@query("select user_id, round(list_reduce(list(value order by event_id), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x), 6) as ema from events where value is not null group by 1")
def stats_ema(spark: SparkSession, d: str) -> DataFrame:
    return ss.ema_by_key(table(spark, d, "events"), "user_id", "event_id", "value", 0.9).select("user_id", F.round("ema", 6).alias("ema"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events").where("ts is not null"), "ts", "event_type", "value").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# -- assembly --------------------------------------------------------------------------------------------------------
@query(f"select row_idx, {q.profile({c: c for c in ent.ENTERPRISE_COLUMNS})} as company_info from enterprises_full")
def build_profiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enterprises_full")
    return e.select("row_idx", asm.company_profile(e).alias("company_info"))


_SETS = f"select btype_name, string_agg(tag, '；' order by tag) as tags from (select distinct btype_name, {q.trim('x')} as tag from (select btype_name, unnest(string_split(application, ';')) as x from experts_full where btype_name is not null)) where tag <> '' group by 1"


@query(_SETS)
def build_group_sets(spark: SparkSession, d: str) -> DataFrame:
    return asm.group_set_concat(table(spark, d, "experts_full").where("btype_name is not null"), "btype_name", "application")


@query(f"with s as ({_SETS}) select row_idx, coalesce(tags, '') as tags from experts_full left join s using (btype_name)")
def build_attached(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "experts_full")
    rows = asm.by_key(e.select("row_idx", "btype_name"), "btype_name", "row_idx")
    return asm.attach(rows, asm.group_set_concat(e.where("btype_name is not null"), "btype_name", "application"), "btype_name", "tags").select("row_idx", "tags")


@query(f"with t as (select distinct lower(left(arxiv_id, 4)) as k, concat_ws('：', {q.non_blank('title')}, {q.non_blank('journal_level')}) as item from papers where arxiv_id is not null), m as (select k, item, row_number() over (partition by k order by item) as i, case when contains(item, '：') then strpos(item, '：') else strpos(item, ':') end as mark from t where item <> ''), n as (select k, i, concat_ws('————', nullif({q.trim("case when mark > 0 then left(item, mark - 1) else item end")}, ''), nullif({q.trim("case when mark > 0 then substr(item, mark + 1) else '' end")}, '')) as body from m) select k, md5(string_agg(case when body = '' then '' else '成果' || i || '：' || body end, '' order by i)) as achievements from n group by k")
def build_numbered(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("arxiv_id is not null").withColumn("k", F.lower(F.substring("arxiv_id", 1, 4)))
    return asm.group_numbered(p, "k", "title", "journal_level").select("k", F.md5("achievements").alias("achievements"))


@query("select sft_id, coalesce(instruction, '') || case when coalesce(input, '') = '' then '' else chr(10) || input end as train_user, coalesce(instruction, '') || case when coalesce(input, '') = '' then '' else chr(10) || chr(10) || '输入：' || chr(10) || input end as eval_user from sft")
def build_user_turns(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("instruction"), F.col("input")
    return table(spark, d, "sft").select("sft_id", asm.sft_user(i, n).alias("train_user"), asm.sft_user(i, n, "\n\n输入：\n").alias("eval_user"))


@query("select sft_id, 1 + unnest([0, 1, 2]) as turn, unnest(['system', 'user', 'assistant']) as role, unnest([coalesce(system, ''), coalesce(instruction, '') || case when coalesce(input, '') = '' then '' else chr(10) || input end, coalesce(output, '')]) as content from sft")
def build_messages(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sft")
    m = asm.messages(F.col("system"), asm.sft_user(F.col("instruction"), F.col("input")), F.col("output"))
    return s.select("sft_id", F.posexplode(m).alias("turn", "m")).select("sft_id", (F.col("turn") + 1).alias("turn"), "m.role", "m.content")


@query("select coalesce(instruction, '') as instruction, coalesce(input, '') as input, output, 'You advise companies.' as system from sft where output is not null")
def build_sft(spark: SparkSession, d: str) -> DataFrame:
    return asm.preference_to_sft(table(spark, d, "sft").drop("system").withColumnRenamed("output", "chosen"), "You advise companies.")


@query("select sft_id, '任务：' || coalesce(instruction, '') || '材料：' || coalesce(input, '') || '。' as prompt from sft")
def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("sft_id", asm.fill_template("任务：{instruction}材料：{input}。", {"instruction": F.col("instruction"), "input": F.col("input")}).alias("prompt"))


@query("""with t as (select vec_id, label as p, list_transform(embedding[1:32], lambda x: round(x::DOUBLE * 1000)::INT) as ids from embeddings),
m as (select vec_id, ids[1:24 + p] as ids, list_transform(ids[1:24 + p], lambda x, i: case when i <= p * 3 then -100 else x end) as labels from t),
b as (select *, (row_number() over (order by vec_id) - 1) // 4 as batch from m where len(list_filter(labels, lambda x: x <> -100)) > 0),
w as (select *, max(len(ids)) over (partition by batch) as n from b)
select vec_id, batch, array_to_string(list_resize(ids, n, 0), ' ') as input_ids, array_to_string(list_resize(list_transform(ids, lambda x: 1), n, 0), ' ') as attention_mask, array_to_string(list_resize(labels, n, -100), ' ') as labels from w""")
def build_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("p"), F.transform(F.slice("embedding", 1, 32), lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("ids"))
    t = t.withColumn("ids", F.slice("ids", 1, 24 + F.col("p")))
    ids, labels = asm.masked_labels(F.col("ids"), F.col("p") * 3, 64)
    out = asm.pad_batches(t.select("vec_id", ids.alias("i"), labels.alias("l")), "vec_id", "i", "l", 4)
    return out.select("vec_id", "batch", *[F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("select coalesce(instruction, '') as instruction, coalesce(input, '') as input, coalesce(output, '') as label, coalesce(system, '') as system from sft")
def build_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return asm.eval_rows(table(spark, d, "sft"))


@query(f"select sft_id from sft where not {q.is_blank('output')}")
def build_trainable(spark: SparkSession, d: str) -> DataFrame:
    return asm.trainable(table(spark, d, "sft")).select("sft_id")


@query(f"with s as ({_SETS}), n as (select btype_name, count(*)::VARCHAR as people from experts_full where btype_name is not null and college is not null group by 1) select row_idx, tags, people from experts_full join s using (btype_name) join n using (btype_name) where tags <> ''")
def build_both_present(spark: SparkSession, d: str) -> DataFrame:
    """Experts of types with both gathered tags and people of a college."""
    e = table(spark, d, "experts_full").where("btype_name is not null")
    people = e.where("college is not null").groupBy("btype_name").agg(F.count("*").cast("string").alias("people"))
    rows = asm.by_key(e.select("row_idx", "btype_name"), "btype_name", "row_idx")
    both = asm.attach(asm.attach(rows, people, "btype_name", "people"), asm.group_set_concat(e, "btype_name", "application"), "btype_name", "tags")
    return asm.both_present(both, "tags", "people").select("row_idx", "tags", "people")


# -- sampling --------------------------------------------------------------------------------------------------------
_ALLOC = """select source, n, case when total <= goal then n when sum_a > goal then a - greatest(0, least(a - 1, sum_a - goal - coalesce(sum(a - 1) over (order by a desc, source rows between unbounded preceding and 1 preceding), 0)))
 else a + greatest(0, least(n - a, goal - sum_a - coalesce(sum(n - a) over (order by n - a desc, source rows between unbounded preceding and 1 preceding), 0))) end::BIGINT as quota
from (select *, sum(a) over () as sum_a from (select *, least(n, greatest(1, round_even(n / total * goal, 0)))::BIGINT as a from (select *, greatest(1, round_even(total * 0.05::DOUBLE, 0), k)::BIGINT as goal
from (select source, count(*) as n, sum(count(*)) over () as total, count(*) over () as k from documents where source is not null group by 1))))"""


@query(_ALLOC)
def sample_allocation(spark: SparkSession, d: str) -> DataFrame:
    return sm.allocate(table(spark, d, "documents"), "source", 0.05)


@query(f"with a as ({_ALLOC}), r as (select doc_id, source, row_number() over (partition by source order by md5(doc_id::VARCHAR || '42'), doc_id) as r from documents where source is not null) select doc_id, source from r join a using (source) where r <= quota")
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sm.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.05)


@query("select sft_id, case when r <= floor(n * 0.8::DOUBLE) then 'train' when r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) then 'val' else 'test' end as part from (select sft_id, row_number() over (order by md5(sft_id::VARCHAR || '42'), sft_id) as r, count(*) over () as n from sft)")
def sample_split(spark: SparkSession, d: str) -> DataFrame:
    return sm.seeded_split(table(spark, d, "sft").select("sft_id"), "sft_id")


@query("select sft_id from (select sft_id, row_number() over (order by md5(sft_id::VARCHAR || '7'), sft_id) as r, count(*) over () as n from sft) where r <= floor(n * 0.25::DOUBLE)")
def sample_share(spark: SparkSession, d: str) -> DataFrame:
    return sm.take_share(table(spark, d, "sft").select("sft_id"), "sft_id", 0.25, 7)


# -- similarity ------------------------------------------------------------------------------------------------------
_TIERS = f"select vec_id, rank, match_id, round(s, 6) as score from (select *, max(s) over (partition by vec_id) as best from ({_NEAR})) where best < 0.35 or s >= 0.35"


@query(f"select q.vec_id, t.rank, t.match_id, t.score from (select vec_id from embeddings where vec_id % 50 = 0) q left join ({_TIERS}) t using (vec_id)")
def match_two_tier(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return mt.cosine_topk_two_tier(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 3, 0.35, 0.30)


@query(f"select q.vec_id, coalesce(string_agg(t.match_id::VARCHAR, ' ' order by t.rank), '') as matches from (select vec_id from embeddings where vec_id % 50 = 0) q left join ({_TIERS}) t using (vec_id) group by 1")
def match_records(spark: SparkSession, d: str) -> DataFrame:
    m = mt.match_records(match_two_tier(spark, d), "vec_id")
    return m.select("vec_id", F.concat_ws(" ", F.transform("matches", lambda x: x["index"].cast("string"))).alias("matches"))


_TERMS = "select doc_id, t as term from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as t from documents where text is not null) where length(t) > 1"
_IDF = f"select term, count(distinct doc_id) as df, ln((1 + (select count(*) from documents)) / (1 + count(distinct doc_id))) + 1 as idf from ({_TERMS}) group by 1 having count(distinct doc_id) >= 2"
_TFIDF = f"with f as (select doc_id, term, count(*) as tf from ({_TERMS}) group by 1, 2), w as (select doc_id, term, tf * idf as w from f join ({_IDF}) using (term)) select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w"


_ALL_TERMS = "select doc_id, t as term from (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9" + "".join(rf"\p{{{x}}}" for x in enc.WORDED) + r"]+|\p{Han}+|[\p{Hiragana}\p{Katakana}ー]+|\p{Thai}+')) as t from documents where text is not null) where length(t) > 1"
_ALL_IDF, _ALL_TFIDF = _IDF.replace(_TERMS, _ALL_TERMS), _TFIDF.replace(_TERMS, _ALL_TERMS)


def _terms() -> F.Column:
    return F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


@query(f"select term, df, round(idf, 6) as idf from ({_IDF})")
def match_idf(spark: SparkSession, d: str) -> DataFrame:
    return mt.idf_table(table(spark, d, "documents"), "doc_id", _terms())


@query(f"select doc_id, term, round(w, 6) as w from ({_TFIDF})")
def match_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return mt.tfidf(table(spark, d, "documents"), "doc_id", _terms()).withColumn("w", F.round("w", 6))


@query(f"select term, df, round(idf, 6) as idf from ({_ALL_IDF})")
def match_idf_all(spark: SparkSession, d: str) -> DataFrame:
    """As match_idf, over the terms of every script."""
    return mt.idf_table(table(spark, d, "documents"), "doc_id", enc.script_terms(F.col("text")))


@query(f"select doc_id, term, round(w, 6) as w from ({_ALL_TFIDF})")
def match_tfidf_all(spark: SparkSession, d: str) -> DataFrame:
    """As match_tfidf, over the terms of every script."""
    return mt.tfidf(table(spark, d, "documents"), "doc_id", enc.script_terms(F.col("text"))).withColumn("w", F.round("w", 6))


_HYBRID = """with w as materialized ({w}), p as ({p}), t as (select a.doc_id as vec_id, b.doc_id as match_id, sum(a.w * b.w) as t from w a join w b using (term) where a.doc_id % 50 = 0 group by 1, 2),
f as (select vec_id, match_id, (1 - 0.2::DOUBLE) * (s + 1) / 2 + 0.2::DOUBLE * greatest(0.0, least(1.0, coalesce(t, 0))) as score from p left join t using (vec_id, match_id))
select vec_id, row_number() over (partition by vec_id order by score desc, match_id) as rank, match_id, round(score, 6) as score from f where score >= 0.5 qualify rank <= 2"""


def _hybrid(spark: SparkSession, d: str, terms: F.Column) -> DataFrame:
    e = table(spark, d, "embeddings")
    return mt.hybrid_search(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", mt.tfidf(table(spark, d, "documents"), "doc_id", terms), "doc_id", 2, 0.5, 0.2)


@query(_HYBRID.format(w=_TFIDF, p=_PAIRS))
def match_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse scores fused over all items, then cut."""
    return _hybrid(spark, d, _terms())


@query(_HYBRID.format(w=_ALL_TFIDF, p=_PAIRS))
def match_hybrid_all(spark: SparkSession, d: str) -> DataFrame:
    """As match_hybrid, over the terms of every script."""
    return _hybrid(spark, d, enc.script_terms(F.col("text")))


@query(f"""with s as (select p.vec_id, e.label::VARCHAR as tag, max(p.s) as s from ({_PAIRS}) p join embeddings e on e.vec_id = p.match_id where p.s >= 0.3 group by 1, 2),
t as (select *, row_number() over (partition by vec_id order by s desc, tag) as r, max(s) over (partition by vec_id) as best from s qualify r <= 3)
select vec_id, string_agg(tag, '；' order by s desc, tag) as tags from t where (best >= 0.4 and s >= 0.4) or (best < 0.4 and best >= 0.35 and s >= 0.35) or (best < 0.35 and r = 1) group by 1""")
def match_imputed_tags(spark: SparkSession, d: str) -> DataFrame:
    """The three best tags of all items, by tiers."""
    e = table(spark, d, "embeddings").withColumn("tag", F.col("label").cast("string"))
    scored = mt.tag_candidates(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "tag", 3, 0.3).withColumn("part", F.lit(0))
    return mt.impute_tags(scored, "vec_id", "part", "tag", "score", (0.4, 0.35, 0.3))


@query()
def match_filled_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags for experts without any, by their fields, in parts and whole, against the tags of all others; hashed vectors stand in for a model."""
    return mt.fill_tags(table(spark, d, "experts_full"), "row_idx", "research_field", "application", enc.hashed_vector)


@query(f"select term, round(idf, 6) as idf from ({_ALL_IDF}) where regexp_full_match(term, '[一-鿿]+')")
def match_term_export(spark: SparkSession, d: str) -> DataFrame:
    """Terms in Han script with their weights, for a dictionary."""
    return mt.term_export(match_idf_all(spark, d))


@query("select ccf_id, full_name from ccf_mapping where contains(upper(coalesce(short_name, '')), 'SENSING') or contains(upper(coalesce(full_name, '')), 'SENSING')")
def match_contains(spark: SparkSession, d: str) -> DataFrame:
    return mt.contains_search(table(spark, d, "ccf_mapping"), ["short_name", "full_name"], "sensing").select("ccf_id", "full_name")


# -- vectors, schedules, metrics -------------------------------------------------------------------------------------
@query("select a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) as cos from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("select vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9))), 6) as total from embeddings")
def vector_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(vx.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("select vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * least(1.0, 0.5::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)))), 6) as total from embeddings")
def vector_ball(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(vx.project_to_ball(F.col("embedding"), 0.5), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("select label, round(sqrt(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-30), 6) as norm from embeddings group by 1")
def vector_global_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sqrt(F.sum(vx.dot(F.col("embedding"), F.col("embedding"))) + 1e-30), 6).alias("norm"))


@query("with s as (select range::INT as step from range(100)) select step, round(case when step < 10 then 3e-5::DOUBLE * step / 10 else 3e-5::DOUBLE * greatest(0.0, (100 - step) / 90) end, 12) as rate, round(greatest(1e-6, case when step < 20 then 0.01::DOUBLE + (0.1::DOUBLE - 0.01::DOUBLE) * step / 20 else 0.1::DOUBLE * (exp(2 * step / 50) - 1) / (exp(2 * step / 50) + 1) end), 9) as radius, round(greatest(0.1::DOUBLE, least(2.0::DOUBLE, 1 / greatest(step / 50, 1e-8))), 9) as weight from s")
def vector_schedules(spark: SparkSession, d: str) -> DataFrame:
    s = spark.range(100).select(F.col("id").cast("int").alias("step"))
    g = F.col("step") / 50
    return s.select("step", F.round(vx.warmup_rate(F.col("step"), 3e-5, 10, 100), 12).alias("rate"), F.round(vx.ramp_radius(F.col("step"), g, 0.01, 0.1, 20), 9).alias("radius"), F.round(vx.balance(g, 0.1, 2.0), 9).alias("weight"))


_GRAMS = lambda n: "list_distinct(list_transform(range(1, greatest(len({0}) - %d, 1)), lambda i: array_to_string({0}[i:i + %d], ' ')))" % (n - 2, n - 1)


def _gram_sets(words: F.Column, n: int) -> F.Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(at, lambda i: (i >= 1) & (i <= F.size(words) - (n - 1))), lambda i: F.array_join(F.slice(words, i, n), " ")))


def _overlap(a: F.Column, b: F.Column) -> F.Column:
    hit = F.size(F.array_intersect(a, b))
    p, r = F.try_divide(hit, F.size(a)), F.try_divide(hit, F.size(b))
    return F.round(F.coalesce(100 * 2 * p * r / (p + r + 1e-8), F.lit(0.0)), 4)


_ROUGE = lambda a, b: f"round(coalesce(100 * 2 * (len(list_intersect({a}, {b})) / nullif(len({a}), 0)) * (len(list_intersect({a}, {b})) / nullif(len({b}), 0)) / (len(list_intersect({a}, {b})) / nullif(len({a}), 0) + len(list_intersect({a}, {b})) / nullif(len({b}), 0) + 1e-8::DOUBLE), 0.0), 4)"


@query(f"with w as (select sft_id, list_filter(regexp_split_to_array(coalesce(output, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') as p, list_filter(regexp_split_to_array(coalesce(input, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') as r from sft), g as (select sft_id, list_distinct(p) as p1, list_distinct(r) as r1, {_GRAMS(2).format('p')} as p2, {_GRAMS(2).format('r')} as r2 from w) select sft_id, {_ROUGE('p1', 'r1')} as rouge_1, {_ROUGE('p2', 'r2')} as rouge_2 from g")
def metric_rouge(spark: SparkSession, d: str) -> DataFrame:
    split = lambda c: F.filter(F.split(tx.filled(F.col(c)), "[ \t\n\r]+"), lambda x: x != "")
    w = table(spark, d, "sft").select("sft_id", split("output").alias("p"), split("input").alias("r"))
    p, r = F.col("p"), F.col("r")
    return w.select("sft_id", _overlap(F.array_distinct(p), F.array_distinct(r)).alias("rouge_1"), _overlap(_gram_sets(p, 2), _gram_sets(r, 2)).alias("rouge_2"))


@query()
def metric_bleu_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft").select("sft_id", st.bleu4_column("output", "input").alias("bleu_4"), st.rouge_l_column("output", "input").alias("rouge_l"))


@query("select event_type, round(exp(avg(value / 100)), 6) as ppl from events where value is not null group by 1")
def metric_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(vx.perplexity(F.avg(F.col("value") / 100)), 6).alias("ppl"))


@query("select round(avg(rouge_1), 6) as rouge_1_mean, round(avg(rouge_2), 6) as rouge_2_mean from (" + SQL["metric_rouge"] + ")")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return ss.metric_means(metric_rouge(spark, d), ["rouge_1", "rouge_2"])


@query("select l_orderkey, round(exp(avg(l_discount) filter (l_linenumber > 2)), 6) as ppl from lineitem group by 1")
def metric_sequence_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Of each order's lines as tokens, the first two as the prompt; an order of two lines or less has none."""
    return ss.sequence_perplexity(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", 2)


_TOKEN_VECTORS = "list_transform(range(0, 8), lambda i: {0}.embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[])"
_NEAREST = "list_avg(list_transform({0}, lambda x: list_max(list_transform({1}, lambda y: list_dot_product(x, y) / (greatest(sqrt(list_dot_product(x, x)), 1e-9) * greatest(sqrt(list_dot_product(y, y)), 1e-9))))))"


@query(f"with v as (select a.vec_id, {_TOKEN_VECTORS.format('a')} as p, {_TOKEN_VECTORS.format('b')} as r from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), m as (select vec_id, {_NEAREST.format('p', 'r')} as p, {_NEAREST.format('r', 'p')} as r from v) select vec_id, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from m")
def metric_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Token vectors of neighbours (an embedding as eight vectors of eight numbers) matched greedily."""
    e = table(spark, d, "embeddings")
    tokens = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    m = e.join(b, "vec_id").select("vec_id", vx.greedy_match(tokens(F.col("embedding")), tokens(F.col("other"))).alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def stats_tokens_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Token counts by the tokenizer's own vocabulary file."""
    t = lambda *cs: reduce(lambda a, b: a + b, [ss.bpe_tokens(F.col(c), VOCABULARY, BPE_PATTERN) for c in cs])
    return ss.token_stats(table(spark, d, "sft").select(t("instruction", "input").alias("i"), t("output").alias("o")), "i", "o")


# -- venues ----------------------------------------------------------------------------------------------------------
@query(f"""with v as (select row_idx, upper({q.translate(q.trim('pub'), chr(13) + chr(10), '')}) as v from papers),
s as (select upper({q.trim('short_name')}) as v, arg_max(category, ccf_id) as c from ccf_mapping where {q.trim('short_name')} <> '' group by 1), f as (select upper({q.trim('full_name')}) as v, arg_max(category, ccf_id) as c from ccf_mapping group by 1),
x as (select upper({q.trim('pub')}) as v, arg_max(journal_level, row_idx) as c from papers where journal_level is not null and {q.trim('pub')} <> '' group by 1)
select row_idx, coalesce(nullif(concat_ws(';', x.c, case when coalesce(s.c, f.c) is distinct from x.c then coalesce(s.c, f.c) end), ''), '未找到') as venue_rank from v left join x using (v) left join s using (v) left join f using (v)""")
def venue_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Levels known of papers of the venue, and the list's by its short, else its full name."""
    p, c = table(spark, d, "papers"), table(spark, d, "ccf_mapping")
    known = (p.where("journal_level is not null"), "pub", "journal_level", "row_idx")
    return vn.venue_rank(p, "pub", [known, [(c, "short_name", "category", "ccf_id"), (c, "full_name", "category", "ccf_id")]]).select("row_idx", "venue_rank")


_NAMES = [("cs.LG", "Machine learning"), ("cs.CL", "Language"), ("cs.CV", "Vision"), ("cs.AI", "Artificial intelligence"), ("stat.ML", "Statistics")]
_NAMES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _NAMES)


@query(f"with n(code, name) as (values {_NAMES_SQL}), p as (select row_idx, unnest(string_split(categories, ';')) as c, generate_subscripts(string_split(categories, ';'), 1) as i from papers), t as (select row_idx, string_agg(coalesce(name, {q.trim('c')}), ';' order by i) as translated from p left join n on n.code = {q.trim('p.c')} where {q.trim('c')} <> '' group by 1) select row_idx, translated from papers left join t using (row_idx)")
def venue_codes(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(_NAMES, "code string, name string")
    return vn.translate_codes(table(spark, d, "papers"), "row_idx", "categories", names, "code", "name")


@query("with f as (select arxiv_id, pub, citations from papers where arxiv_id is not null qualify row_number() over (partition by arxiv_id order by row_idx) = 1), l as (select arxiv_id, pub, citations from papers where arxiv_id is not null qualify row_number() over (partition by arxiv_id order by row_idx desc) = 1) select arxiv_id, case when f.pub is not null then f.pub else l.pub end as pub, case when f.pub is not null then f.citations when l.pub is not null then l.citations end as citations from f join l using (arxiv_id)")
def venue_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Venue and citations of the first fetch of a paper, or both of its last one where the first has no venue."""
    p = table(spark, d, "papers").where("arxiv_id is not null")
    both = p.groupBy("arxiv_id").agg(F.min_by(F.struct("pub", "citations"), "row_idx").alias("f"), F.max_by(F.struct("pub", "citations"), "row_idx").alias("l"))
    pub, cites = vn.enrich_first((F.col("f.pub"), F.col("f.citations")), (F.col("l.pub"), F.col("l.citations")))
    return both.select("arxiv_id", pub.alias("pub"), cites.alias("citations"))


# -- whole pipelines -------------------------------------------------------------------------------------------------
_ENT_FIX = {"scale": q.scale, "establish_time": q.first_word, "company_org_type": q.cut_bracket, "business": q.business}
_KINDS = ["category", "category_big", "category_middle"]


def _enterprise_sql() -> str:
    first = "select * from enterprises_full qualify row_number() over (partition by org_name order by row_idx) = 1"
    a = f"select row_idx, {', '.join(f'{q.fill(c)} as {c}' for c in ent.ENTERPRISE_COLUMNS)} from ({first})"
    a = f"select row_idx, {', '.join(f'{_ENT_FIX[c](c)} as {c}' if c in _ENT_FIX else c for c in ent.ENTERPRISE_COLUMNS)} from ({a})"
    a = f"select row_idx, {', '.join(f'{q.edge(c)} as {c}' for c in ent.ENTERPRISE_COLUMNS)} from ({a})"
    a = f"select row_idx, {', '.join(f'{q.category(c)} as {c}' if c in _KINDS else c for c in ent.ENTERPRISE_COLUMNS)} from ({a})"
    keep = " and ".join([f"not regexp_full_match({q.trim(c)}, '[0-9]+')" for c in _KINDS] + [f"{q.trim(c)} not in ('', '-')" for c in ent.ENTERPRISE_COLUMNS])
    return f"select * from ({a}) where {keep}"


@query(_enterprise_sql())
def clean_enterprises(spark: SparkSession, d: str) -> DataFrame:
    return ent.clean_enterprises(table(spark, d, "enterprises_full"))


@query(f"""select row_idx, user_name, {q.field('research_field')} as research_field, {q.application(q.fill('application'))} as application, {q.duty(q.append('duty', 'professional_title', ';'))} as duty, {q.append('btype_name', 'college')} as btype_name, introduction from experts_full
where {' and '.join(f'not {q.is_blank(c)}' for c in _STEPS)} and not regexp_full_match(research_field, '[一-龥]')""")
def clean_experts(spark: SparkSession, d: str) -> DataFrame:
    return ent.clean_experts(table(spark, d, "experts_full"))


def _achievement_sql(columns: list[str]) -> str:
    fixes = {"analyse_contect": q.renumbered, "application": q.list_cell, "aplication_field_scenario": q.scenario, "main_function": q.html, "main_advantage": q.html, "scene_lable": q.label, "chain_lable": q.label}
    a = f"select row_idx, {', '.join(f'{q.fill(c)} as {c}' for c in columns)} from achievements_full"
    a = f"select row_idx, {', '.join(f'{fixes[c](c)} as {c}' if c in fixes else c for c in columns)} from ({a})"
    a = f"select * replace ({q.title('title')} as title) from ({a}) where {q.trim('analyse_contect')} <> '无' and title <> analyse_contect"
    return f"select * from (select * from ({a}) qualify row_number() over (partition by title order by row_idx) = 1) where {q.trim('analyse_contect')} not in ('', '-')"


_ACHIEVEMENT = ["title", "analyse_contect", "application", "aplication_field_scenario", "main_function", "main_advantage", "scene_lable", "chain_lable"]


@query(_achievement_sql(["title", "analyse_contect"]))
def clean_achievements(spark: SparkSession, d: str) -> DataFrame:
    return ent.clean_achievements(table(spark, d, "achievements_full"))


@query(_achievement_sql(_ACHIEVEMENT))
def clean_achievements_full(spark: SparkSession, d: str) -> DataFrame:
    """With the columns the default leaves out."""
    return ent.clean_achievements(table(spark, d, "achievements_full"), keep=_ACHIEVEMENT)


@query(f"""with a as (select row_idx, {q.without(q.fill('title'), tx.TITLE_LITERALS)} as title, {q.need_content('analyse_contect')} as analyse_contect, replace({q.fill('application')}, '/', ';') as application from achievements_full)
select * from (select * from a qualify row_number() over (partition by title order by row_idx) = 1) where {q.trim('title')} <> '1' and not {q.is_blank('title')} and not {q.is_blank('analyse_contect')}""")
def clean_needs(spark: SparkSession, d: str) -> DataFrame:
    """The demand pipeline over the achievement table, whose columns are the same but for the publisher."""
    return ent.clean_needs(table(spark, d, "achievements_full").select("row_idx", "title", "analyse_contect", "application"))


