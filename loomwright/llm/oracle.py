"""SQL of the language-model queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomwright.llm import looks

#: A category without white space and punctuation at its ends (RE2 classes).
_CLEAN = r"regexp_replace(regexp_replace(category, '^[\s\pP\pS\pZ\pC]+', ''), '[\s\pP\pS\pZ\pC]+$', '')"
_QUOTA = f"""
with have as (select {_CLEAN} as category, count(*) as n from enterprises_full group by 1),
     size as (select floor(0.2::DOUBLE * count(*) + 0.5) as n from enterprises_full),
     goal as (select t.category, target_share as share, min_rows, greatest(t.min_rows, floor(t.target_share * size.n + 0.5)::BIGINT) as wanted, coalesce(h.n, 0) as available, size.n as size
              from category_targets t cross join size left join have h on h.category = t.category)
"""


def _shared(source: str, parent: str, place: str, total: str, weight: str, cap: str, name: str) -> str:
    """Common table expressions: `source` with the column `name`, total of each parent shared out by weight below the caps.

    Those below their cap get the same level a weight; the level is that of the first, in order of cap over weight,
    whose cap it does not reach. Whole rows go by the largest remainder, ties by place.
    """
    w, p = f"greatest({weight}, 1e-12)", f"partition by {parent}"
    return f"""{name}_a as (select *, least({total}, sum({cap}) over ({p})) as t_, {w} as w_, {cap} / {w} as r_ from {source}),
{name}_b as (select *, coalesce(sum({cap}) over ({p} order by r_, {place} rows between unbounded preceding and 1 preceding), 0) as full_, sum(w_) over ({p} order by r_, {place} rows between current row and unbounded following) as open_, row_number() over ({p} order by r_, {place}) as i_ from {name}_a),
{name}_c as (select *, case when (t_ - full_) / open_ <= r_ * (1 + 1e-12) then (t_ - full_) / open_ end as l_ from {name}_b),
{name}_d as (select *, coalesce(least({cap}, arg_min(l_, i_) filter (l_ is not null) over ({p}) * w_), {cap})::DOUBLE as x_ from {name}_c),
{name}_e as (select *, floor(x_ + 1e-9)::BIGINT as f_, t_ - sum(floor(x_ + 1e-9)) over ({p}) as rest_ from {name}_d),
{name}_f as (select *, coalesce(sum((f_ < {cap})::INT) over ({p} order by round(x_ - f_, 6) desc, {place} rows between unbounded preceding and 1 preceding), 0) as turn_ from {name}_e),
{name} as (select * exclude (t_, w_, r_, full_, open_, i_, l_, x_, f_, rest_, turn_), f_ + (f_ < {cap} and turn_ < rest_)::INT as {name} from {name}_f)"""


_REPORT = f"""{_QUOTA},
g as (select *, 1 as one, row_number() over (order by share desc, category) as place, least(wanted, available) as given, wanted - least(wanted, available) as shortfall, available - least(wanted, available) as room, greatest(0, least(wanted, available) - min_rows) as above from goal),
s as (select *, greatest(0, size - sum(given) over ()) as more_, greatest(0, sum(given) over () - size) as less_ from g),
{_shared("s", "one", "place", "more_", "share", "room", "more")},
{_shared("more", "one", "place", "less_", "above", "above", "less")},
report as (select category, wanted, available, (given + more - less)::BIGINT as quota, shortfall from less)"""

_AT = lambda c: f"coalesce({_CLEAN.replace('category', c)}, '')"
_SAMPLE = f"""{_REPORT},
tagged as (select row_idx, {_AT('category')} as c, {_AT('category_big')} as b, {_AT('category_middle')} as m from enterprises_full),
bigs as (select c, b, count(*) as n, any_value(quota) as quota, row_number() over (partition by c order by b = '', b) as place from tagged join report on category = c group by c, b),
{_shared("bigs", "c", "place", "quota", "1.0", "n", "asked")},
leaves as (select c, b, m, count(*) as n, any_value(asked) as asked, row_number() over (partition by c, b order by m = '', m) as place, c || chr(1) || b as cb from tagged join (select c, b, asked from asked) using (c, b) group by c, b, m),
{_shared("leaves", "cb", "place", "asked", "1.0", "n", "take")},
ranked as (select row_idx, c, b, m, dense_rank() over (partition by c, b, m order by md5(row_idx::VARCHAR || '42')) as r from tagged)
select row_idx, c as category from ranked join (select c, b, m, take from take) using (c, b, m) where r <= take"""


def _forms() -> dict[str, str]:
    """The SQL of the forms; the look-alikes of further scripts come from the ICU library of a running session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return {}
    form = looks.look_sql("t", looks.confusables(spark))
    return {"p7_forms": " union all ".join(f"select '{t}' as source_table, '{f}' as field_name, row_idx, {form} as form from (select row_idx, {f} as t from {t} where {f} is not null)" for t, f in looks.FIELDS.items())}


def oracle_sql() -> dict[str, str]:
    return _forms() | {
        "p6_found": _QUOTA + "select category from goal where available < wanted",
        "p6_report": _REPORT + " select * from report",
        "p6_sample": _SAMPLE,
    }
