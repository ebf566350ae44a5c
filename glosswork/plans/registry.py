"""The list of queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswork.fixed_values import FIXTURE_THEMES, MEMBER_SALTS, POISSON_CUTS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sql_uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


def _sql_themes() -> str:
    """The same themes as regular expressions: an independent way to the same flags."""
    def pattern(needles, regex):
        return regex or "|".join(re.escape(n) for n in needles)
    return ",\n".join(
        f"case when regexp_matches({'lower(d.text)' if lower else 'd.text'}, '{pattern(needles, regex)}') then 1 else 0 end as {n}"
        for n, needles, regex, lower in FIXTURE_THEMES)


SQL_POISSON = "case " + " ".join(f"when u < {c:.8f} then {i}" for i, c in enumerate(POISSON_CUTS)) + " else 6 end"
_MEMBERS = f"unnest(range({MEMBER_SALTS[0]}, {MEMBER_SALTS[-1] + 1}))"
_SPLIT = "case when md5(concat(cast(row_key as varchar), ':42')) < '33333333' then 'test' else 'train' end"

# Named parts of the check SQL; a query gets the ones it mentions, and what those mention.
PARTS: dict[str, str] = {
    "reviews": f"""
select d.doc_id as row_key, d.source as title, d.text as review_text, d.lang as division,
  cast(d.n_chars as double) as n_chars,
  cast(1 + 3 * l.quality + (1 - l.toxic) as double) as rating,
  case when l.quality is null then 'None' when l.quality = 1 then ' Yes ' else 'no' end as recommended_txt,
  case when d.doc_id % 13 = 0 then null else cast(d.n_chars % 100 as double) end as age,
  {_sql_themes()}
from documents d left join labels l on d.doc_id = l.doc_id""",
    "parted": f"select *, {_SPLIT} as split from reviews",
    "rated": "select * from parted where rating is not null",
    "medians": "select coalesce(median(age), 0) as age, coalesce(median(n_chars), 0) as n_chars from rated",
    "answers": """
select row_key, case when row_key % 11 = 0 then 'I cannot answer that'
  when row_key % 17 = 0 then concat('{"T1_TABLE": ', cast(T1_TABLE as varchar), ', "T2_SHOUTING": ')
  else concat('Sure! {"T1_TABLE": ', cast(T1_TABLE as varchar), ', "T2_SHOUTING": "', cast(T2_SHOUTING as varchar),
    '", "T3_INSULT": ', case when T3_INSULT = 1 then 'true' else 'false' end,
    ', "T5_SYMBOL_NOISE": ', case when T5_SYMBOL_NOISE = 1 then '1.9' else '0.4' end,
    ', "T6_NUMBERS": "', case when T6_NUMBERS = 1 then '1.0' else 'x' end, '"} Done.') end as response
from reviews""",
    "boots": f"""
select *, {SQL_POISSON} as w from (
  select *, {sql_uniform("concat(cast(row_key as varchar), ':', cast(member as varchar))")} as u
  from (select *, {_MEMBERS} as member from rated))""",
    "cell_params": """
select member, T1_TABLE, T2_SHOUTING, T3_INSULT, T5_SYMBOL_NOISE, cast(sum(w) as double) as weight,
  case when sum(w) > 0 then sum(w * rating) / sum(w) end as mean
from boots where split = 'train' group by all""",
    "overall": "select member, sum(w * rating) / sum(w) as g from boots where split = 'train' group by member",
    "preds": """
select r.row_key, r.rating, r.split, o.member, coalesce(p.mean, o.g) as pred
from parted r cross join overall o left join cell_params p on p.member = o.member
  and p.T1_TABLE = r.T1_TABLE and p.T2_SHOUTING = r.T2_SHOUTING
  and p.T3_INSULT = r.T3_INSULT and p.T5_SYMBOL_NOISE = r.T5_SYMBOL_NOISE""",
    "scored": """
select row_key, any_value(rating) as rating, any_value(split) as split, avg(pred) as pred_mean,
  stddev_pop(pred) as pred_std_pop, coalesce(stddev_samp(pred), 0) as pred_std_samp,
  quantile_cont(pred, 0.025) as pred_low, quantile_cont(pred, 0.975) as pred_high,
  avg(case when pred < 3 then 1.0 else 0.0 end) as share_lt_3,
  avg(case when pred >= 3 and pred < 4 then 1.0 else 0.0 end) as share_3_to_4,
  avg(case when pred >= 4 then 1.0 else 0.0 end) as share_ge_4
from preds group by row_key""",
}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def _with_parts(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"(from|join)\s+{name}\b", text):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} as materialized ({PARTS[n]})" for n in needed)
    own = sql.lstrip()
    if head and own.startswith("with "):
        return f"with {head},\n{own[5:]}"
    return f"with {head}\n{sql}" if head else sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is omitted where SQL cannot express the result."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def oracle_sql() -> dict[str, str]:
    return {name: _with_parts(sql) for name, sql in ORACLES.items()}
