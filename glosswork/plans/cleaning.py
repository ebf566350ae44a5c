"""Queries on scanning, cleaning and column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import FIRST_ROWS, INSTANCE_POSITION, NULL_TOKENS
from glosswork.functions.coerce import clear_null_tokens, text_to_number, word_flag
from glosswork.functions.numeric import rounded
from glosswork.operators import features as feat
from glosswork.operators.split import first_rows, threshold_split
from glosswork.plans.registry import query
from glosswork.session import materialize, scratch_path
from glosswork.sources.csv import clear_missing, read_csv, read_csv_tolerant, rows_at
from glosswork.sources.sinks import audit_row, write_quoted_csv
from glosswork.sources.tables import THEMES, coded_documents, odd_texts, rated_reviews, reviews

_SHOWN = "row_key, title, division, n_chars, rating, recommended_txt, age, " + ", ".join(THEMES)
_TOKENS = [t for t in NULL_TOKENS] + ["none", "-", "x"]
_SQL_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_SQL_NUMBER = r"""case when regexp_matches({0}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') then try_cast(trim({0}) as double)
  when lower(trim({0})) in ('inf', '+inf', 'infinity') then 'inf'::double when lower(trim({0})) in ('-inf', '-infinity') then '-inf'::double end"""
_SQL_WORD = """case when lower(trim({0})) in ('true', 'yes', 'y', 'recommended') then 1.0::double
  when lower(trim({0})) in ('false', 'no', 'n', 'not recommended') then 0.0::double end"""


def _sql_number(c: str) -> str:
    return _SQL_NUMBER.format(c)


def _sql_word(c: str) -> str:
    return _SQL_WORD.format(c)


@query("review_scan_clean", f"""
select {_SHOWN.replace('recommended_txt', "case when recommended_txt <> 'None' then recommended_txt end as recommended_txt")},
  cast(length(review_text) as bigint) as text_length from reviews""")
def review_scan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan with missing-value tokens cleared."""
    return clear_missing(reviews(spark, sf_dir)).select(*_SHOWN.split(", "), "text_length")


def _token(size: int) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (F.pmod("row_key", F.lit(size)) + 1).cast("int"))


@query("null_token_cleanup", f"""
select row_key, raw, case when raw not in ({_SQL_TOKENS}) then raw end as cleaned,
  case when title not in ({_SQL_TOKENS}) then title end as title from (
  select row_key, title, list_extract([{", ".join(f"'{t}'" for t in _TOKENS)}], cast(row_key % {len(_TOKENS)} + 1 as int)) as raw
  from reviews)""")
def null_token_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coded_documents(spark, sf_dir).select("row_key", "title", _token(len(_TOKENS)).alias("raw"))
    return df.select("row_key", "raw", clear_null_tokens(F.col("raw")).alias("cleaned"),
                     clear_null_tokens(F.col("title")).alias("title"))


_ODD_SQL = """case row_key % 12 when 0 then concat(' ', n, ' ') when 1 then concat(n, 'e3') when 2 then concat(n, 'd')
  when 3 then 'inf' when 4 then concat(n, ',000') when 5 then concat('0x', n) when 6 then concat(n, '_0')
  when 7 then 'True' when 8 then concat('-', n, '.5') when 9 then 'nan' when 10 then concat('.', n) else n end"""


@query("coerce_numeric", f"""
select row_key, raw, {_sql_number('raw')} as value from (
  select row_key, {_ODD_SQL} as raw from (select row_key, cast(cast(n_chars as bigint) as varchar) as n from reviews))""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("bigint").cast("string")
    lit = F.lit
    odd = {0: F.concat(lit(" "), n, lit(" ")), 1: F.concat(n, lit("e3")), 2: F.concat(n, lit("d")), 3: lit("inf"),
           4: F.concat(n, lit(",000")), 5: F.concat(lit("0x"), n), 6: F.concat(n, lit("_0")), 7: lit("True"),
           8: F.concat(lit("-"), n, lit(".5")), 9: lit("nan"), 10: F.concat(lit("."), n)}
    raw = odd_texts(coded_documents(spark, sf_dir), odd, n, "raw")
    return raw.select("row_key", "raw", text_to_number(F.col("raw")).alias("value"))


_TEXTS = ["title", "division", "recommended_txt", "flag_or_number", "age_txt"]
_MIXED_SQL = """select row_key, title, division, recommended_txt,
  case when row_key % 2 = 0 then 'yes' else cast(T6_NUMBERS as varchar) end as flag_or_number,
  cast(cast(age as bigint) as varchar) as age_txt from reviews"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select(
        "row_key", "title", "division", "recommended_txt",
        F.when(F.col("row_key") % 2 == 0, "yes").otherwise(F.col("T6_NUMBERS").cast("string")).alias("flag_or_number"),
        F.col("age").cast("bigint").cast("string").alias("age_txt"))


@query("coercion_choice", " union all ".join(f"""
select '{c}' as "column", cast(count({c}) as bigint) as non_null, cast(count({_sql_word(c)}) as bigint) as mapped,
  cast(count({_sql_number(c)}) as bigint) as numeric,
  case when count({_sql_word(c)}) > count({_sql_number(c)}) then 'words' else 'number' end as choice
from ({_MIXED_SQL})""" for c in _TEXTS))
def coercion_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _mixed(spark, sf_dir)
    table = feat.facts_table(df, feat.column_facts(df, skip=["row_key"]))
    return table.select("column", "non_null", "mapped", "numeric", "choice")


@query("coerced_features", f"""
select row_key, {", ".join(f"case when m_{c} then {_sql_word(c)} else {_sql_number(c)} end as {c}" for c in _TEXTS)}
from ({_MIXED_SQL}) cross join (
  select {", ".join(f"count({_sql_word(c)}) > count({_sql_number(c)}) as m_{c}" for c in _TEXTS)} from ({_MIXED_SQL}))""")
def coerced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _mixed(spark, sf_dir)
    return feat.numeric_columns(df, feat.column_facts(df, skip=["row_key"]), _TEXTS)


_GATE = ["title", "division", "n_chars", "recommended_txt", "age", *THEMES]
_TEXT_COLUMNS = ("title", "division", "recommended_txt")


@query("numeric_feature_gate", " union all ".join(f"""
select '{c}' as "column", cast(greatest({f"count({_sql_word(c)}), count({_sql_number(c)})" if c in _TEXT_COLUMNS else f"count({c}), 0"}) as bigint) as kept_values,
  case when greatest({f"count({_sql_word(c)}), count({_sql_number(c)})" if c in _TEXT_COLUMNS else f"count({c}), 0"}) > 0 then 1 else 0 end as usable
from rated""" for c in _GATE))
def numeric_feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rated_reviews(spark, sf_dir).select(*_GATE)
    table = feat.facts_table(df, feat.column_facts(df))
    return table.select("column", F.greatest("mapped", "numeric").alias("kept_values"),
                        F.col("usable").cast("int").alias("usable"))


@query("feature_roles", f"""
select 'explainer' as layout, "column", case when "column" = 'rating' then 'target' when usable = 0 then 'dropped'
  when "column" like 'T%' then 'derived' else 'baseline' end as role from ({" union all ".join(f'''
  select '{c}' as "column", cast(greatest({f"count({_sql_word(c)}), count({_sql_number(c)})" if c in _TEXT_COLUMNS else f"count({c}), 0"}) > 0 as int) as usable from rated''' for c in [*_GATE, "rating"])})
union all
select 'experiment', "column", case when "column" = 'rating' then 'target' when "column" like 'T%' then 'theme'
  when mean_length >= 25 then 'text' when mean_length is not null then 'categorical' else 'numeric' end from ({" union all ".join(f'''
  select '{c}' as "column", {f"avg(length({c}))" if c in (*_TEXT_COLUMNS, "review_text") else "any_value(null::double)"} as mean_length from rated''' for c in [*_GATE, "rating", "review_text"])})""")
def feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column roles of both table layouts from one scan of all columns."""
    df = rated_reviews_text(spark, sf_dir).select(*_GATE, "rating", "review_text")
    facts = feat.column_facts(df)
    plain = {n: f for n, f in facts.items() if n != "review_text"}
    explainer = feat.roles_table(df, feat.explainer_roles(plain, "rating", derived=feat.is_theme_name))
    experiment = feat.roles_table(df, feat.experiment_roles(facts, "rating"))
    return (explainer.withColumn("layout", F.lit("explainer"))
            .unionByName(experiment.withColumn("layout", F.lit("experiment"))).select("layout", "column", "role"))


def rated_reviews_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, with_text=True).drop("text_length").na.drop(subset=["rating"])


@query("text_column_detect", " union all ".join(f"""
select '{c}' as "column", round(avg(length({c})), 6) as mean_length, cast(avg(length({c})) >= 25 as int) as is_text from reviews"""
                                               for c in ("title", "review_text", "division", "recommended_txt")))
def text_column_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reviews(spark, sf_dir, with_text=True).select("title", "review_text", "division", "recommended_txt")
    table = feat.facts_table(df, feat.column_facts(df))
    return table.select("column", rounded(F.col("mean_length")).alias("mean_length"),
                        F.col("is_text").cast("int").alias("is_text"))


@query("dtype_roles", " union all ".join(f"""
select '{c}' as "column", '{r}' as role, cast(count({c}) as bigint) as non_null from (select *, n_chars > 1000 as is_long from reviews)"""
                                        for c, r in [("title", "categorical"), ("division", "categorical"),
                                                     ("n_chars", "numeric"), ("age", "numeric"), ("is_long", "numeric"),
                                                     ("T1_TABLE", "theme")]))
def dtype_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric and categorical columns by type; a boolean column counts as numeric."""
    df = reviews(spark, sf_dir).withColumn("is_long", F.col("n_chars") > 1000).select(
        "title", "division", "n_chars", "age", "is_long", "T1_TABLE")
    facts = feat.column_facts(df)
    roles = feat.roles_table(df, feat.experiment_roles(facts, "rating"))
    return roles.join(feat.facts_table(df, facts), "column").select("column", "role", "non_null")


@query("theme_fill_zero", f"""
select row_key, coalesce({_sql_number('t1')}, 0) as T1_TABLE, 0.0::double as T7_RETURN_REFUND from (
  select row_key, case row_key % 4 when 0 then null when 1 then 'x' when 2 then concat(' ', cast(T1_TABLE as varchar)) else cast(T1_TABLE as varchar) end as t1
  from reviews)""")
def theme_fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("T1_TABLE").cast("string")
    raw = odd_texts(coded_documents(spark, sf_dir), {0: F.lit(None), 1: F.lit("x"), 2: F.concat(F.lit(" "), flag)}, flag, "T1_TABLE")
    full = feat.add_missing_columns(raw.select("row_key", "T1_TABLE"), ["T1_TABLE", "T7_RETURN_REFUND"])
    return feat.zero_filled(full, ["T1_TABLE", "T7_RETURN_REFUND"])


@query("drop_metadata_columns", f"select row_key, rating, n_chars, age, {', '.join(THEMES)} from rated")
def drop_metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reviews(spark, sf_dir, with_text=True).drop("text_length")
    slim = feat.drop_metadata(df, "rating", ["title", "review_text", "division", "recommended_txt", "rating", "no such"])
    return feat.drop_missing_target(slim, "rating")


@query("drop_null_target", "select row_key, rating, title from rated")
def drop_null_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.drop_missing_target(reviews(spark, sf_dir), "rating").select("row_key", "rating", "title")


@query("first_n_rows", f"""
select row_key, rating, n_chars from (select * from reviews order by row_key limit {FIRST_ROWS}) where rating is not null""")
def first_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference cut: the first rows, and only then the rated ones."""
    return feat.drop_missing_target(first_rows(reviews(spark, sf_dir), FIRST_ROWS), "rating").select(
        "row_key", "rating", "n_chars")


@query("row_lookup", f"""
select position, row_key, rating, n_chars, split from (
  select *, row_number() over (order by row_key) - 1 as position, count(*) over () as total from rated)
where position in (0, {INSTANCE_POSITION}, total - 1)""")
def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position after the null-target filter, the last one by clamping a far position."""
    df = materialize(threshold_split(rated_reviews(spark, sf_dir)).select(
        "row_key", "rating", "n_chars", "split"), "coded")
    return rows_at(df, [0, INSTANCE_POSITION, 1 << 62], "row_key", clamp=True).select(
        "position", "row_key", "rating", "n_chars", "split")


@query("median_impute", """
select row_key, coalesce(r.age, m.age) as age, coalesce(r.n_chars, m.n_chars) as n_chars from rated r cross join medians m""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(rated_reviews(spark, sf_dir).select("row_key", "age", "n_chars"), "coded")
    return feat.Imputer.fit(df, ["age", "n_chars"]).transform(df).select("row_key", "age", "n_chars")


@query("feature_audit", """
select to_json({rows_used: count(*), target_col: 'rating', baseline_numeric: ['n_chars', 'age'],
  baseline_categorical: ['title', 'division', 'recommended_txt'],
  thematic_cols: ['T1_TABLE', 'T2_SHOUTING', 'T3_INSULT', 'T4_LICENSE', 'T5_SYMBOL_NOISE', 'T6_NUMBERS'],
  excluded_text_cols: ['review_text']})::varchar as audit from rated""")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rated_reviews_text(spark, sf_dir).drop("row_key")
    facts = feat.column_facts(df)
    roles = feat.roles_table(df, feat.experiment_roles(facts, "rating"))
    return audit_row(roles, "rating", facts["rating"].non_null)


# ---- CSV -------------------------------------------------------------------------------------------------------

@query("quoted_csv_roundtrip", """
select row_key, title, review_text, rating, n_chars from reviews""")
def quoted_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews written as fully quoted CSV and read back, types found again from the text."""
    path = scratch_path(spark, "quoted-csv")
    wide = reviews(spark, sf_dir, with_text=True).select(
        "row_key", "title", "review_text", "rating", "n_chars")
    write_quoted_csv(wide, path)
    return read_csv(spark, path)


@query("tolerant_csv_read", """
select kind, title, cast(count(*) as bigint) as n, cast(count(division) as bigint) as with_division,
  cast(sum(row_key) as bigint) as keys from (
  select *, case when row_key % 7 = 3 then 'surplus' else 'kept' end as kind,
  from (select row_key, title, case when row_key % 7 <> 5 then division end as division from reviews)) group by kind, title""")
def tolerant_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose lines are partly too short or too long: short ones are kept, long ones set aside."""
    path = scratch_path(spark, "broken-csv")
    key, field = F.col("row_key").cast("string"), F.pmod("row_key", F.lit(7))
    line = (F.when(field == 3, F.concat_ws(",", key, "title", "division", F.lit("surplus")))
            .when(field == 5, F.concat_ws(",", key, "title")).otherwise(F.concat_ws(",", key, "title", "division")))
    coded_documents(spark, sf_dir).select(line.alias("value")).write.option("header", False).text(path)
    read = read_csv_tolerant(spark, path, ["row_key", "title", "division"], header=False, multi_line=False)
    both = (read.rows.withColumn("kind", F.lit("kept"))
            .unionByName(read.bad_lines.drop("_extra").withColumn("kind", F.lit("surplus"))))
    return both.groupBy("kind", "title").agg(
        F.count(F.lit(1)).alias("n"), F.count("division").alias("with_division"),
        F.sum(F.col("row_key").try_cast("bigint")).alias("keys"))


@query("csv_headers_by_name", """
select row_key, title, division, case when row_key % 3 = 2 then cast(n_chars as bigint) end as n_chars from reviews""")
def csv_headers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with the same names in another order, some with one name more: each field goes where its own file's header says."""
    path = scratch_path(spark, "mixed-csv")
    df = reviews(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("bigint"))
    orders = [["row_key", "title", "division"], ["division", "row_key", "title"], ["title", "n_chars", "row_key", "division"]]
    for part, names in enumerate(orders):
        write_quoted_csv(df.where(F.pmod("row_key", F.lit(3)) == part).select(*names), f"{path}/{part}")
    rows = read_csv_tolerant(spark, [f"{path}/{part}" for part in range(len(orders))], multi_line=False).rows
    return rows.select(F.col("row_key").cast("bigint"), "title", "division", F.col("n_chars").cast("bigint"))
