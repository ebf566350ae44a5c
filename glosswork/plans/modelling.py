"""Queries on scaling, encoding, feature choice, splits, ensembles and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosswork.fixed_values import BACKGROUND_ROWS, MEMBER_SALTS, TOP_DERIVED_FEATURES
from glosswork.functions import names
from glosswork.functions.hashing import poisson_weight
from glosswork.functions.numeric import rounded
from glosswork.operators import ensemble as ens
from glosswork.operators import evaluate as ev
from glosswork.operators import features as feat
from glosswork.operators import split as sp
from glosswork.operators.neighbours import NEIGHBOURS
from glosswork.operators.neighbours import neighbour_information as nearest_neighbour_scores
from glosswork.operators.percentiles import rounded_columns
from glosswork.plans.registry import SQL_POISSON, part, query, sql_uniform
from glosswork.session import local_table, materialize
from glosswork.sources.csv import dense_position
from glosswork.sources.sinks import predictions_table, run_summary, selected_features
from glosswork.sources.tables import CELLS, THEMES, coded_documents, priced_orders, rated_reviews, reviews, table

K = len(MEMBER_SALTS)


def split_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.threshold_split(reviews(spark, sf_dir))


def split_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.threshold_split(rated_reviews(spark, sf_dir))


def coded_rated(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rated rows with their part and the named columns, written once: for jobs that read them more
    than once, so that the texts are read only once."""
    return materialize(split_rated(spark, sf_dir).select("row_key", "split", "rating", *columns), "coded")


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


# ---- scaling and encoding ----------------------------------------------------------------------------------

part("row_stats", """
select avg(n_chars) as m_n, stddev_pop(n_chars) as s_n, avg(rating) as m_y, stddev_pop(rating) as s_y,
  avg(T1_TABLE) as m_1, stddev_pop(T1_TABLE) as s_1 from rated where split = 'train'""")


@query("standard_scale", """
select row_key, split, round((n_chars - m_n) / s_n, 9) + 0.0 as n_chars, round((T1_TABLE - m_1) / s_1, 9) + 0.0 as T1_TABLE
from rated cross join row_stats""")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the training rows, applied to all."""
    df = coded_rated(spark, sf_dir, "n_chars", "T1_TABLE")
    scaler = feat.Scaler.fit(train_part(df), ["n_chars", "T1_TABLE"])
    return rounded_columns(scaler.transform(df).select("row_key", "split", "n_chars", "T1_TABLE"),
                           ["n_chars", "T1_TABLE"], 9)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standard_scale_lineitem", f"""
select l_returnflag, l_linestatus, {", ".join(f"round(avg(({c} - m_{c}) / s_{c}), 6) + 0.0 as {c}" for c in _MEASURES)}
from lineitem cross join (select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _MEASURES)} from lineitem)
group by l_returnflag, l_linestatus""")
def standard_scale_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means of scaled measures over the largest table."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", *_MEASURES)
    scaled = feat.Scaler.fit(df, _MEASURES).transform(df)
    return scaled.groupBy("l_returnflag", "l_linestatus").agg(
        *[rounded(F.avg(c)).alias(c) for c in _MEASURES])


_CATEGORIES = ["division", "title", "recommended_txt"]
_LONG_SQL = " union all ".join(
    f"select row_key, split, '{c}' as feature, coalesce({c}, '__missing__') as category from rated" for c in _CATEGORIES)


@query("one_hot_long", f"""
select row_key, feature, category, 1.0::double as value from ({_LONG_SQL}) a
where exists (select 1 from ({_LONG_SQL}) b where b.split = 'train' and b.feature = a.feature and b.category = a.category)""")
def one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the training rows as indicators of all rows; unknown ones have none."""
    df = coded_rated(spark, sf_dir, *_CATEGORIES)
    return feat.one_hot_long(df, feat.category_vocabulary(train_part(df), _CATEGORIES), _CATEGORIES)


@query("category_vocab", f"""
select feature, category, cast(count(*) as bigint) as n,
  row_number() over (partition by feature order by category) - 1 as "index"
from ({_LONG_SQL}) where split = 'train' group by feature, category""")
def category_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_rated(spark, sf_dir)
    return feat.indexed_vocabulary(feat.category_vocabulary(train_part(df), _CATEGORIES))


# ---- mutual information ----------------------------------------------------------------------------------------

_NUMBERS = ["n_chars", "age"]
_DECILES = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
part("mi_input", """
select r.row_key, r.rating, r.division, r.T1_TABLE, r.T2_SHOUTING, r.T3_INSULT, r.T4_LICENSE, r.T5_SYMBOL_NOISE, r.T6_NUMBERS,
  coalesce(r.n_chars, m.n_chars) as n_chars, coalesce(r.age, m.age) as age from rated r cross join medians m""")
part("mi_edges", f"""
select list_distinct(quantile_cont(n_chars, {_DECILES})) as e_n, list_distinct(quantile_cont(age, {_DECILES})) as e_a from mi_input""")
part("mi_cells", " union all ".join(
    [f"select '{c}' as feature, cast({c} as varchar) as x, rating as y from mi_input" for c in [*THEMES, "division"]]
    + [f"select '{c}', cast(len(list_filter({e}, lambda v: v < {c})) as varchar), rating from mi_input cross join mi_edges"
       for c, e in [("n_chars", "e_n"), ("age", "e_a")]]))
part("mi_scores", """
select feature, greatest(sum(n / total * ln(n * total / (nx * ny))), 0) as mi from (
  select *, cast(sum(n) over (partition by feature) as double) as total, sum(n) over (partition by feature, x) as nx,
    sum(n) over (partition by feature, y) as ny
  from (select feature, x, y, count(*)::double as n from mi_cells group by all)) group by feature""")


def mi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of every feature with the rating, imputed first, numbers in deciles."""
    df = coded_rated(spark, sf_dir, *_NUMBERS, "division", *THEMES)
    df = feat.Imputer.fit(df, _NUMBERS).transform(df)
    edges = feat.quantile_edges(df, _NUMBERS)
    binned = {c: F.col(c) for c in [*THEMES, "division"]} | {c: feat.bin_index(F.col(c), e) for c, e in edges.items()}
    return feat.mutual_information(df, binned, F.col("rating"))


@query("mutual_information", "select feature, round(mi, 9) + 0.0 as mutual_information from mi_scores")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(mi_table(spark, sf_dir), ["mutual_information"], 9)


_KNN_INPUTS = [*_NUMBERS, *THEMES]
part("knn_scale", "select " + ", ".join(
    f"coalesce(nullif(stddev_pop({c})::float::double, 0), 1) as {c}" for c in [*_KNN_INPUTS, "rating"]) + " from mi_input")
part("knn_input", "select row_key, division, " + ", ".join(
    f"c.{c} + 1e-10::double * greatest(1, abs(c.{c})) * ({sql_uniform(f"concat(cast(row_key as varchar), ':{c}')")} - 0.5::double) as {c}"
    for c in [*_KNN_INPUTS, "rating"]) + " from (select r.row_key, r.division, " + ", ".join(
    f"r.{c} / s.{c} as {c}" for c in [*_KNN_INPUTS, "rating"]) + " from mi_input r cross join knn_scale s) c")
part("knn_points", " union all ".join(
    [f"select '{c}' as feature, '' as class, row_key, {c} as x, rating as y from knn_input" for c in _KNN_INPUTS]
    + ["select 'division', division, row_key, rating, 0 from knn_input"]))
part("knn_sized", "select * from (select *, count(*) over (partition by feature, class) as size from knn_points) where size > 1")
part("knn_radius", f"""
select a.feature, a.class, a.row_key, any_value(a.x) as x, any_value(a.y) as y, any_value(a.size) as size,
  list_extract(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {NEIGHBOURS}), least({NEIGHBOURS}, any_value(a.size) - 1)) as radius
from knn_sized a join knn_sized b on a.feature = b.feature and a.class = b.class and a.row_key <> b.row_key group by all""")
part("knn_near", """
select a.feature, a.row_key, any_value(a.size) as size, any_value(a.class) as class,
  count(*) filter (abs(a.x - b.x) < greatest(a.radius, 5e-324::double)) as near_x,
  count(*) filter (abs(a.y - b.y) < greatest(a.radius, 5e-324::double)) as near_y
from knn_radius a join knn_sized b on a.feature = b.feature group by a.feature, a.row_key""")
part("psi", """
select m, coalesce(sum(1.0::double / m) over (order by m rows between unbounded preceding and 1 preceding), 0) - 0.5772156649015329 as psi
from (select unnest(range(1, (select count(*) + 1 from mi_input))) as m)""")


@query("neighbour_information", f"""
select feature, round(greatest(any_value(n.psi) + avg(k.psi) - avg(x.psi) - avg(y.psi), 0), 9) + 0.0 as mutual_information
from (select *, count(*) over (partition by feature) as n, case when class = '' then near_y else size end as other from knn_near) p
join psi n on n.m = p.n join psi k on k.m = least({NEIGHBOURS}, size - 1) join psi x on x.m = near_x join psi y on y.m = other
group by feature""")
def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of every feature with the rating by nearest neighbours: numbers and flags as numbers, divisions as classes."""
    df = coded_rated(spark, sf_dir, *_NUMBERS, "division", *THEMES)
    df = materialize(feat.Imputer.fit(df, _NUMBERS).transform(df), "imputed")
    scores = nearest_neighbour_scores(df, "row_key", [*_KNN_INPUTS, "division"], "rating", discrete={"division"})
    return rounded_columns(scores, ["mutual_information"], 9)


@query("top_k_features", f"""
select row_number() over (order by round(mi, 9) desc, feature)::int as feature_rank, feature, round(mi, 9) + 0.0 as mutual_information
from mi_scores order by 1 limit {TOP_DERIVED_FEATURES}""")
def top_k_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.top_features(mi_table(spark, sf_dir))


@query("selected_feature_list", """
select (case when feature in ('n_chars', 'age') then case feature when 'n_chars' then 0 else 1 end else r + 1 end)::int as position,
  feature as raw_feature_name,
  case when feature in ('n_chars', 'age') then replace(feature, '_', ' ') else 'llm ' || replace(feature, '_', ' ') end as display_feature_name,
  case when feature in ('n_chars', 'age') then 'Original dataset feature' else 'LLM-derived feature' end as feature_type
from (select feature, row_number() over (partition by feature in ('n_chars', 'age') order by round(mi, 9) desc, feature) as r
  from mi_scores where feature <> 'division')""")
def selected_feature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline features, then the best theme features, with readable names and their kind."""
    scores = mi_table(spark, sf_dir).where(F.col("feature").isin(THEMES))
    best = [r["feature"] for r in feat.top_features(scores).orderBy("feature_rank").collect()]
    chosen = [*_NUMBERS, *best]
    shown_table = spark.range(1).select(*[
        names.clean_display(F.lit(c), F.lit(c in best)).alias(c) for c in chosen]).first()
    shown = dict(zip(chosen, feat.unique_name_list([shown_table[c] for c in chosen])))
    return selected_features(spark, chosen, shown, best)


@query("mutual_information_orders", f"""
select feature, round(greatest(sum(n / total * ln(n * total / (nx * ny))), 0), 9) + 0.0 as mutual_information from (
  select *, cast(sum(n) over (partition by feature) as double) as total, sum(n) over (partition by feature, x) as nx,
    sum(n) over (partition by feature, y) as ny
  from (select feature, x, y, count(*)::double as n from (
    with o as (select cast(substr(o_orderpriority, 1, 1) as double) as rating, o_totalprice as price, c_acctbal as balance,
        o_orderstatus as status, c_mktsegment as segment from orders join customer on o_custkey = c_custkey),
      e as (select list_distinct(quantile_cont(price, {_DECILES})) as e_p, list_distinct(quantile_cont(balance, {_DECILES})) as e_b from o)
    select 'status' as feature, status as x, rating as y from o union all select 'segment', segment, rating from o
    union all select 'price', cast(len(list_filter(e_p, lambda v: v < price)) as varchar), rating from o cross join e
    union all select 'balance', cast(len(list_filter(e_b, lambda v: v < balance)) as varchar), rating from o cross join e)
  group by all)) group by feature""")
def mutual_information_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(priced_orders(spark, sf_dir), "orders")
    edges = feat.quantile_edges(df, ["price", "balance"])
    binned = {c: F.col(c) for c in ("status", "segment")} | {c: feat.bin_index(F.col(c), e) for c, e in edges.items()}
    return rounded_columns(feat.mutual_information(df, binned, F.col("rating")), ["mutual_information"], 9)


# ---- names -----------------------------------------------------------------------------------------------------

_NAMES_SQL = """
select distinct concat(case when row_key % 2 = 0 then 'llm_' else '' end, title, '_', division,
  case row_key % 4 when 0 then '_present' when 1 then '_polarity' when 2 then '__intensity' else '' end) as name from reviews"""


def _feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("row_key")
    name = F.concat(F.when(key % 2 == 0, "llm_").otherwise(""), "title", F.lit("_"), "division",
                    F.when(key % 4 == 0, "_present").when(key % 4 == 1, "_polarity")
                    .when(key % 4 == 2, "__intensity").otherwise(""))
    return coded_documents(spark, sf_dir).select(name.alias("name")).distinct()


_SQL_DERIVED = "(name like 'llm\\_%' escape '\\' or name like '%\\_present' escape '\\' or name like '%\\_polarity' escape '\\' or name like '%\\_intensity' escape '\\')"


@query("display_name_prefix", f"""
select name, case when {_SQL_DERIVED} and not name like 'llm\\_%' escape '\\' then 'llm_' || name else name end as display from ({_NAMES_SQL})""")
def display_name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_names(spark, sf_dir).select("name", names.prefix_display(F.col("name")).alias("display"))


@query("display_name_clean", f"""
select name, case when {_SQL_DERIVED}
  then 'llm ' || trim(regexp_replace(replace(replace(name, 'llm_', ''), '_', ' '), '\\s+', ' ', 'g'))
  else trim(regexp_replace(replace(name, '_', ' '), '\\s+', ' ', 'g')) end as display from ({_NAMES_SQL})""")
def display_name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _feature_names(spark, sf_dir).select("name", names.clean_display(name, names.is_derived(name)).alias("display"))


@query("unique_names", """
select row_key, case when r = 0 then title else concat(title, ' (', cast(r as varchar), ')') end as unique_name from (
  select row_key, title, row_number() over (partition by title order by row_key) - 1 as r from reviews)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's title made unique in key order."""
    placed = dense_position(coded_documents(spark, sf_dir).select("row_key", "title"), "row_key")
    return feat.unique_names(placed, "title", "position").select("row_key", "unique_name")


# ---- splits and draws ---------------------------------------------------------------------------------------------

@query("hash_split_threshold", "select row_key, split from rated")
def hash_split_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_table(split_rated(spark, sf_dir))


@query("hash_split_exact", """
select o_orderkey as row_key, case when row_number() over (order by md5(concat(cast(o_orderkey as varchar), ':42')))
  <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from orders""")
def hash_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly ceil(20%) test rows of the orders."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_key"))
    return sp.split_table(sp.exact_split(keys))


@query("split_apply_join", """
select split, cast(count(*) as bigint) as n, cast(count(rating) as bigint) as rated, round(avg(n_chars), 6) as mean_chars
from parted group by split""")
def split_apply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved split table joined back to the rows by key."""
    split = materialize(sp.split_table(split_reviews(spark, sf_dir)), "split")
    joined = sp.apply_split(reviews(spark, sf_dir), split)
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"),
                                       rounded(F.avg("n_chars")).alias("mean_chars"))


part("background", f"""
select * from rated where split = 'train' order by md5(concat(cast(row_key as varchar), ':bg42')) limit {BACKGROUND_ROWS}""")


@query("background_sample", "select row_key, rating, n_chars from background")
def background_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.background_sample(train_part(split_rated(spark, sf_dir))).select("row_key", "rating", "n_chars")


@query("exact_bootstrap", f"""
with places as (select row_key, row_number() over (order by row_key) - 1 as place, count(*) over () as n from rated where split = 'train'),
picked as (select salt, cast(floor((('0x' || substr(md5(concat(cast(salt as varchar), ':', cast(place as varchar))), 1, 13))::bigint
  / 4503599627370496.0::double) * n) as bigint) as pick from places cross join (select unnest([{', '.join(map(str, MEMBER_SALTS))}]) as salt))
select row_key, cast(salt as int) as member, count(*) as draws from picked join (select row_key, place from places) p on pick = p.place
group by row_key, salt""")
def exact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each member draws each training row, as many draws as rows; rows that are not drawn are left out."""
    drawn = sp.exact_bootstrap(train_part(coded_rated(spark, sf_dir)), "row_key", MEMBER_SALTS)
    each = F.arrays_zip(F.array(*map(F.lit, MEMBER_SALTS)).alias("member"), "draws")
    return drawn.select("row_key", F.explode(each).alias("x")).select(
        "row_key", F.col("x.member").cast("int").alias("member"), F.col("x.draws").alias("draws")).where("draws > 0")


@query("poisson_bootstrap", "select row_key, " + ", ".join(
    f"cast(sum(case when member = {m} then w end) as int) as w{m}" for m in MEMBER_SALTS) + " from boots group by row_key")
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated_reviews(spark, sf_dir).select(
        "row_key", *[poisson_weight("row_key", m).alias(f"w{m}") for m in MEMBER_SALTS])


# ---- ensemble of cell means ------------------------------------------------------------------------------------------

def fitted_cells(spark: SparkSession, sf_dir: str) -> tuple[ens.CellMeans, DataFrame]:
    """Coded rows written once, and the ensemble fitted on their rated training part."""
    coded = materialize(split_reviews(spark, sf_dir).select("row_key", "split", "rating", *CELLS), "coded")
    train = train_part(coded).where(F.col("rating").isNotNull())
    return ens.CellMeans.fit(train, CELLS, "rating"), coded


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, coded = fitted_cells(spark, sf_dir)
    return model.score(coded)


@query("ensemble_fit_cellmean", "select * exclude (mean, member), member::int as member, round(mean, 6) as mean from cell_params")
def ensemble_fit_cellmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = fitted_cells(spark, sf_dir)
    return rounded_columns(model.long_params(), ["mean"])


@query("ensemble_member_preds", "select row_key, member::int as member, round(pred, 6) as pred from preds")
def ensemble_member_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(ens.long_predictions(scored_reviews(spark, sf_dir), MEMBER_SALTS), ["pred"])


def _summary(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    columns = ens.summary_columns(K)
    return scored_reviews(spark, sf_dir).select("row_key", *[rounded(columns[c]).alias(c) for c in wanted])


def _summary_sql(*wanted: str) -> str:
    return "select row_key, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in wanted) + " from scored"


@query("ensemble_mean_std", _summary_sql("pred_mean", "pred_std_pop", "pred_std_samp"))
def ensemble_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "pred_mean", "pred_std_pop", "pred_std_samp")


@query("ensemble_interval", _summary_sql("pred_low", "pred_high"))
def ensemble_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "pred_low", "pred_high")


@query("rating_bands", _summary_sql("share_lt_3", "share_3_to_4", "share_ge_4"))
def rating_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "share_lt_3", "share_3_to_4", "share_ge_4")


part("stretched", "select row_key, member, least(greatest((pred - 4) * 3 + 4, 1), 5) as pred from preds")


@query("clamp_ensemble", """
select row_key, round(least(greatest(avg(pred), 1), 5), 6) + 0.0 as pred_mean, round(stddev_pop(pred), 6) + 0.0 as pred_std_pop
from stretched group by row_key""")
def clamp_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member predictions stretched past the rating range, then limited before they are averaged."""
    scored = scored_reviews(spark, sf_dir)
    wide = F.array(*[(F.col(ens.PREDS)[i] - 4) * 3 + 4 for i in range(K)])
    columns = ens.clamped_summary(K)
    return scored.withColumn(ens.PREDS, wide).select("row_key", *[rounded(c).alias(n) for n, c in columns.items()])


@query("inverse_scale", """
select row_key, round(avg(p) * any_value(s_y) + any_value(m_y), 6) + 0.0 as pred_mean,
  round(stddev_pop(p) * any_value(s_y), 6) + 0.0 as pred_std_pop
from (select row_key, (pred - m_y) / s_y as p, s_y, m_y from preds cross join row_stats) group by row_key""")
def inverse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble fitted on the scaled target, its mean and spread brought back to the rating scale."""
    coded = materialize(split_reviews(spark, sf_dir).select("row_key", "split", "rating", *CELLS), "coded")
    train = train_part(coded).where(F.col("rating").isNotNull())
    scaler = feat.Scaler.fit(train, ["rating"])
    model = ens.CellMeans.fit(scaler.transform(train), CELLS, "rating")
    p = F.col(ens.PREDS)
    return model.score(coded).select(
        "row_key", rounded(scaler.unscaled(ens.member_mean(p, K), "rating")).alias("pred_mean"),
        rounded(scaler.unscaled_spread(ens.member_std(p, K), "rating")).alias("pred_std_pop"))


@query("prediction_table", """
select row_key, rating as y_true, round(pred_mean, 6) as y_pred_mean, round(pred_std_pop, 6) + 0.0 as y_pred_std
from scored where split = 'test' and rating is not null""")
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction sink's rows: rated test rows in key order."""
    scored = scored_reviews(spark, sf_dir).where((F.col("split") == "test") & F.col("rating").isNotNull())
    out = predictions_table(scored.withColumns(ens.summary_columns(K)), "rating")
    return rounded_columns(out, ["y_pred_mean", "y_pred_std"])


# ---- evaluation ---------------------------------------------------------------------------------------------------------

_METRICS_SQL = """cast(count(*) as bigint) as n, round(avg(abs(rating - pred_mean)), 6) as mae,
  round(sqrt(avg((rating - pred_mean) ** 2)), 6) as rmse,
  round(1 - sum((rating - pred_mean) ** 2) / (var_pop(rating) * count(*)), 6) as r2, round(avg(pred_std_pop), 6) as mean_std"""


@query("regression_metrics", f"select split, {_METRICS_SQL} from scored where rating is not null group by split")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one pass over the texts, then fit, score and evaluate.

    Ratings take few values, so equal (cell, split, rating) rows are combined at once, each with its
    count and its summed bootstrap weights. Fitting and evaluation then work on that small table.
    """
    rows = split_rated(spark, sf_dir)
    weights = {m: poisson_weight("row_key", m) for m in MEMBER_SALTS}
    combined = rows.groupBy(*CELLS, "split", "rating").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"b{m}") for m, w in weights.items()])
    combined = materialize(combined, "combined")
    model = ens.CellMeans.fit(train_part(combined), CELLS, "rating", {m: F.col(f"b{m}") for m in MEMBER_SALTS})
    scored = model.score(combined).withColumns(ens.summary_columns(K))
    metrics = ev.regression_metrics(scored, "rating", std="pred_std_pop", by=["split"], weight="rows")
    return rounded_columns(metrics, ["mae", "rmse", "r2", "mean_std"])


@query("mean_predictive_std", """
select split, division, round(avg(pred_std_pop), 6) as mean_std from scored join (select row_key, division from reviews) using (row_key)
group by split, division""")
def mean_predictive_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean member spread of all rows by split and division."""
    df = materialize(split_reviews(spark, sf_dir).select("row_key", "split", "division", "rating", *CELLS), "coded")
    model = ens.CellMeans.fit(train_part(df).where(F.col("rating").isNotNull()), CELLS, "rating")
    scored = model.score(df).withColumns(ens.summary_columns(K))
    return scored.groupBy("split", "division").agg(rounded(F.avg("pred_std_pop")).alias("mean_std"))


@query("run_summary", """
select 'cell means' as experiment, cast(sum(n) as bigint) as rows_used, cast(sum(case when split = 'train' then n end) as bigint) as train_size,
  cast(sum(case when split = 'test' then n end) as bigint) as test_size, cast(5 as bigint) as n_members,
  max(case when split = 'test' then mae end) as mae, max(case when split = 'test' then rmse end) as rmse,
  max(case when split = 'test' then r2 end) as r2, 'threshold split' as note
from (select split, """ + _METRICS_SQL + """ from scored where rating is not null group by split)""")
def run_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, coded = fitted_cells(spark, sf_dir)
    scored = model.score(coded.where(F.col("rating").isNotNull())).withColumns(ens.summary_columns(K))
    summary = run_summary(ev.run_metrics(scored, "rating"), "cell means", K, "threshold split")
    return rounded_columns(summary, ["mae", "rmse", "r2"])


_BASE_CELLS = ["division", "T6_NUMBERS"]


def _experiment_sql(name: str, cells: list[str]) -> str:
    on = " and ".join(f"p.{c} = r.{c}" for c in cells)
    return f"""select '{name}' as experiment, cast(count(*) as bigint) as n, round(avg(abs(rating - pred_mean)), 6) as mae,
  round(sqrt(avg((rating - pred_mean) ** 2)), 6) as rmse,
  round(1 - sum((rating - pred_mean) ** 2) / (var_pop(rating) * count(*)), 6) as r2 from (
  select r.row_key, any_value(r.rating) as rating, avg(coalesce(p.mean, o.g)) as pred_mean
  from rated r cross join overall o left join (select member, {", ".join(cells)},
      case when sum(w) > 0 then sum(w * rating) / sum(w) end as mean from boots where split = 'train' group by all) p
    on p.member = o.member and {on} where r.split = 'test' group by r.row_key)"""


@query("experiment_compare", _experiment_sql("baseline", _BASE_CELLS) + " union all "
       + _experiment_sql("with themes", [*_BASE_CELLS, *CELLS]))
def experiment_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain columns against plain columns and themes, both on one split."""
    df = coded_rated(spark, sf_dir, "division", "T6_NUMBERS", *CELLS)
    parts = None
    for name, cells in (("baseline", _BASE_CELLS), ("with themes", [*_BASE_CELLS, *CELLS])):
        model = ens.CellMeans.fit(train_part(df), cells, "rating")
        scored = model.score(df.where(F.col("split") == "test")).withColumns(ens.summary_columns(K))
        one = ev.regression_metrics(scored, "rating").withColumn("experiment", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return rounded_columns(parts, ["mae", "rmse", "r2"])


_ORDER_SQL = f"""
with o as (select *, case when md5(concat(cast(row_key as varchar), ':42')) < '33333333' then 'test' else 'train' end as split from (
    select o_orderkey as row_key, cast(substr(o_orderpriority, 1, 1) as double) as rating, o_orderstatus as status, c_mktsegment as segment
    from orders join customer on o_custkey = c_custkey)),
  b as (select *, {SQL_POISSON} as w from (select *, {sql_uniform("concat(cast(row_key as varchar), ':', cast(member as varchar))")} as u
    from (select *, unnest(range(43, 48)) as member from o where split = 'train'))),
  p as (select member, status, segment, sum(w * rating) / sum(w) as mean from b group by all),
  s as (select o.row_key, any_value(rating) as rating, any_value(split) as split, avg(mean) as pred_mean, stddev_pop(mean) as pred_std_pop
    from o join p using (status, segment) group by o.row_key)
select split, {_METRICS_SQL} from s group by split"""


@query("order_ensemble_metrics", _ORDER_SQL)
def order_ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap ensemble over all orders with their customers, scored row by row."""
    df = materialize(sp.threshold_split(priced_orders(spark, sf_dir)).select(
        "row_key", "split", "rating", "status", "segment"), "orders")
    model = ens.CellMeans.fit(train_part(df), ["status", "segment"], "rating")
    scored = model.score(df).withColumns(ens.summary_columns(K))
    return rounded_columns(ev.regression_metrics(scored, "rating", std="pred_std_pop", by=["split"]),
                           ["mae", "rmse", "r2", "mean_std"])


@query("linear_one_feature", """
select member::int as member, round(sxy / sxx, 9) + 0.0 as slope, round(my - sxy / sxx * mx, 9) + 0.0 as intercept from (
  select member, any_value(mx) as mx, any_value(my) as my, sum(w * (n_chars - mx) * (rating - my)) as sxy,
    sum(w * (n_chars - mx) ** 2) as sxx from (
    select *, sum(w * n_chars) over (partition by member) / sum(w) over (partition by member) as mx,
      sum(w * rating) over (partition by member) / sum(w) over (partition by member) as my from (
      select b.member, b.w, b.rating, (b.n_chars - m_n) / s_n as n_chars from boots b cross join row_stats where split = 'train'))
  group by member)""")
def linear_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap least squares on one scaled feature, whose solution is known in closed form."""
    train = train_part(coded_rated(spark, sf_dir, "n_chars"))
    scaled = feat.Scaler.fit(train, ["n_chars"]).transform(train)
    model = ens.LinearMembers.fit(scaled, ["n_chars"], "rating")
    out = local_table(spark, [(m, float(b[1]), float(b[0])) for m, b in zip(model.members, model.coefficients)],
                      "member int, slope double, intercept double")
    return rounded_columns(out, ["slope", "intercept"], 9)


_GRAM = ["n_chars", *CELLS]


@query("linear_gram", """
with base as (select member, w, 1.0::double as _intercept, n_chars, T1_TABLE, T2_SHOUTING, T3_INSULT, T5_SYMBOL_NOISE, rating as _target
  from boots where split = 'train')
""" + " union all ".join(
    f"select member::int as member, '{a}' as i, '{b}' as j, cast(sum(w * {a} * {b}) as double) as value from base group by member"
    for x, a in enumerate(["_intercept", *_GRAM, "_target"]) for b in ["_intercept", *_GRAM, "_target"][x:]))
def linear_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of products of all members; the values are whole numbers, so they are exact."""
    train = train_part(split_rated(spark, sf_dir))
    return ens.weighted_gram(train, {c: F.col(c) for c in _GRAM}, F.col("rating"), ens.bootstrap_weights())


@query("linear_gram_lineitem", "with stats as (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _MEASURES) + " from lineitem), base as (select "
    + ", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in _MEASURES) + ", 1.0::double as one from lineitem cross join stats) "
    + " union all ".join(f"select '{a}' as i, '{b}' as j, round(avg({a} * {b}), 6) + 0.0 as value from base"
                         for x, a in enumerate(["one", *_MEASURES]) for b in ["one", *_MEASURES][x:]))
def linear_gram_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean products of the scaled measures of all line items: the correlation matrix."""
    df = table(spark, sf_dir, "lineitem").select(*_MEASURES)
    scaled = feat.Scaler.fit(df, _MEASURES).transform(df)
    gram = ens.weighted_gram(scaled, {c: F.col(c) for c in _MEASURES[:-1]}, F.col(_MEASURES[-1]), ens.equal_weights([0]))
    total = F.max(F.when((F.col("i") == "_intercept") & (F.col("j") == "_intercept"), F.col("value"))).over(W.partitionBy())
    name = lambda c: F.when(c == "_intercept", "one").when(c == "_target", _MEASURES[-1]).otherwise(c)
    return gram.select(name(F.col("i")).alias("i"), name(F.col("j")).alias("j"), rounded(F.col("value") / total).alias("value"))
