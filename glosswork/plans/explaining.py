"""Queries on neural ensembles and on explanations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import BACKGROUND_ROWS, MEMBER_SALTS, PERTURBATIONS
from glosswork.functions.names import rule_feature
from glosswork.functions.numeric import rounded
from glosswork.operators import ensemble as ens
from glosswork.operators import evaluate as ev
from glosswork.operators import features as feat
from glosswork.operators import lime, shap
from glosswork.operators import split as sp
from glosswork.operators.neural import SETUPS, NetMembers, add_indicators
from glosswork.operators.percentiles import rounded_columns
from glosswork.plans.modelling import K, coded_rated, train_part
from glosswork.plans.registry import part, query, sql_uniform
from glosswork.sources.tables import CELLS, THEMES

LIME_FEATURES = ["n_chars", *CELLS]
#: Perturbations per explained row where each row has draws of its own.
CONTINUOUS_SAMPLES = 500


def _test_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_rated(spark, sf_dir, "n_chars", "age", *THEMES)


# ---- SHAP of the cell-mean ensemble --------------------------------------------------------------------------

part("cell_f", f"""
select T1_TABLE, T2_SHOUTING, T3_INSULT, T5_SYMBOL_NOISE, avg(coalesce(p.mean, o.g)) as f
from (select distinct a.T1_TABLE, b.T2_SHOUTING, c.T3_INSULT, d.T5_SYMBOL_NOISE from (select unnest([0, 1]) as T1_TABLE) a
  cross join (select unnest([0, 1]) as T2_SHOUTING) b cross join (select unnest([0, 1]) as T3_INSULT) c
  cross join (select unnest([0, 1]) as T5_SYMBOL_NOISE) d) g
cross join overall o left join cell_params p using (member, T1_TABLE, T2_SHOUTING, T3_INSULT, T5_SYMBOL_NOISE) group by all""")
part("turns", " union all ".join(f"""
select row_key, {i} as i, md5(concat(cast(row_key as varchar), ':{c}:42')) as h from rated where split = 'test'"""
                                 for i, c in enumerate(CELLS)))
part("ordered_turns", "select row_key, i, row_number() over (partition by row_key order by h, i) - 1 as t from turns")
_M = len(CELLS)
part("state_means", f"""
select r.row_key, s.s, avg(cf.f) as v from (select * from rated where split = 'test') r
cross join (select unnest(range(0, {2 * _M})) as s) s cross join background b
join (select row_key, {", ".join(f"max(case when i = {i} then t end) as t{i}" for i in range(_M))} from ordered_turns group by row_key) t
  on t.row_key = r.row_key
join cell_f cf on {" and ".join(
    f"cf.{c} = case when (s.s <= {_M} and t.t{i} < s.s) or (s.s > {_M} and t.t{i} >= {2 * _M} - s.s) then r.{c} else b.{c} end"
    for i, c in enumerate(CELLS))}
group by r.row_key, s.s""")
part("shap_phi", f"""
select o.row_key, [{", ".join(f"'{c}'" for c in CELLS)}][o.i + 1] as feature,
  (v1.v - v0.v + b1.v - b0.v) / 2 as phi, vb.v as base_value, vp.v as prediction
from ordered_turns o
join state_means v0 on v0.row_key = o.row_key and v0.s = o.t
join state_means v1 on v1.row_key = o.row_key and v1.s = o.t + 1
join state_means b1 on b1.row_key = o.row_key and b1.s = case when o.t = 0 then {_M} else {2 * _M} - o.t end
join state_means b0 on b0.row_key = o.row_key and b0.s = case when o.t = {_M} - 1 then 0 else {2 * _M} - 1 - o.t end
join state_means vb on vb.row_key = o.row_key and vb.s = 0
join state_means vp on vp.row_key = o.row_key and vp.s = {_M}""")


def explained_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """SHAP values of the cell-mean ensemble for every rated test row, and the coded rows."""
    coded = _coded(spark, sf_dir)
    train, test = train_part(coded), _test_part(coded)
    model = ens.CellMeans.fit(train, CELLS, "rating")
    background = shap.collect_background(sp.background_sample(train, BACKGROUND_ROWS), CELLS)
    return shap.shap_by_join(test, background, CELLS, model.score, K), coded


@query("shap_values_cellmean", """
select row_key, feature, round(phi, 6) + 0.0 as phi, round(base_value, 6) as base_value, round(prediction, 6) as prediction from shap_phi""")
def shap_values_cellmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained, _ = explained_cells(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("phis")[i].alias("phi")) for i, c in enumerate(CELLS)])
    out = explained.select("row_key", "base_value", "prediction", F.inline(pairs))
    return rounded_columns(out, ["phi", "base_value", "prediction"])


@query("shap_importance", "select feature, round(avg(abs(phi)), 6) + 0.0 as importance from shap_phi group by feature")
def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained, _ = explained_cells(spark, sf_dir)
    return rounded_columns(ev.mean_absolute_attribution(shap.long_attributions(explained, CELLS)), ["importance"])


@query("shap_beeswarm", """
select p.row_key, feature, cast(case feature when 'T1_TABLE' then T1_TABLE when 'T2_SHOUTING' then T2_SHOUTING
  when 'T3_INSULT' then T3_INSULT else T5_SYMBOL_NOISE end as double) as value, round(phi, 6) + 0.0 as phi
from shap_phi p join rated r using (row_key)""")
def shap_beeswarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained, _ = explained_cells(spark, sf_dir)
    return rounded_columns(shap.beeswarm_points(explained, CELLS), ["phi"])


@query("shap_waterfall", """
select row_key, row_number() over w::int as step, feature, round(phi, 6) + 0.0 as phi,
  round(base_value + coalesce(sum(phi) over (partition by row_key order by abs(round(phi, 9)), feature
    rows between unbounded preceding and 1 preceding), 0), 6) as "start",
  round(base_value + sum(phi) over (partition by row_key order by abs(round(phi, 9)), feature rows unbounded preceding), 6) as "end"
from shap_phi window w as (partition by row_key order by abs(round(phi, 9)), feature)""")
def shap_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained, _ = explained_cells(spark, sf_dir)
    return rounded_columns(shap.waterfall_steps(explained, CELLS), ["phi", "start", "end"])


# ---- LIME of the cell-mean ensemble ----------------------------------------------------------------------------

_F = LIME_FEATURES
part("lime_edges", " union all ".join(f"""
select {i} as f, '{c}' as feature, list_sort(list_distinct(quantile_cont({c}, [0.25, 0.5, 0.75]))) as edges from rated where split = 'train'"""
                                      for i, c in enumerate(_F)))
_BINS_OF = " union all ".join(
    f"select row_key, split, {i} as f, cast({c} as double) as v from rated" for i, c in enumerate(_F))
part("row_bins", f"""
select b.row_key, b.split, b.f, b.v, len(list_filter(e.edges, lambda x: x < b.v))::int as bin
from ({_BINS_OF}) b join lime_edges e using (f)""")
part("bin_stats", """
select e.f, e.feature, g.bin::int as bin, coalesce(s.n, 0)::bigint as n, s.mean, e.edges,
  coalesce(sum(s.n) over (partition by e.f order by g.bin), 0) as upper, sum(s.n) over (partition by e.f) as total
from lime_edges e cross join (select unnest(range(0, 4)) as bin) g
left join (select f, bin, count(*) as n, avg(v) as mean from row_bins where split = 'train' group by f, bin) s
  on s.f = e.f and s.bin = g.bin where g.bin <= len(e.edges)""")
part("draws", f"""
select s, f, min(bin) as bin from (
  select s, f, {sql_uniform("concat(cast(s as varchar), ':', feature, ':42')")} as u
  from (select unnest(range(1, {PERTURBATIONS})) as s) cross join (select distinct f, feature from bin_stats))
join bin_stats using (f) where u * total < upper group by s, f""")
part("sample_values", f"""
select s, {", ".join(f"max(case when d.f = {i} then d.bin end) as b{i}" for i in range(len(_F)))},
  {", ".join(f"max(case when d.f = {i} then cast(b.mean as int) end) as x{i}" for i in range(1, len(_F)))}
from draws d join bin_stats b on b.f = d.f and b.bin = d.bin group by s""")
part("sample_scores", f"""
select s.*, c.f as fx from sample_values s join cell_f c on {" and ".join(f"c.{c} = s.x{i + 1}" for i, c in enumerate(CELLS))}""")
_Z = ["1.0", *[f"z{i}" for i in range(len(_F))], "fx"]
part("row_wide", f"""
select r.row_key, {", ".join(f"max(case when r.f = {i} then r.bin end) as r{i}" for i in range(len(_F)))}
from row_bins r where split = 'test' group by r.row_key""")
part("lime_z", f"""
select row_key, fx, {", ".join(f"z{i}" for i in range(len(_F)))},
  exp(-({len(_F)} - ({" + ".join(f"z{i}" for i in range(len(_F)))})) / (2 * 0.5625 * {len(_F)})) as w from (
  select r.row_key, s.fx, {", ".join(f"case when s.b{i} = r.r{i} then 1.0::double else 0.0::double end as z{i}" for i in range(len(_F)))}
  from row_wide r cross join sample_scores s
  union all
  select w.row_key, c.f, {", ".join("1.0" for _ in _F)} from row_wide w join rated r using (row_key)
  join cell_f c on {" and ".join(f"c.{c} = r.{c}" for c in CELLS)})""")


def lime_setup(spark: SparkSession, sf_dir: str):
    coded = _coded(spark, sf_dir)
    model = ens.CellMeans.fit(train_part(coded), CELLS, "rating")
    bins = lime.QuartileBins.fit(train_part(coded), _F)
    drawn = lime.draw_bins(bins)
    f = lime.score_samples(spark, bins, drawn, model.score, K)
    return coded, model, bins, drawn, f


@query("lime_bins", """
select feature, bin, n, round(mean, 6) + 0.0 as mean, case when bin > 0 then edges[bin] end as above, edges[bin + 1] as up_to from bin_stats""")
def lime_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = train_part(_coded(spark, sf_dir))
    return rounded_columns(lime.QuartileBins.fit(train, _F).table(spark), ["mean"])


@query("lime_samples", f"""
select r.row_key, {", ".join(f"cast(sum(case when s.b{i} = r.r{i} then 1 else 0 end) as bigint) as same_{c}" for i, c in enumerate(_F))}
from row_wide r cross join sample_values s group by r.row_key""")
def lime_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many perturbed samples share the bin of each explained row, per feature: the unweighted
    margins of the sample table, counted once per feature and bin."""
    coded = _coded(spark, sf_dir)
    bins = lime.QuartileBins.fit(train_part(coded), _F)
    drawn = lime.draw_bins(bins)
    counts = [[int((drawn[:, i] == b).sum()) for b in range(len(e) + 1)] for i, e in enumerate(bins.edges)]
    return _test_part(coded).select("row_key", *[
        F.element_at(F.array(*[F.lit(n).cast("bigint") for n in counts[i]]), b + 1).alias(f"same_{_F[i]}")
        for i, b in enumerate(bins.bin_columns())])


@query("lime_weighted_sums", " union all ".join(
    f"select row_key, {i}::int as i, {j}::int as j, round(sum(w * {_Z[i]} * {_Z[j]}), 6) as value from lime_z group by row_key"
    for i in range(len(_Z)) for j in range(i, len(_Z))))
def lime_weighted_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, model, bins, drawn, f = lime_setup(spark, sf_dir)
    return rounded_columns(lime.lime_sums(model.score(_test_part(coded)), bins, drawn, f, K), ["value"])


@query("lime_explain")
def lime_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local ridge fits of every rated test row and the table shown for it."""
    coded, model, bins, drawn, f = lime_setup(spark, sf_dir)
    local = lime.lime_explain(model.score(_test_part(coded)), bins, drawn, f, K, keep=_F)
    rows = lime.with_rules(local, bins, "coefficients")
    return lime.explanation_table(rows, _F, [f"llm_{c}" if c in THEMES else c for c in _F], integers=CELLS)


@query("lime_bin_spread", """
select e.feature, r.bin, round(stddev_pop(r.v), 6) + 0.0 as std, min(r.v) as least, max(r.v) as greatest
from row_bins r join lime_edges e using (f) where r.split = 'train' group by e.feature, r.bin""")
def lime_bin_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and ends of the training values in each bin, from which continuous perturbations are drawn."""
    bins = lime.QuartileBins.fit(train_part(_coded(spark, sf_dir)), _F)
    return rounded_columns(bins.spread_table(spark), ["std"])


@query("lime_draws_in_bins", f"""
select e.feature, cast(count(*) * {CONTINUOUS_SAMPLES - 1} as bigint) as draws, 0::bigint as outside
from row_bins r join lime_edges e using (f) where r.split = 'test' group by e.feature""")
def lime_draws_in_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every continuous perturbation of every rated test row, held against the ends of the bin it was drawn for."""
    coded = _coded(spark, sf_dir)
    bins = lime.QuartileBins.fit(train_part(coded), _F)
    return lime.drawn_outside(_test_part(coded), bins, CONTINUOUS_SAMPLES).groupBy("feature").agg(
        F.sum("draws").alias("draws"), F.sum("outside").alias("outside"))


_RULE_SQL = """case when len(edges) = 0 then feature when bin = 0 then feature || ' <= ' || printf('%.2f', edges[1])
  when bin = len(edges) then feature || ' > ' || printf('%.2f', edges[len(edges)])
  else printf('%.2f', edges[bin]) || ' < ' || feature || ' <= ' || printf('%.2f', edges[bin + 1]) end"""
part("rule_rows", f"""
select r.row_key, r.f, e.feature, r.bin, {_RULE_SQL} as rule from row_bins r join lime_edges e using (f)""")


@query("rule_to_feature", """
select row_key, rule, coalesce((select n.feature from lime_edges n where contains(lower(rule), lower(n.feature))
  order by length(n.feature) desc limit 1), rule) as feature from rule_rows""")
def rule_to_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of every rated row and feature, traced back to the feature by its text."""
    df = _coded(spark, sf_dir)
    bins = lime.QuartileBins.fit(train_part(df), _F)
    rules = df.select("row_key", F.explode(F.array(*[bins.rule(i) for i in range(len(_F))])).alias("rule"))
    return rules.select("row_key", "rule", rule_feature(F.col("rule"), _F, _F).alias("feature"))


@query("explanation_table", f"""
select p.row_key, row_number() over (partition by p.row_key order by abs(round(phi, 9)) desc, rule)::int as position,
  'llm_' || p.feature as feature, cast(cast(b.v as bigint) as varchar) as value, round(phi, 6) + 0.0 as contribution,
  printf('%+.3f', phi + 0.0) as contribution_text, case when phi >= 0 then 'pos' else 'neg' end as sign
from (select row_key, feature, case when abs(phi) < 1e-12 then 0.0 else phi end as phi from shap_phi) p
join rule_rows r on r.row_key = p.row_key and r.feature = p.feature
join row_bins b on b.row_key = p.row_key and b.f = r.f""")
def explanation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature, value and contribution lines of every rated test row, from its SHAP values."""
    explained, coded = explained_cells(spark, sf_dir)
    bins = lime.QuartileBins.fit(train_part(coded), CELLS)
    quiet = F.transform("phis", lambda p: F.when(F.abs(p) < 1e-12, 0.0).otherwise(p))
    values = {c: F.col("xs")[i] for i, c in enumerate(CELLS)}  # the values travel with the attributions: no join back
    rows = lime.with_rules(explained.withColumns({"phis": quiet, **values}), bins, "phis")
    table = lime.explanation_table(rows, CELLS, [f"llm_{c}" for c in CELLS], integers=CELLS)
    return table.withColumn("contribution", rounded(F.col("contribution")))


# ---- linear and neural members ----------------------------------------------------------------------------------

_INPUTS = ["n_chars", "age", *THEMES]


def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _coded(spark, sf_dir)
    return feat.Imputer.fit(train_part(df), ["age", "n_chars"]).transform(df)


@query("ensemble_fit_linear")
def ensemble_fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap ensemble of least-squares members on scaled features, evaluated by split."""
    df = _imputed(spark, sf_dir)
    scaled = feat.Scaler.fit(train_part(df), _INPUTS).transform(df)
    model = ens.LinearMembers.fit(train_part(scaled), _INPUTS, "rating")
    scored = model.score(scaled).withColumns(ens.summary_columns(K))
    return ev.regression_metrics(scored, "rating", std="pred_std_pop", by=["split"])


def fitted_net(spark: SparkSession, sf_dir: str, setup: str = "bootstrap", epochs: int | None = None):
    df = _imputed(spark, sf_dir)
    config = SETUPS[setup] if epochs is None else replace(SETUPS[setup], epochs=epochs)
    model = NetMembers.fit(train_part(df), _INPUTS, "rating", config, rounds=5)
    return model, df


@query("ensemble_fit_mlp")
def ensemble_fit_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the trained members: one row per member, layer and kind."""
    model, _ = fitted_net(spark, sf_dir, "decay")
    return model.table(spark)


@query("training_history")
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = fitted_net(spark, sf_dir, "bootstrap")
    return model.history_table(spark)


@query("ensemble_score_mlp")
def ensemble_score_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rated row with mean, spread, interval and band shares of the neural ensemble."""
    model, df = fitted_net(spark, sf_dir, "bootstrap")
    return model.score(df).select("row_key", "split", "rating", *[
        c.alias(n) for n, c in ens.summary_columns(len(model.members)).items()])


@query("experiment_compare_mlp")
def experiment_compare_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both experiments on one split: plain columns, then plain columns and themes, each as a neural
    ensemble with scaled numbers and indicator columns."""
    df = coded_rated(spark, sf_dir, "n_chars", "age", "division", *THEMES)
    df = feat.Imputer.fit(train_part(df), ["n_chars", "age"]).transform(df)
    wide, ones = add_indicators(df, feat.category_vocabulary(train_part(df), ["division"]))
    wide = feat.zero_filled(wide, THEMES)
    parts = None
    for name, setup, extra in (("baseline", "tabular", []), ("with themes", "tabular_clamped", THEMES)):
        inputs = ["n_chars", "age", *extra, *ones]
        model = NetMembers.fit(train_part(wide), inputs, "rating", SETUPS[setup], unscaled=ones, rounds=5)
        k = len(model.members)
        scored = model.score(_test_part(wide))
        summary = ens.clamped_summary(k) if model.config.clamp else ens.summary_columns(k)
        one = ev.regression_metrics(scored.withColumns(summary), "rating", std="pred_std_pop")
        one = one.withColumn("experiment", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("shap_values_mlp")
def shap_values_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHAP values of the neural ensemble for every rated test row."""
    model, df = fitted_net(spark, sf_dir, "bootstrap")
    background = shap.collect_background(sp.background_sample(train_part(df), BACKGROUND_ROWS), _INPUTS)
    explained = shap.shap_in_batches(_test_part(df), background, _INPUTS, model.predict)
    return shap.beeswarm_points(explained, _INPUTS)


@query("lime_explain_mlp")
def lime_explain_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIME lines of the neural ensemble for every rated test row."""
    model, df = fitted_net(spark, sf_dir, "decay")
    k = len(model.members)
    bins = lime.QuartileBins.fit(train_part(df), _INPUTS)
    drawn = lime.draw_bins(bins)
    f = lime.score_samples(spark, bins, drawn, model.score, k)
    local = lime.lime_explain(model.score(_test_part(df)), bins, drawn, f, k, keep=_INPUTS)
    rows = lime.with_rules(local, bins, "coefficients")
    return lime.explanation_table(rows, _INPUTS, _INPUTS, integers=THEMES)


@query("lime_continuous_mlp")
def lime_continuous_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIME lines of the neural ensemble for every rated test row, each from continuous perturbations of its own."""
    model, df = fitted_net(spark, sf_dir, "decay", epochs=60)
    bins = lime.QuartileBins.fit(train_part(df), _INPUTS)
    local = lime.lime_continuous(_test_part(df), bins, model.predict, CONTINUOUS_SAMPLES, keep=_INPUTS)
    return lime.explanation_table(lime.with_rules(local, bins, "coefficients"), _INPUTS, _INPUTS, integers=THEMES)
