"""Queries that hold trained models against what must be true of any right result, so that plain SQL can state it.

The fits themselves are beyond SQL; their normal equations, sums and shapes are not."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import BACKGROUND_ROWS, MEMBER_SALTS
from glosswork.operators import ensemble as ens
from glosswork.operators import features as feat
from glosswork.operators import shap
from glosswork.operators import split as sp
from glosswork.operators.model_store import load_model, save_model
from glosswork.operators.neural import SETUPS, layer_shapes
from glosswork.plans.explaining import _INPUTS, _imputed, _test_part, fitted_net, train_part
from glosswork.plans.registry import query
from glosswork.session import scratch_path
from glosswork.sources.csv import column

_LISTED = ", ".join(f"'{name}'" for name in ["1", *_INPUTS])
_SEEDS = ", ".join(map(str, SETUPS["bootstrap"].seeds))


@query("linear_normal_equations", f"""
select cast(m as int) as member, f as feature, true as holds
from (select unnest([{', '.join(map(str, MEMBER_SALTS))}]) as m), (select unnest([{_LISTED}]) as f)""")
def linear_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted residuals of every linear member are orthogonal to the constant and to each input."""
    df = _imputed(spark, sf_dir)
    train = train_part(feat.Scaler.fit(train_part(df), _INPUTS).transform(df))
    scored = ens.LinearMembers.fit(train, _INPUTS, "rating").score(train)
    inputs = {"1": F.lit(1.0), **{f: column(f).cast("double") for f in _INPUTS}}
    rows = []
    for i, (member, weight) in enumerate(ens.bootstrap_weights().items()):
        for name, x in inputs.items():
            part = weight * x * (F.col("rating") - F.col(ens.PREDS)[i])
            # beside the size of what is added up, as in any sum of doubles
            holds = F.abs(F.sum(part)) <= 1e-9 * (1 + F.sum(weight * F.abs(x) * F.abs(F.col("rating"))))
            rows.append(F.struct(F.lit(member).cast("int").alias("member"), F.lit(name).alias("feature"), holds.alias("holds")))
    return scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("training_history_falls", f"""
select cast(unnest([{_SEEDS}]) as int) as member, cast({SETUPS['bootstrap'].epochs} as bigint) as epochs, 1 as first, {SETUPS['bootstrap'].epochs} as last, true as falls""")
def training_history_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member has a loss for each epoch, and ends below where it began."""
    model, _ = fitted_net(spark, sf_dir, "bootstrap")
    ends = F.max_by("loss", "epoch") < F.max_by("loss", -F.col("epoch"))
    return model.history_table(spark).groupBy("member").agg(
        F.count_distinct("epoch").alias("epochs"), F.min("epoch").alias("first"), F.max("epoch").alias("last"), ends.alias("falls"))


_SHAPES = layer_shapes(len(_INPUTS), SETUPS["decay"].hidden)


@query("net_weight_shapes", " union all ".join(
    f"select cast({seed} as int) as member, {i} as layer, '{kind}' as kind, {size} as size, true as finite"
    for seed in SETUPS["decay"].seeds for i, (a, b) in enumerate(_SHAPES) for kind, size in (("weights", a * b), ("bias", b))))
def net_weight_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored weights of every member and layer: as many as the network has, and all finite."""
    model, _ = fitted_net(spark, sf_dir, "decay")
    finite = F.forall("weights", lambda w: ~F.isnan(w) & (F.abs(w) < float("inf")))
    return model.table(spark).select("member", "layer", "kind", F.size("weights").alias("size"), finite.alias("finite"))


@query("net_scores_consistent", "select row_key, split, true as ordered, true as whole, true as spread from rated")
def net_scores_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rated row's neural scores: the interval holds the mean, the band shares add up to one, members differ."""
    model, df = fitted_net(spark, sf_dir, "bootstrap")
    scored = model.score(df).withColumns(ens.summary_columns(len(model.members)))
    shares = [c for c in scored.columns if c.startswith("share_")]
    return scored.select("row_key", "split", F.col("pred_mean").between(
        F.col("pred_low"), F.col("pred_high")).alias("ordered"), (F.abs(sum(map(F.col, shares)) - 1) < 1e-12).alias("whole"),
        (F.col("pred_std_pop") > 0).alias("spread"))


@query("net_shap_additive", "select row_key, true as adds_up, true as is_the_score from rated where split = 'test'")
def net_shap_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every rated test row the values and the base add up to the prediction, which is the mean of its members' scores."""
    model, df = fitted_net(spark, sf_dir, "bootstrap")
    background = shap.collect_background(sp.background_sample(train_part(df), BACKGROUND_ROWS), _INPUTS)
    test = _test_part(df)
    explained = shap.shap_in_batches(test, background, _INPUTS, model.predict)
    total = F.aggregate("phis", F.col("base_value"), lambda so_far, phi: so_far + phi)
    means = model.score(test).select("row_key", (F.aggregate(ens.PREDS, F.lit(0.0), lambda a, b: a + b) / F.size(ens.PREDS)).alias("mean"))
    return explained.join(means, "row_key").select("row_key", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"), (
        F.abs(F.col("mean") - F.col("prediction")) < 1e-4).alias("is_the_score"))


@query("model_roundtrip", "select row_key, split, cast(2 as int) as version, true as same_scores from rated")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored model, loaded as the newest of two versions, scores every rated row as the one that was trained."""
    model, df = fitted_net(spark, sf_dir, "bootstrap")
    path = scratch_path(spark, "models")
    save_model(spark, replace(model, flat=model.flat * 0), path)
    save_model(spark, model, path)
    stored = load_model(spark, path)
    both = stored.score(model.score(df).withColumnRenamed(ens.PREDS, "trained"))
    return both.select("row_key", "split", F.lit(stored.version).alias("version"), (F.col("trained") == F.col(ens.PREDS)).alias("same_scores"))
