"""Whole jobs over review files: code themes, run an experiment, explain a model.

Each job reads files, works on DataFrames and writes result tables below an output folder. The row
limits default to none; pass ``first_rows=2000`` for the usual small study.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import (
    BACKGROUND_ROWS, CODEBOOK, METADATA_COLUMNS, PERTURBATIONS, SEED, TOP_DERIVED_FEATURES,
)
from glosswork.functions import names
from glosswork.operators import coding, lime, shap
from glosswork.operators import ensemble as ens
from glosswork.operators import evaluate as ev
from glosswork.operators import features as feat
from glosswork.operators import split as sp
from glosswork.operators.model_store import load_model, save_model
from glosswork.operators.neighbours import neighbour_information
from glosswork.operators.neural import SETUPS, NetConfig, NetMembers, indicators, known_categories
from glosswork.session import materialize, scratch_path
from glosswork.sources import sinks
from glosswork.sources.csv import (
    dense_position, infer_types, read_csv_tolerant, require_columns, with_file_position,
)
from glosswork.streaming.theme_stream import coded_rows

ROW_KEY = "row_key"
POSITION = "row_position"


def load_reviews(spark: SparkSession, path: str | list[str], first_rows: int | None = None,
                 multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Typed review rows with their position in the files, and the lines set aside as broken.

    The first rows are taken in file order and before anything is filtered."""
    read = read_csv_tolerant(spark, path, multi_line=multi_line)
    keyed = with_file_position(read.rows, ROW_KEY)
    if first_rows is not None:
        keyed = keyed.where(F.col(ROW_KEY) < first_rows)
    return infer_types(keyed), read.bad_lines


# ---- theme coding -------------------------------------------------------------------------------------

def coding_job(spark: SparkSession, path: str | list[str], out: str, labeller: coding.TextLabeller,
               title: str = "Title", review: str = "Review Text", codebook: Mapping[str, str] = CODEBOOK,
               first_rows: int | None = None, max_chars: int | None = None,
               retry: Sequence[str] = (), key: str | None = None, commits: int = 8) -> DataFrame:
    """Code the rows that have no result yet, then write the whole table as quoted CSV.

    ``out/coded`` is the record of progress: a second run labels only what is missing there, and what
    has a status in ``retry``; the newest result of a row counts. The missing rows are coded in
    ``commits`` parts, each one folder that is kept when a later part fails.

    A result belongs to the text that was coded, so files may be added, removed or reordered between
    runs, an edited review is coded again, and equal texts are labelled once. With ``key``, a column of
    unique values, a result belongs to that value instead (rows without one go by their text). The
    returned table has that identity as ``row_key`` and the place in the files as ``row_position``.
    Lines with too many fields go to ``out/bad-lines``.
    """
    df, bad = load_reviews(spark, path, first_rows)
    df = df.withColumnRenamed(ROW_KEY, POSITION)
    df = df.withColumn(ROW_KEY, review_identity(df, title, review, key))
    themes = list(codebook)
    before = coded_rows(spark, f"{out}/coded")
    rows = df if before is None else coding.pending_rows(df, latest_codes(before), ROW_KEY, retry)
    run = 0 if before is None else before.agg(F.max("run")).first()[0] + 1
    fields = [F.col(f"`{c}`") for c in (title, review) if c in df.columns]
    parted = rows.select(ROW_KEY, *fields).dropDuplicates([ROW_KEY]).withColumn(
        "_part", F.pmod(F.xxhash64(ROW_KEY), F.lit(commits)))
    pending = scratch_path(spark, "pending")
    parted.write.partitionBy("_part").parquet(pending)
    waiting = spark.read.schema(parted.schema).parquet(pending)
    for part in range(commits):
        coded = coding.code_themes(waiting.where(F.col("_part") == part).drop("_part"), labeller, themes, ROW_KEY,
                                   title=title, review=review, codebook=codebook, max_chars=max_chars)
        coded.write.mode("overwrite").parquet(f"{out}/coded/run={run + part}")
    full = coding.write_back(df, latest_codes(spark.read.parquet(f"{out}/coded")), themes, ROW_KEY)
    sinks.write_quoted_csv(full.drop(ROW_KEY, POSITION), f"{out}/reviews-csv/run={run}")
    bad.write.json(f"{out}/bad-lines/run={run}")
    return full


def review_identity(df: DataFrame, title: str, review: str, key: str | None = None) -> Column:
    """What a result belongs to: a digest of title and review, or the text of ``key`` where there is one."""
    parts = [F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string") for c in (title, review)]
    digest = F.sha2(F.to_json(F.array(*parts)), 256)
    return digest if key is None else F.coalesce(F.concat(F.lit("key:"), F.col(f"`{key}`").cast("string")), digest)


def latest_codes(coded: DataFrame) -> DataFrame:
    """The newest result of every row."""
    others = [c for c in coded.columns if c != ROW_KEY]
    newest = coded.groupBy(ROW_KEY).agg(F.max_by(F.struct(*others), "run").alias("r"))
    return newest.select(ROW_KEY, *[F.col("r")[c].alias(c) for c in others if c != "run"])


# ---- experiments --------------------------------------------------------------------------------------

def experiment_job(spark: SparkSession, path: str | list[str], out: str, target: str = "Rating",
                   themes: bool = True, setup: NetConfig | None = None, first_rows: int | None = None,
                   split: DataFrame | None = None, rounds: int = 5, rows_per_block: int = 50_000,
                   impute: bool = True, experiment: str = "") -> DataFrame:
    """Ensemble regression of the target from plain columns, with or without theme columns.

    Writes roles, split, model, predictions and summary, and returns the summary row. Give the split
    table of another run to compare both on the same rows. Without ``impute`` a missing number stops
    the job.
    """
    config = setup or SETUPS["tabular_clamped" if themes else "tabular"]
    df, bad = load_reviews(spark, path, first_rows)
    df = feat.drop_missing_target(require_columns(df, [target]), target, on_error="raise")
    facts = feat.column_facts(df, skip=[ROW_KEY])
    roles = feat.experiment_roles(facts, target, themes)
    role_table = feat.roles_table(df, roles)
    role_table.write.parquet(f"{out}/roles")
    sinks.audit_row(role_table, target, facts[target].non_null).write.text(f"{out}/audit")
    bad.write.json(f"{out}/bad-lines")

    numeric, theme = feat.with_role(roles, "numeric"), feat.with_role(roles, "theme")
    categorical = feat.with_role(roles, "categorical")
    df = feat.zero_filled(df.select(ROW_KEY, target, *[F.col(f"`{c}`") for c in [*numeric, *theme, *categorical]]), theme)
    df = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in numeric})
    parted = sp.apply_split(df, split, ROW_KEY) if split is not None else sp.exact_split(df, ROW_KEY)
    parted = materialize(parted, "parted")
    sinks.write_split(sp.split_table(parted, ROW_KEY), f"{out}/split")
    train = parted.where(F.col("split") == "train")

    imputer = feat.Imputer.fit(train, numeric) if impute and numeric else feat.Imputer({})
    parted = imputer.transform(parted)
    known = known_categories(feat.category_vocabulary(train, categorical)) if categorical else []
    ones = list(indicators(known))
    parted = parted.withColumns(indicators(known)) if known else parted
    train = parted.where(F.col("split") == "train")
    model = NetMembers.fit(train, [*numeric, *theme, *ones], target, config, ROW_KEY, ones, rounds, rows_per_block)
    save_model(spark, model, f"{out}/model", imputer.fill, theme, known)
    model.history_table(spark).write.parquet(f"{out}/history")

    k = len(model.members)
    summary = ens.clamped_summary(k) if config.clamp else ens.summary_columns(k)
    scored = materialize(model.score(parted).withColumns(summary).select(
        ROW_KEY, "split", target, "pred_mean", "pred_std_pop"), "scored")
    test = scored.where(F.col("split") == "test")
    sinks.write_quoted_csv(sinks.predictions_table(test, target), f"{out}/predictions")
    result = sinks.run_summary(ev.run_metrics(scored, target), experiment or ("themes" if themes else "baseline"), k)
    sinks.write_json(result, f"{out}/summary")
    sinks.append_run(result, f"{out}/runs")
    return result


def score_job(spark: SparkSession, path: str | list[str], model_path: str, out: str, version: int | None = None,
              first_rows: int | None = None) -> DataFrame:
    """Predictions for new rows by a model that ``experiment_job`` stored (in its folder ``model``), the newest version unless named.

    Gaps are filled and categories looked up as in training; nothing is fitted again, and no target is needed. Writes and returns
    the row position, the members' mean and their spread."""
    stored = load_model(spark, model_path, version)
    df, bad = load_reviews(spark, path, first_rows)
    bad.write.json(f"{out}/bad-lines")
    scored = stored.score(require_columns(df, stored.columns()).select(ROW_KEY, *[F.col(f"`{c}`") for c in stored.columns()]))
    k = len(stored.model.members)
    summary = ens.clamped_summary(k) if stored.model.config.clamp else ens.summary_columns(k)
    result = materialize(scored.withColumns(summary).select(ROW_KEY, "pred_mean", "pred_std_pop"), "scored")
    sinks.write_quoted_csv(result.orderBy(ROW_KEY), f"{out}/predictions")
    return result


# ---- explanations -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Prepared:
    """What both explanation jobs start from."""
    rows: DataFrame
    features: list[str]
    shown: list[str]
    derived: list[str]
    model: NetMembers
    metrics: DataFrame


def prepare_explanation(spark: SparkSession, path: str | list[str], out: str, target: str, config: NetConfig,
                        clean_names: bool, top: int = TOP_DERIVED_FEATURES, fit_on: str = "train",
                        metadata: Sequence[str] = METADATA_COLUMNS, first_rows: int | None = None,
                        rounds: int = 5, rows_per_block: int = 50_000, information: str = "neighbours") -> Prepared:
    """Load, coerce, choose the best derived features, split, train and evaluate.

    ``information`` is how features are compared with the target: by nearest ``neighbours``, or by counts in ``deciles``, which
    needs a single grouped count.

    ``fit_on='train'`` keeps medians and feature choice away from the test rows; ``'all'`` uses every
    row for them.
    """
    df, bad = load_reviews(spark, path, first_rows)
    bad.write.json(f"{out}/bad-lines")
    df = feat.drop_missing_target(require_columns(df, [target]), target)
    df = feat.drop_metadata(df, target, metadata)
    facts = feat.column_facts(df, skip=[ROW_KEY])
    roles = feat.explainer_roles(facts, target, metadata)
    baseline, derived = feat.with_role(roles, "baseline"), feat.with_role(roles, "derived")
    numbers = feat.numeric_columns(df, facts, [*baseline, *derived]).select(
        ROW_KEY, target, *[F.col(f"`{c}`") for c in [*baseline, *derived]])
    # positions are counted after rows without a target are gone
    numbers = dense_position(numbers, ROW_KEY, "position").drop(ROW_KEY).withColumnRenamed("position", ROW_KEY)
    numbers = materialize(sp.exact_split(materialize(numbers, "numbers"), ROW_KEY), "parted")
    basis = numbers if fit_on == "all" else numbers.where(F.col("split") == "train")
    imputer = feat.Imputer.fit(basis, [*baseline, *derived])
    filled, basis = imputer.transform(numbers), imputer.transform(basis)

    if information == "neighbours":
        scores = neighbour_information(basis, ROW_KEY, derived, target)
    elif information == "deciles":
        edges = feat.quantile_edges(basis, [*derived, target])
        binned = {c: feat.bin_index(F.col(f"`{c}`"), edges[c]) for c in derived}
        scores = feat.mutual_information(basis, binned, feat.bin_index(F.col(f"`{target}`"), edges[target]))
    else:
        raise ValueError(f"information is neighbours or deciles, not {information!r}")
    ranking = feat.top_features(scores, top)
    best = [r["feature"] for r in ranking.orderBy("feature_rank").collect()]
    features = [*baseline, *best]
    label = (lambda c: names.clean_display(F.lit(c), F.lit(c in best))) if clean_names else (
        lambda c: names.prefix_display(F.lit(c)))
    shown_row = spark.range(1).select(*[label(c).alias(f"n{i}") for i, c in enumerate(features)]).first()
    shown = feat.unique_name_list(list(shown_row))
    sinks.selected_features(spark, features, dict(zip(features, shown)), best).write.parquet(f"{out}/features")

    train = filled.where(F.col("split") == "train")
    model = NetMembers.fit(train, features, target, config, ROW_KEY, (), rounds, rows_per_block)
    save_model(spark, model, f"{out}/model", imputer.fill)
    k = len(model.members)
    scored = model.score(filled).withColumns(ens.summary_columns(k))
    metrics = materialize(ev.run_metrics(scored, target, std="pred_std_pop"), "metrics")
    sinks.write_json(metrics, f"{out}/metrics")
    return Prepared(filled, features, shown, best, model, metrics)


def lime_job(spark: SparkSession, path: str | list[str], out: str, target: str = "Rating",
             positions: Sequence[int] | None = None, config: NetConfig = SETUPS["decay"],
             samples: int = PERTURBATIONS, perturb: str = "means", **options) -> DataFrame:
    """Local explanations with the ensemble's distribution for the rows at ``positions`` (all test rows
    without): ``out/explanations`` has the lines, ``out/distribution`` one row per explained row.

    ``perturb="means"`` shares samples among all rows, each value at its bin's mean; ``"normal"`` draws
    samples for every row, each value from its bin's truncated normal distribution."""
    if perturb not in ("means", "normal"):
        raise ValueError(f"perturb is means or normal, not {perturb!r}")
    p = prepare_explanation(spark, path, out, target, config, clean_names=False, **options)
    if positions is None:
        rows = p.rows.where(F.col("split") == "test")
    else:
        total = p.rows.count()
        outside = [i for i in positions if not 0 <= i < total]
        if outside:
            raise ValueError(f"position(s) {outside} out of range: the table has {total} rows")
        rows = p.rows.where(F.col(ROW_KEY).isin(*positions))
    k = len(p.model.members)
    scored = materialize(p.model.score(rows), "scored")
    scored.select(ROW_KEY, "split", F.col(f"`{target}`").alias("actual"),
                  *[c.alias(n) for n, c in ens.summary_columns(k).items()]).write.parquet(f"{out}/distribution")
    bins = lime.QuartileBins.fit(p.rows.where(F.col("split") == "train"), p.features)
    if perturb == "normal":
        local = lime.lime_continuous(scored, bins, p.model.predict, samples, ROW_KEY, p.features)
    else:
        drawn = lime.draw_bins(bins, samples)
        f = lime.score_samples(spark, bins, drawn, p.model.score, k)
        local = lime.lime_explain(scored, bins, drawn, f, k, ROW_KEY, p.features)
    lines = lime.explanation_table(lime.with_rules(local, bins, "coefficients"), p.features, p.shown, ROW_KEY)
    lines.write.parquet(f"{out}/explanations")
    return spark.read.parquet(f"{out}/explanations")


def shap_job(spark: SparkSession, path: str | list[str], out: str, target: str = "Rating",
             explain_rows: int | None = None, background_rows: int = BACKGROUND_ROWS,
             config: NetConfig = SETUPS["bootstrap"], **options) -> DataFrame:
    """SHAP values of all test rows, or of the first ``explain_rows``: importance,
    points and waterfall steps as tables."""
    p = prepare_explanation(spark, path, out, target, config, clean_names=True, **options)
    train, test = (p.rows.where(F.col("split") == s) for s in ("train", "test"))
    background = shap.collect_background(
        sp.background_sample(train, background_rows, ROW_KEY, SEED), p.features)
    explained = materialize(shap.shap_in_batches(
        sp.explained_rows(test, explain_rows, ROW_KEY), background, p.features, p.model.predict, ROW_KEY), "shap")
    points = shap.beeswarm_points(explained, p.shown, ROW_KEY)
    points.write.parquet(f"{out}/points")
    ev.mean_absolute_attribution(points).write.parquet(f"{out}/importance")
    shap.waterfall_steps(explained, p.shown, ROW_KEY).write.parquet(f"{out}/waterfall")
    return spark.read.parquet(f"{out}/points")
