"""Result tables: quoted CSV, predictions, run summaries, splits, feature lists and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.session import local_table


def write_quoted_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every field quoted, quotes doubled, header on; ``read_csv`` gives the same values back
    (null and empty text both come back as null)."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True)
     .option("quote", '"').option("escape", '"').csv(path))


def predictions_table(scored: DataFrame, target: str, mean: str = "pred_mean",
                      std: str = "pred_std_pop", key: str = "row_key") -> DataFrame:
    """``(row_key, y_true, y_pred_mean, y_pred_std)`` in key order."""
    return scored.select(key, F.col(target).alias("y_true"), F.col(mean).alias("y_pred_mean"),
                         F.col(std).alias("y_pred_std")).orderBy(key)


def run_summary(metrics: DataFrame, experiment: str, n_members: int, note: str = "") -> DataFrame:
    """One row per run from a metrics row with ``n_train`` and ``n_test``."""
    return metrics.select(
        F.lit(experiment).alias("experiment"),
        (F.col("n_train") + F.col("n_test")).alias("rows_used"),
        F.col("n_train").alias("train_size"), F.col("n_test").alias("test_size"),
        F.lit(n_members).cast("bigint").alias("n_members"),
        "mae", "rmse", "r2", F.lit(note).alias("note"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_run(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").parquet(path)


def audit_row(roles: DataFrame, target: str, rows_used: Column | int) -> DataFrame:
    """The column-role lists as one JSON text."""
    def names(role: str) -> Column:
        picked = F.collect_list(F.when(F.col("role") == role, F.struct("position", "column")))
        return F.transform(F.sort_array(picked), lambda s: s["column"])

    rows = F.lit(rows_used) if isinstance(rows_used, int) else rows_used
    lists = roles.agg(
        names("numeric").alias("baseline_numeric"), names("categorical").alias("baseline_categorical"),
        names("theme").alias("thematic_cols"), names("text").alias("excluded_text_cols"))
    return lists.select(F.to_json(F.struct(
        rows.cast("bigint").alias("rows_used"), F.lit(target).alias("target_col"),
        "baseline_numeric", "baseline_categorical", "thematic_cols", "excluded_text_cols")).alias("audit"))


def write_split(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``(row_key, split)``, one folder per split so that a reader of one part skips the other."""
    split.write.mode(mode).partitionBy("split").parquet(path)


def selected_features(spark: SparkSession, raw: Sequence[str], shown: Mapping[str, str],
                      derived: Sequence[str]) -> DataFrame:
    """``(position, raw_feature_name, display_feature_name, feature_type)`` for a chosen feature list."""
    rows = [(i, name, shown[name],
             "LLM-derived feature" if name in derived else "Original dataset feature")
            for i, name in enumerate(raw)]
    return local_table(
        spark, rows, "position int, raw_feature_name string, display_feature_name string, feature_type string")


def write_model(params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    params.write.mode(mode).parquet(path)
