"""Regression metrics of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(target: Column, pred: Column, std: Column | None = None,
                   weight: Column | None = None, centre: Column | None = None) -> dict[str, Column]:
    """Aggregates for MAE, RMSE, R² and, with ``std``, the mean predictive deviation.

    With ``weight`` a row stands for that many equal rows; then ``centre`` is a number near the
    target's mean, so that squares keep their digits. A constant target gives R² 1 for a perfect
    prediction, else 0.
    """
    w = F.lit(1) if weight is None else weight
    error = target - pred
    n = F.sum(w)
    if weight is None:
        spread = F.var_pop(target) * n               # merged around the mean: no cancellation
    else:
        off = target - (F.lit(0.0) if centre is None else centre)
        spread = F.sum(w * off * off) - F.sum(w * off) * F.sum(w * off) / n
    squares = F.sum(w * error * error)
    out = {
        "n": n.cast("bigint"),
        "mae": F.sum(w * F.abs(error)) / n,
        "rmse": F.sqrt(squares / n),
        "r2": F.when(spread > 0, 1 - squares / spread).otherwise(F.when(squares == 0, 1.0).otherwise(0.0)),
    }
    if std is not None:
        out["mean_std"] = F.sum(w * std) / n
    return out


def regression_metrics(scored: DataFrame, target: str, pred: str = "pred_mean", std: str | None = None,
                       by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Metrics per group. With ``weight`` the weighted mean of each group is found first, one row per group, and the
    squares are taken around it."""
    centre = None
    if weight is not None:
        w, y = F.col(weight), F.col(target)
        mean = (F.sum(w * y) / F.sum(F.when(y.isNotNull(), w))).alias("_centre")
        if by:
            means = scored.groupBy(*by).agg(mean).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_centre")
            same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
            scored, centre = scored.join(means, same, "left"), F.col("_centre")
        else:
            centre = scored.agg(mean).scalar()
    columns = metric_columns(F.col(target), F.col(pred), None if std is None else F.col(std),
                             None if weight is None else F.col(weight), centre)
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])


def split_sizes(df: DataFrame) -> dict[str, Column]:
    return {"n_train": F.count_if(F.col("split") == "train"), "n_test": F.count_if(F.col("split") == "test")}


def run_metrics(scored: DataFrame, target: str, pred: str = "pred_mean", std: str | None = None) -> DataFrame:
    """Test-part metrics and both part sizes in one row, from one pass over all rows."""
    test = F.col("split") == "test"
    masked = scored.select("split", F.when(test, F.col(target)).alias("_y"), F.when(test, F.col(pred)).alias("_p"),
                           *([] if std is None else [F.when(test, F.col(std)).alias("_s")]))
    one = F.when(F.col("_y").isNotNull(), 1)
    n = F.count(one)
    error = F.col("_y") - F.col("_p")
    spread, squares = F.var_pop("_y") * n, F.sum(error * error)
    aggs = {
        **split_sizes(masked),
        "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(spread > 0, 1 - squares / spread).otherwise(F.when(squares == 0, 1.0).otherwise(0.0)),
    }
    if std is not None:
        aggs["mean_std"] = F.avg("_s")
    return masked.agg(*[c.alias(n) for n, c in aggs.items()])


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def mean_absolute_attribution(explained: DataFrame) -> DataFrame:
    """Global importance: mean absolute attribution per feature."""
    return explained.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
