"""Permutation SHAP values of many rows against a small background sample.

A row's features are put in an order drawn from its key. Features are then taken from the row one
after the other, in that order and in the reverse order, the rest coming from each background row;
a feature's value is the mean change of the prediction at its two turns.

Both plans below give the same numbers. Neither compares rows with each other: the background is a
sample whose size is a parameter, carried inside the plan. What a row gets depends on its values and
its order alone, so ``shap_by_join`` scores each such pair once, however many rows have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.fixed_values import SEED
from glosswork.operators.ensemble import PREDS, member_mean
from glosswork.session import materialize
from glosswork.sources.csv import column

_ROWS_PER_STEP = 200_000


def feature_order(features: Sequence[str], key: str, seed: object = SEED) -> Column:
    """Feature positions in the order in which a row's features are taken."""
    drawn = [F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{f}:{seed}"))).alias("h"),
                      F.lit(i).alias("i")) for i, f in enumerate(features)]
    return F.transform(F.array_sort(F.array(*drawn)), lambda s: s["i"])


def collect_background(background: DataFrame, features: Sequence[str]) -> np.ndarray:
    """The background sample as a matrix; a sample of fixed size, so it is safe on the driver."""
    rows = background.select(*[column(f).cast("double") for f in features]).collect()
    return np.array([list(r) for r in rows], dtype=float)


def _pair(features: Sequence[str], key: str, seed: object) -> list[Column]:
    """A row's values and the order in which they are taken."""
    return [F.array(*[column(f).cast("double") for f in features]).alias("_x"), feature_order(features, key, seed).alias("_order")]


def solved_pairs(df: DataFrame, background: np.ndarray, features: Sequence[str],
                 score: Callable[[DataFrame], DataFrame], k: int, key: str = "row_key",
                 seed: object = SEED) -> DataFrame:
    """``(_x, _order, phis, base_value, prediction)``: each distinct pair of values and order, solved once.

    Pairs are reduced before their only exchange, and every later grouping finds its rows in place.
    With features of few values the table has a size of its own, whatever the number of rows."""
    m = len(features)
    pairs = df.select(*_pair(features, key, seed)).distinct()
    distinct, times = np.unique(background, axis=0, return_counts=True)   # equal rows are scored once
    around = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in b]).alias("b"), F.lit(int(n)).alias("n"))
                       for b, n in zip(distinct, times)])
    states = pairs.select("_x", "_order", F.explode(F.sequence(F.lit(0), F.lit(2 * m - 1))).alias("_s"))
    against = states.select("_x", "_order", "_s", F.inline(around).alias("_b", "_n"))

    def from_row(i: int) -> Column:
        turn = F.array_position("_order", i) - 1
        return F.when(F.col("_s") <= m, turn < F.col("_s")).otherwise(turn >= 2 * m - F.col("_s"))

    mixed = against.select("_x", "_s", "_order", "_n", *[
        F.when(from_row(i), F.col("_x")[i]).otherwise(F.col("_b")[i]).alias(f) for i, f in enumerate(features)])
    means = (score(mixed).groupBy("_x", "_order", "_s").agg((
        F.sum(F.col("_n") * member_mean(F.col(PREDS), k)) / F.lit(len(background))).alias("_v"))
             .groupBy("_x", "_order").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_v"))).alias("_v")))
    v = lambda s: F.element_at("_v", s)

    def back(t: Column) -> Column:
        return v(F.when(t == 0, F.lit(0)).when(t == m, F.lit(m)).otherwise(t + m))

    def phi(i: Column) -> Column:
        turn = (F.array_position("_order", i) - 1).cast("int")
        return (v(turn + 1) - v(turn) + back(m - turn) - back(m - turn - 1)) / 2

    phis = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), phi)
    return means.select("_x", "_order", phis.alias("phis"), v(F.lit(0)).alias("base_value"), v(F.lit(m)).alias("prediction"))


def shap_by_join(df: DataFrame, background: np.ndarray, features: Sequence[str],
                 score: Callable[[DataFrame], DataFrame], k: int, key: str = "row_key",
                 seed: object = SEED) -> DataFrame:
    """``(row_key, xs, phis, base_value, prediction)`` with any scorer that works on DataFrames.

    The solved pairs are written, so their size is known: while they are few, rows meet them where
    they are, and nothing that grows with the rows is exchanged. Beyond that the same join moves each
    row once."""
    solved = materialize(solved_pairs(df, background, features, score, k, key, seed), "solved")
    rows = df.select(key, *_pair(features, key, seed))
    return rows.join(solved, ["_x", "_order"]).select(key, F.col("_x").alias("xs"), "phis", "base_value", "prediction")


def shap_block(x: np.ndarray, order: np.ndarray, background: np.ndarray, times: np.ndarray,
               predict: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values ``(rows, features)`` and state means ``(rows, 2 * features)`` of a block of rows.

    ``background`` holds distinct rows and ``times`` how often each occurs."""
    n, m = x.shape
    turn = np.argsort(order, axis=1)                        # position of each feature in the order
    s = np.arange(2 * m)[None, :, None]
    t = turn[:, None, :]
    own = np.where(s <= m, t < s, t >= 2 * m - s)           # rows x states x features
    mixed = np.where(own[:, :, None, :], x[:, None, None, :], background[None, None, :, :])
    v = predict(mixed.reshape(-1, m)).mean(axis=0).reshape(n, 2 * m, len(background)) @ (times / times.sum())
    back = np.concatenate([v[:, :1], v[:, m + 1:], v[:, m:m + 1]], axis=1)
    at = np.arange(n)[:, None]
    phi = (v[at, turn + 1] - v[at, turn] + back[at, m - turn] - back[at, m - turn - 1]) / 2
    return phi, v


def shap_in_batches(df: DataFrame, background: np.ndarray, features: Sequence[str],
                    predict: Callable[[np.ndarray], np.ndarray], key: str = "row_key",
                    seed: object = SEED) -> DataFrame:
    """The same table with a scorer on number blocks: one pass over the rows.

    A row costs thousands of predictions, so the rows are first spread evenly over all cores; moving
    a row once is nothing against that, and no later step shuffles."""
    m, key_type = len(features), df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(np.unique(background, axis=0, return_counts=True))
    step = max(1, _ROWS_PER_STEP // (2 * m * max(1, len(background))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, times = shared.value
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.iloc[at:at + step]
                x = rows.iloc[:, 2:].to_numpy(float)
                phi, v = shap_block(x, np.stack(rows["_order"].to_list()), sample, times, predict)
                yield pd.DataFrame({key: rows[key].to_numpy(), "xs": list(x), "phis": list(phi),
                                    "base_value": v[:, 0], "prediction": v[:, m]})

    rows = df.select(key, feature_order(features, key, seed).alias("_order"),
                     *[column(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    session = df.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, key).mapInPandas(run, f"`{key}` {key_type}, xs array<double>, phis array<double>, base_value double, prediction double")


def long_attributions(explained: DataFrame, features: Sequence[str], key: str = "row_key") -> DataFrame:
    """``(row_key, feature, phi)``: one line per row and feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("phis")[i].alias("phi"))
                      for i, f in enumerate(features)])
    return explained.select(key, F.inline(pairs))


def beeswarm_points(explained: DataFrame, features: Sequence[str], key: str = "row_key") -> DataFrame:
    """``(row_key, feature, value, phi)`` of all explained rows; the values travel with them."""
    triples = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("xs")[i].alias("value"),
                                 F.col("phis")[i].alias("phi")) for i, f in enumerate(features)])
    return explained.select(key, F.inline(triples))


def waterfall_steps(explained: DataFrame, features: Sequence[str], key: str = "row_key",
                    digits: int = 9) -> DataFrame:
    """``(row_key, step, feature, phi, start, end)``: from the base value to the prediction, smallest
    attribution first, ties by name. A row's steps are built inside the row: no window, no shuffle."""
    m = len(features)
    bars = F.array_sort(F.array(*[F.struct(
        F.abs(F.round(F.col("phis")[i], digits)).alias("size"), F.lit(f).alias("feature"),
        F.col("phis")[i].alias("phi")) for i, f in enumerate(features)]))
    ordered = explained.select(key, "base_value", bars.alias("_bars"))
    phi = [F.col("_bars")[i]["phi"] for i in range(m)]
    level, steps = F.col("base_value"), []
    for i in range(m):
        after = level + phi[i]
        steps.append(F.struct(F.lit(i + 1).alias("step"), F.col("_bars")[i]["feature"].alias("feature"),
                              phi[i].alias("phi"), level.alias("start"), after.alias("end")))
        level = after
    return ordered.select(key, F.inline(F.array(*steps)))
