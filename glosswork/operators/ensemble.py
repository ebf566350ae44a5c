"""Ensemble members fitted from grouped sums: cell means and linear models; and member summaries.

The members of an ensemble are columns, not rows: one pass fits all of them, one pass scores all of
them, and their mean, spread, interval and band shares are row expressions that need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.fixed_values import MEMBER_SALTS
from glosswork.functions.hashing import poisson_weight
from glosswork.functions.numeric import clamp
from glosswork.session import materialize
from glosswork.sources.csv import column

PREDS = "preds"


def bootstrap_weights(key: str = "row_key", members: Sequence[int] = MEMBER_SALTS) -> dict[int, Column]:
    """One Poisson(1) weight per member: how often its bootstrap sample holds the row."""
    return {m: poisson_weight(key, m) for m in members}


def equal_weights(members: Sequence[int] = MEMBER_SALTS) -> dict[int, Column]:
    return {m: F.lit(1) for m in members}


# ---- summaries of the member predictions ------------------------------------------------------------------

def _items(preds: Column, k: int) -> list[Column]:
    return [F.get(preds, F.lit(i)) for i in range(k)]


def _total(items: Sequence[Column]) -> Column:
    out = items[0]
    for item in items[1:]:
        out = out + item
    return out


def member_mean(preds: Column, k: int) -> Column:
    return _total(_items(preds, k)) / F.lit(k)


def member_std(preds: Column, k: int, sample: bool = False) -> Column:
    """Spread over members: population form, or sample form (0 for a single member)."""
    if k == 1:
        return preds[0] * 0.0
    mean = member_mean(preds, k)
    squares = _total([(p - mean) * (p - mean) for p in _items(preds, k)])
    return F.sqrt(squares / F.lit(k - 1 if sample else k))


def member_quantile(preds: Column, k: int, p: float) -> Column:
    """Linear-interpolated percentile over members."""
    ordered = F.sort_array(preds)
    h = p * (k - 1)
    low = int(h)
    if low + 1 >= k:
        return ordered[k - 1]
    return ordered[low] + F.lit(h - low) * (ordered[low + 1] - ordered[low])


def band_share(preds: Column, k: int, low: float | None, high: float | None) -> Column:
    """Share of members with low <= prediction < high."""
    hits = []
    for p in _items(preds, k):
        test = F.lit(True)
        if low is not None:
            test = test & (p >= F.lit(low))
        if high is not None:
            test = test & (p < F.lit(high))
        hits.append(test.cast("double"))
    return _total(hits) / F.lit(k)


def clamp_members(preds: Column, k: int) -> Column:
    """Each member limited before anything is averaged: the mean of clamped is not the clamped mean."""
    return F.array(*[clamp(p) for p in _items(preds, k)])


def summary_columns(k: int, preds: Column | None = None) -> dict[str, Column]:
    p = F.col(PREDS) if preds is None else preds
    return {
        "pred_mean": member_mean(p, k),
        "pred_std_pop": member_std(p, k),
        "pred_std_samp": member_std(p, k, sample=True),
        "pred_low": member_quantile(p, k, 0.025),
        "pred_high": member_quantile(p, k, 0.975),
        "share_lt_3": band_share(p, k, None, 3.0),
        "share_3_to_4": band_share(p, k, 3.0, 4.0),
        "share_ge_4": band_share(p, k, 4.0, None),
    }


def clamped_summary(k: int) -> dict[str, Column]:
    limited = clamp_members(F.col(PREDS), k)
    return {"pred_mean": clamp(member_mean(limited, k)), "pred_std_pop": member_std(limited, k)}


def long_predictions(scored: DataFrame, members: Sequence[int], key: str = "row_key") -> DataFrame:
    """``(row_key, member, pred)``."""
    return (scored.select(key, F.posexplode(PREDS).alias("_i", "pred"))
            .select(key, F.element_at(F.array(*[F.lit(m) for m in members]), F.col("_i") + 1).alias("member"), "pred"))


# ---- cell means ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class CellMeans:
    """Weighted target mean per combination of cell columns and member; the member's overall mean
    where it saw no row of the cell. ``params`` is a written table with one row per cell."""
    params: DataFrame
    cells: tuple[str, ...]
    members: tuple[int, ...]
    overall: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, cells: Sequence[str], target: str,
            weights: Mapping[int, Column] | None = None) -> CellMeans:
        weights = bootstrap_weights() if weights is None else weights
        members, y = tuple(weights), column(target)
        sums = []
        for i, m in enumerate(members):
            sums += [F.sum(weights[m]).cast("double").alias(f"w{i}"),
                     F.sum(weights[m] * y).cast("double").alias(f"s{i}")]
        table = materialize(train.groupBy(*cells).agg(*sums), "cell-means")
        totals = table.agg(*[(F.sum(f"s{i}") / F.sum(f"w{i}")).alias(f"g{i}") for i in range(len(members))]).first()
        return cls(table, tuple(cells), members, tuple(totals))

    def means(self) -> DataFrame:
        """Cells with the array of member means; null for a member without rows there."""
        k = range(len(self.members))
        return self.params.select(*self.cells, F.array(*[
            F.when(F.col(f"w{i}") > 0, F.col(f"s{i}") / F.col(f"w{i}")) for i in k]).alias("_means"))

    def long_params(self) -> DataFrame:
        """``(cells…, member, weight, mean)``."""
        rows = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"w{i}").alias("weight"),
                                  F.when(F.col(f"w{i}") > 0, F.col(f"s{i}") / F.col(f"w{i}")).alias("mean"))
                         for i, m in enumerate(self.members)])
        return self.params.select(*self.cells, F.inline(rows))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the member predictions. The size of the written parameters decides whether the join
        broadcasts them. Null cell values match each other."""
        right = self.means().toDF(*[f"_c{i}" for i in range(len(self.cells))], "_means")
        test = F.lit(True)
        for i, c in enumerate(self.cells):
            test = test & column(c).eqNullSafe(F.col(f"_c{i}"))
        joined = df.join(right, test, "left")
        preds = F.array(*[F.coalesce(F.get("_means", F.lit(i)), F.lit(g)) for i, g in enumerate(self.overall)])
        return joined.select(*[column(c) for c in df.columns], preds.alias(PREDS))


# ---- linear members ------------------------------------------------------------------------------------------

JVM_TERMS = 40
_ONE = "_intercept"


def _gram_terms(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def weighted_gram(df: DataFrame, features: Mapping[str, Column], target: Column,
                  weights: Mapping[int, Column]) -> DataFrame:
    """``(member, i, j, value)``: weighted sums of products of the intercept, the features and the
    target (named ``_target``), for all members in one aggregate without grouping keys.

    Few terms are plain sums inside code generation. Many terms go through Arrow batches and matrix
    products, which return one small block of sums per task: measured on 600,000 rows and 105 terms
    that takes half the time, mostly because no huge aggregate has to be compiled.
    """
    columns = {_ONE: F.lit(1.0), **features, "_target": target}
    names = list(columns)
    pairs, members = _gram_terms(names), list(weights)
    base = df.select(*[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)],
                     *[weights[m].cast("double").alias(f"w{i}") for i, m in enumerate(members)])
    if len(pairs) * len(members) <= JVM_TERMS:
        sums = base.agg(*[F.sum(F.col(f"w{a}") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{a}_{i}_{j}")
                          for a in range(len(members)) for i, j in pairs])
        cells = [F.struct(F.lit(m).alias("member"), F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"),
                          F.col(f"g{a}_{i}_{j}").alias("value"))
                 for a, m in enumerate(members) for i, j in pairs]
        return sums.select(F.inline(F.array(*cells)))
    p, k = len(names), len(members)
    blocks = base.mapInPandas(lambda batches: gram_blocks(batches, p, k), "a int, i int, j int, value double")
    summed = blocks.groupBy("a", "i", "j").agg(F.sum("value").alias("value"))
    name_of = F.array(*[F.lit(n) for n in names])
    return summed.select(
        F.element_at(F.array(*[F.lit(m) for m in members]), F.col("a") + 1).alias("member"),
        F.element_at(name_of, F.col("i") + 1).alias("i"), F.element_at(name_of, F.col("j") + 1).alias("j"), "value")


def gram_blocks(batches, p: int, k: int):
    """Sum the weighted products of a task's rows; one block of sums per task."""
    import pandas as pd
    total = np.zeros((k, p, p))
    for batch in batches:
        x, w = batch.iloc[:, :p].to_numpy(float), batch.iloc[:, p:].to_numpy(float)
        for a in range(k):
            total[a] += (x * w[:, [a]]).T @ x
    i, j = np.triu_indices(p)
    yield pd.DataFrame({"a": np.repeat(np.arange(k), len(i)), "i": np.tile(i, k), "j": np.tile(j, k),
                        "value": total[:, i, j].ravel()}).astype({"a": "int32", "i": "int32", "j": "int32"})


@dataclass(frozen=True)
class LinearMembers:
    """Least-squares members: ``coefficients[member] = (intercept, one per feature)``."""
    features: tuple[str, ...]
    members: tuple[int, ...]
    coefficients: np.ndarray

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], target: str,
            weights: Mapping[int, Column] | None = None) -> LinearMembers:
        """Normal equations of all members from one aggregate; the driver solves systems whose size
        is the number of features, whatever the number of rows. Features should be on similar scales."""
        weights = bootstrap_weights() if weights is None else weights
        rows = weighted_gram(train, {f: column(f) for f in features}, column(target), weights).collect()
        names = [_ONE, *features, "_target"]
        at = {n: i for i, n in enumerate(names)}
        solved = []
        for m in weights:
            gram = np.zeros((len(names), len(names)))
            for r in rows:
                if r["member"] == m:
                    gram[at[r["i"]], at[r["j"]]] = gram[at[r["j"]], at[r["i"]]] = r["value"]
            solved.append(np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=1e-12)[0])
        return cls(tuple(features), tuple(weights), np.array(solved))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the member predictions as column expressions."""
        preds = []
        for beta in self.coefficients:
            value = F.lit(float(beta[0]))
            for f, b in zip(self.features, beta[1:]):
                value = value + F.lit(float(b)) * column(f)
            preds.append(value)
        return df.withColumn(PREDS, F.array(*preds))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Member predictions ``(members, rows)`` of a numeric block."""
        return (self.coefficients[:, 1:] @ x.T) + self.coefficients[:, :1]

    def params_rows(self) -> list[tuple[int, int, str, list[float]]]:
        return [(m, 0, "linear", [float(b) for b in beta]) for m, beta in zip(self.members, self.coefficients)]
