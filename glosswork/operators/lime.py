"""LIME-style local explanations of many rows.

A perturbed sample draws a bin per feature from the training frequencies. That does not depend on the
explained row, so ``lime_explain`` draws and scores the samples once for all rows, each value at its
bin's mean, and a row only compares its own bins with theirs. ``lime_continuous`` gives every row
samples of its own, with values from the bin's truncated normal distribution, and scores them inside
the task. Both are one pass over the rows without a shuffle, and carry along what the table needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.fixed_values import PERTURBATIONS, SEED
from glosswork.functions.names import rule_feature
from glosswork.functions.numeric import sign_class, signed_text, value_text
from glosswork.operators.ensemble import PREDS, member_mean
from glosswork.operators.features import bin_index
from glosswork.operators.percentiles import exact_percentiles
from glosswork.session import local_table
from glosswork.sources.csv import column

_SPAN = 2 ** 32
#: Bytes of remembered sums per task.
_MEMORY = 64 << 20
#: Perturbed samples that are scored at a time.
_STEP = 100_000
# The normal distribution function on a grid; between its points, a value is off by less than 1e-6.
_GRID = np.linspace(-9.0, 9.0, 1 << 13)
_BELOW = np.array([math.erfc(-z / math.sqrt(2)) / 2 for z in _GRID])


@dataclass(frozen=True)
class QuartileBins:
    """Per feature: bin edges, how many training rows each bin holds, and their mean, spread and ends."""
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    counts: tuple[tuple[int, ...], ...]
    means: tuple[tuple[float | None, ...], ...]
    stds: tuple[tuple[float | None, ...], ...]
    least: tuple[tuple[float | None, ...], ...]
    greatest: tuple[tuple[float | None, ...], ...]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str]) -> QuartileBins:
        quartiles = exact_percentiles(train, {f: [0.25, 0.5, 0.75] for f in features})
        edges = {f: tuple(sorted({v for v in q if v is not None})) for f, q in quartiles.items()}
        cells = F.array(*[F.struct(F.lit(i).alias("f"), bin_index(column(f), edges[f]).alias("bin"),
                                   column(f).cast("double").alias("v")) for i, f in enumerate(features)])
        rows = (train.select(F.inline(cells)).groupBy("f", "bin")
                .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                     F.min("v").alias("least"), F.max("v").alias("greatest")).collect())
        found = {(r["f"], r["bin"]): r for r in rows}

        def per_bin(name: str, none: object = None) -> tuple[tuple, ...]:
            return tuple(tuple(found[i, b][name] if (i, b) in found else none for b in range(len(edges[f]) + 1))
                         for i, f in enumerate(features))

        return cls(tuple(features), tuple(edges[f] for f in features), per_bin("n", 0),
                   *[per_bin(name) for name in ("mean", "std", "least", "greatest")])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, b, n, self.means[i][b], self.edges[i][b - 1] if b else None,
                 self.edges[i][b] if b < len(self.edges[i]) else None)
                for i, f in enumerate(self.features) for b, n in enumerate(self.counts[i])]
        return local_table(spark, rows, "feature string, bin int, n bigint, mean double, above double, up_to double")

    def spread_table(self, spark: SparkSession) -> DataFrame:
        """``(feature, bin, std, least, greatest)`` of the bins that hold training rows."""
        rows = [(f, b, self.stds[i][b], self.least[i][b], self.greatest[i][b])
                for i, f in enumerate(self.features) for b, n in enumerate(self.counts[i]) if n]
        return local_table(spark, rows, "feature string, bin int, std double, least double, greatest double")

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each bin of a feature begins and ends; the outer ones at the least and greatest training value."""
        values = [[v for v in side[i] if v is not None] for side in (self.least, self.greatest)]
        ends = (min(values[0], default=np.nan), max(values[1], default=np.nan))
        return np.array([ends[0], *self.edges[i]]), np.array([*self.edges[i], ends[1]])

    def bin_columns(self) -> list[Column]:
        return [bin_index(column(f), self.edges[i]) for i, f in enumerate(self.features)]

    def rule_texts(self) -> list[list[str]]:
        """The condition each bin stands for."""
        out = []
        for f, edges in zip(self.features, self.edges):
            if not edges:
                out.append([f])
                continue
            middle = [f"{a:.2f} < {f} <= {b:.2f}" for a, b in zip(edges[:-1], edges[1:])]
            out.append([f"{f} <= {edges[0]:.2f}", *middle, f"{f} > {edges[-1]:.2f}"])
        return out

    def rule(self, i: int) -> Column:
        texts = F.array(*[F.lit(t) for t in self.rule_texts()[i]])
        return F.element_at(texts, self.bin_columns()[i] + 1)


def draw_bins(bins: QuartileBins, n: int = PERTURBATIONS, seed: object = SEED) -> np.ndarray:
    """Bins ``(n - 1, features)`` of the perturbed samples 1..n-1; sample 0 is the explained row itself.

    The number of samples is a parameter, so this small table is made on the driver."""
    out = np.zeros((n - 1, len(bins.features)), dtype=np.int32)
    for j, f in enumerate(bins.features):
        upper = np.cumsum(bins.counts[j])
        u = np.array([int(hashlib.md5(f"{s}:{f}:{seed}".encode()).hexdigest()[:8], 16) / _SPAN for s in range(1, n)])
        out[:, j] = np.searchsorted(upper, u * upper[-1], side="right")
    return out


def score_samples(spark: SparkSession, bins: QuartileBins, drawn: np.ndarray, score, k: int) -> np.ndarray:
    """Ensemble mean of every perturbed sample, each feature standing at its bin's mean."""
    values = [[bins.means[j][b] for j, b in enumerate(row)] for row in drawn]
    schema = "_id int, " + ", ".join(f"`{f}` double" for f in bins.features)
    table = local_table(spark, [(i, *map(float, v)) for i, v in enumerate(values)], schema)
    rows = score(table).select("_id", member_mean(F.col(PREDS), k).alias("f")).collect()
    out = np.zeros(len(drawn))
    for r in rows:
        out[r["_id"]] = r["f"]
    return out


def local_sums(own: np.ndarray, own_f: np.ndarray, drawn: np.ndarray, f: np.ndarray,
               memory: dict[bytes, np.ndarray]) -> np.ndarray:
    """Weighted sums of products of (1, same-bin indicators, prediction) per row.

    Rows with equal bins share the sums over the perturbed samples; each adds its own sample 0."""
    n, m = own.shape
    out = np.empty((n, m + 2, m + 2))
    width = 0.75 * np.sqrt(m)
    for r in range(n):
        name = own[r].tobytes()
        if name not in memory:
            if (len(memory) + 1) * 8 * (m + 2) ** 2 > _MEMORY:
                memory.clear()
            z = np.ones((len(drawn), m + 2))
            z[:, 1:m + 1] = drawn == own[r]
            z[:, m + 1] = f
            distance2 = m - z[:, 1:m + 1].sum(axis=1)
            memory[name] = (z * np.exp(-distance2 / (2 * width * width))[:, None]).T @ z
        first = np.ones(m + 2)
        first[m + 1] = own_f[r]
        out[r] = memory[name] + np.outer(first, first)
    return out


def ridge_from_sums(sums: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts of weighted ridge fits whose intercept is not penalised."""
    total = sums[:, 0, 0]
    mean = sums[:, 0, :] / total[:, None]
    centred = sums - total[:, None, None] * mean[:, :, None] * mean[:, None, :]
    m = sums.shape[1] - 2
    beta = np.linalg.solve(centred[:, 1:m + 1, 1:m + 1] + alpha * np.eye(m), centred[:, 1:m + 1, m + 1, None])[..., 0]
    return beta, mean[:, m + 1] - (mean[:, 1:m + 1] * beta).sum(axis=1)


def _rows_with_bins(scored: DataFrame, bins: QuartileBins, k: int, key: str) -> DataFrame:
    return scored.select(key, member_mean(F.col(PREDS), k).alias("_f"),
                         *[b.alias(f"b{i}") for i, b in enumerate(bins.bin_columns())])


def lime_sums(scored: DataFrame, bins: QuartileBins, drawn: np.ndarray, f: np.ndarray, k: int,
              key: str = "row_key") -> DataFrame:
    """``(row_key, i, j, value)``: the upper half of every row's sums; 0 is the constant, then the
    features, then the prediction."""
    shared = scored.sparkSession.sparkContext.broadcast((drawn, f))
    key_type = scored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples, predicted = shared.value
        memory: dict[bytes, np.ndarray] = {}
        i, j = np.triu_indices(samples.shape[1] + 2)
        for batch in batches:
            sums = local_sums(batch.iloc[:, 2:].to_numpy(np.int32), batch["_f"].to_numpy(), samples, predicted, memory)
            yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), len(i)), "i": np.tile(i, len(batch)),
                                "j": np.tile(j, len(batch)), "value": sums[:, i, j].ravel()})

    return _rows_with_bins(scored, bins, k, key).mapInPandas(run, f"`{key}` {key_type}, i int, j int, value double")


def _explained(rows: DataFrame, kept: Sequence[str], sums: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple]]]) -> DataFrame:
    """The first columns of ``rows``, those to keep, as they are, with ``coefficients``, ``intercept`` and ``prediction``.

    ``sums`` is called once per task and gives, for a batch, its sums and own predictions in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = sums()
        for batch in batches:
            at = 0
            for block, own_f in per_batch(batch):
                beta, intercept = ridge_from_sums(block)
                found = [pa.array(list(beta), pa.list_(pa.float64())), pa.array(intercept), pa.array(own_f)]
                columns = [batch.column(c).slice(at, len(block)) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *found], [*kept, "coefficients", "intercept", "prediction"])
                at += len(block)

    number = F.lit(0.0)
    schema = rows.select(*[column(c) for c in kept]).withColumns(
        {"coefficients": F.array(number), "intercept": number, "prediction": number}).schema
    return rows.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, first: int, count: int, kind: type) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(kind) for i in range(count)], axis=1)


def lime_explain(scored: DataFrame, bins: QuartileBins, drawn: np.ndarray, f: np.ndarray, k: int,
                 key: str = "row_key", keep: Sequence[str] = ()) -> DataFrame:
    """``(row_key, keep…, coefficients, intercept, prediction)`` per row; the samples are shared by all rows."""
    shared, kept, m = scored.sparkSession.sparkContext.broadcast((drawn, f)), [key, *keep], len(bins.features)

    def sums() -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        (samples, predicted), memory = shared.value, {}

        def of(batch: pa.RecordBatch) -> Iterator[tuple]:
            own_f = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            if len(own_f):
                yield local_sums(_matrix(batch, len(kept) + 1, m, np.int32), own_f, samples, predicted, memory), own_f
        return of

    rows = scored.select(*[column(c) for c in kept], member_mean(F.col(PREDS), k).alias("_f"),
                         *[b.alias(f"_b{i}") for i, b in enumerate(bins.bin_columns())])
    return _explained(rows, kept, sums)


# ---- continuous perturbations -------------------------------------------------------------------------

def truncated_normal(u: np.ndarray, mean: np.ndarray, std: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The values at the quantiles ``u`` of normal distributions that are cut off at two bounds; no spread gives the mean."""
    spread = np.where(std > 0, std, 1.0)
    from_, to = (np.interp((bound - mean) / spread, _GRID, _BELOW) for bound in (low, high))
    z = np.interp(from_ + u * (to - from_), _BELOW, _GRID)
    return np.where(std > 0, np.clip(mean + spread * z, low, high), mean)


def draw_tables(bins: QuartileBins) -> list[tuple[np.ndarray, ...]]:
    """Per feature and bin: rows up to and with it, mean, spread, and the two bounds."""
    number = lambda side: np.array([np.nan if v is None else v for v in side])
    return [(np.cumsum(bins.counts[j]), number(bins.means[j]), number(bins.stds[j]), *bins.bounds(j))
            for j in range(len(bins.features))]


def row_draws(tables: Sequence[tuple[np.ndarray, ...]], key: object, n: int, seed: object = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values ``(n - 1, features)`` of one row's perturbed samples.

    The uniforms come from a counter-based generator whose key is the digest of the row's, so a row has the same draws in
    every layout and after every retry."""
    digest = hashlib.md5(f"{key}:{seed}".encode()).digest()
    u = np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64))).random((2, len(tables), n - 1))
    drawn, values = np.zeros((n - 1, len(tables)), np.int32), np.zeros((n - 1, len(tables)))
    for j, (upper, *per_bin) in enumerate(tables):
        drawn[:, j] = np.searchsorted(upper, u[0, j] * upper[-1], side="right")
        values[:, j] = truncated_normal(u[1, j], *[side[drawn[:, j]] for side in per_bin])
    return drawn, values


def lime_continuous(rows: DataFrame, bins: QuartileBins, predict: Callable[[np.ndarray], np.ndarray], n: int = PERTURBATIONS,
                    key: str = "row_key", keep: Sequence[str] = (), seed: object = SEED) -> DataFrame:
    """``(row_key, keep…, coefficients, intercept, prediction)`` per row, from ``n`` samples of its own, itself the first.

    ``predict`` gives ``(members, rows)`` of a block. A row costs ``n`` predictions, so rows are first spread over all cores."""
    kept, m = [key, *keep], len(bins.features)
    width, step, tables = 0.75 * np.sqrt(m), max(1, _STEP // n), draw_tables(bins)

    def sums() -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        def of(batch: pa.RecordBatch) -> Iterator[tuple]:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, x = _matrix(part, len(kept), m, np.int32), _matrix(part, len(kept) + m, m, float)
                draws = [row_draws(tables, name, n, seed) for name in part.column(0).to_pylist()]
                values = np.stack([np.vstack([r, v]) for r, (_, v) in zip(x, draws)])
                y = predict(values.reshape(-1, m)).mean(axis=0).reshape(len(x), n)
                z = np.ones((len(x), n, m + 2))
                z[:, 1:, 1:m + 1] = np.stack([d for d, _ in draws]) == own[:, None, :]
                z[:, :, m + 1] = y
                w = np.exp(-(m - z[:, :, 1:m + 1].sum(axis=2)) / (2 * width * width))
                yield np.swapaxes(z * w[:, :, None], 1, 2) @ z, y[:, 0]
        return of

    session = rows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    given = rows.select(*[column(c) for c in kept], *[b.alias(f"_b{i}") for i, b in enumerate(bins.bin_columns())],
                        *[column(f).cast("double").alias(f"_x{i}") for i, f in enumerate(bins.features)])
    return _explained(given.repartition(tasks, column(key)), kept, sums)


def drawn_outside(rows: DataFrame, bins: QuartileBins, n: int, key: str = "row_key", seed: object = SEED) -> DataFrame:
    """``(row_key, feature, draws, outside)``: how many of a row's draws there are, and how many lie outside their bin."""
    key_type, tables = rows.schema[key].dataType.simpleString(), draw_tables(bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch[key]:
                drawn, values = row_draws(tables, name, n, seed)
                bad = [int((~((low[drawn[:, j]] <= values[:, j]) & (values[:, j] <= high[drawn[:, j]]))).sum())
                       for j, (*_, low, high) in enumerate(tables)]
                yield pd.DataFrame({key: name, "feature": list(bins.features), "draws": len(drawn), "outside": bad})

    return rows.select(key).mapInPandas(run, f"`{key}` {key_type}, feature string, draws bigint, outside bigint")


def with_rules(rows: DataFrame, bins: QuartileBins, contributions: str, digits: int = 9) -> DataFrame:
    """Adds ``rules``: the row's condition per feature with its contribution, largest first."""
    items = [F.struct((-F.abs(F.round(F.col(contributions)[i], digits))).alias("size"),
                      bins.rule(i).alias("rule"), F.col(contributions)[i].alias("contribution"))
             for i in range(len(bins.features))]
    return rows.withColumn("rules", F.array_sort(F.array(*items)))


def explanation_table(rows: DataFrame, actual: Sequence[str], shown: Sequence[str], key: str = "row_key",
                      integers: Sequence[str] = ()) -> DataFrame:
    """``(row_key, position, feature, value, contribution, contribution_text, sign)`` from ``rules``.

    Every rule is traced to its feature; a feature appears once, with its first rule; rules that match
    no feature are left out. A row none of whose rules matches lists all features with 0. The whole
    table is built inside each row, so nothing is shuffled.
    """
    named = F.transform("rules", lambda r: F.struct(
        rule_feature(r["rule"], actual, shown).alias("name"), r["contribution"].alias("contribution")))
    known = F.array(*[F.lit(a) for a in actual])
    with_names = rows.withColumn("_named", F.filter(named, lambda r: F.array_contains(known, r["name"])))
    all_names = F.transform("_named", lambda r: r["name"])
    first = F.filter("_named", lambda r, i: F.array_position(F.col("_names"), r["name"]) == i + 1)
    zeros = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(0.0).alias("contribution")) for a in actual])
    kept = with_names.withColumn("_names", all_names).withColumn(
        "_lines", F.when(F.size("_named") > 0, first).otherwise(zeros))
    texts = F.create_map(*[x for a in actual for x in (F.lit(a), value_text(column(a), a in integers))])
    labels = F.create_map(*[x for a, s in zip(actual, shown) for x in (F.lit(a), F.lit(s))])
    lines = kept.select(key, texts.alias("_texts"), F.posexplode("_lines").alias("position", "_line"))
    name, contribution = F.col("_line")["name"], F.col("_line")["contribution"]
    return lines.select(key, (F.col("position") + 1).alias("position"), F.element_at(labels, name).alias("feature"),
                        F.element_at("_texts", name).alias("value"), contribution.alias("contribution"),
                        signed_text(contribution).alias("contribution_text"), sign_class(contribution).alias("sign"))
