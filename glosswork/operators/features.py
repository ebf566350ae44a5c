"""Coercion, column roles, imputation, scaling, one-hot, mutual information and feature choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glosswork.fixed_values import METADATA_COLUMNS, TEXT_MEAN_LENGTH, TOP_DERIVED_FEATURES
from glosswork.functions.coerce import nan_to_null, to_number, word_flag
from glosswork.functions.names import is_derived_name, is_theme_name
from glosswork.functions.numeric import rounded
from glosswork.operators.percentiles import exact_percentiles, medians
from glosswork.session import local_table, materialize
from glosswork.sources.csv import column, require_columns

MISSING_CATEGORY = "__missing__"


# ---- cleaning ---------------------------------------------------------------------------------------

def drop_metadata(df: DataFrame, target: str, names: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Drop the listed columns that exist; the target always stays."""
    return df.drop(*[n for n in names if n != target])


def drop_missing_target(df: DataFrame, target: str, on_error: str = "null") -> DataFrame:
    """Target as DOUBLE; rows without one are dropped (NaN counts as missing)."""
    dtype = require_columns(df, [target]).schema[target].dataType
    number = to_number(column(target), dtype, on_error, target)
    return df.withColumn(target, number).na.drop(subset=[target])


def add_missing_columns(df: DataFrame, names: Sequence[str], dtype: str = "int") -> DataFrame:
    new = {n: F.lit(None).cast(dtype) for n in names if n not in df.columns}
    return df.withColumns(new) if new else df


def zero_filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Theme columns as DOUBLE with everything missing or unreadable set to 0."""
    return df.withColumns({n: F.coalesce(to_number(column(n), df.schema[n].dataType), F.lit(0.0))
                           for n in names})


# ---- column statistics and roles ----------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnFacts:
    """What one column holds: row counts of its readings, and its mean text length."""
    name: str
    is_text: bool
    is_boolean: bool
    non_null: int
    mapped: int
    numeric: int
    mean_length: float | None

    @property
    def choice(self) -> str:
        """The reading that keeps more values; on a tie the number reading."""
        return "words" if self.mapped > self.numeric else "number"

    @property
    def kept(self) -> int:
        return max(self.mapped, self.numeric)

    @property
    def is_free_text(self) -> bool:
        return self.is_text and self.mean_length is not None and self.mean_length >= TEXT_MEAN_LENGTH


@dataclass(frozen=True)
class ColumnRole:
    column: str
    role: str
    reason: str


def column_facts(df: DataFrame, skip: Sequence[str] = ()) -> dict[str, ColumnFacts]:
    """Statistics of all columns from one aggregate; only its single row reaches the driver."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    aggs = []
    for i, f in enumerate(fields):
        c = column(f.name)
        text = isinstance(f.dataType, T.StringType)
        number = to_number(c, f.dataType)
        aggs += [
            F.count(c).alias(f"n{i}"),
            (F.count(word_flag(c)) if text else F.lit(0)).alias(f"m{i}"),
            F.count(number).alias(f"x{i}"),
            (F.avg(F.length(c)) if text else F.lit(None)).cast("double").alias(f"l{i}"),
        ]
    row = df.agg(*aggs).first() if aggs else None
    return {f.name: ColumnFacts(f.name, isinstance(f.dataType, T.StringType),
                                isinstance(f.dataType, T.BooleanType),
                                row[f"n{i}"], row[f"m{i}"], row[f"x{i}"], row[f"l{i}"])
            for i, f in enumerate(fields)}


def facts_table(df: DataFrame, facts: Mapping[str, ColumnFacts]) -> DataFrame:
    rows = [(f.name, f.non_null, f.mapped, f.numeric, f.choice, f.kept > 0, f.mean_length, f.is_free_text)
            for f in facts.values()]
    return local_table(
        df.sparkSession, rows, "column string, non_null bigint, mapped bigint, numeric bigint, choice string, "
              "usable boolean, mean_length double, is_text boolean")


def numeric_columns(df: DataFrame, facts: Mapping[str, ColumnFacts], names: Sequence[str]) -> DataFrame:
    """Each named column as DOUBLE, in the reading its facts choose."""
    return df.withColumns({
        n: word_flag(column(n)) if facts[n].choice == "words" else to_number(column(n), df.schema[n].dataType)
        for n in names})


def explainer_roles(facts: Mapping[str, ColumnFacts], target: str,
                    drop: Sequence[str] = METADATA_COLUMNS, derived=is_derived_name) -> list[ColumnRole]:
    """Roles for the explainers: every column with a number reading is a feature, derived or baseline."""
    roles = []
    for name, f in facts.items():
        if name == target:
            roles.append(ColumnRole(name, "target", "target column"))
        elif name in drop:
            roles.append(ColumnRole(name, "dropped", "metadata column"))
        elif f.kept == 0:
            roles.append(ColumnRole(name, "dropped", "no numeric value"))
        elif derived(name):
            roles.append(ColumnRole(name, "derived", "name rule"))
        else:
            roles.append(ColumnRole(name, "baseline", f"read as {f.choice}"))
    if not any(r.role == "derived" for r in roles):
        raise ValueError("no derived numeric features were found")
    return roles


def experiment_roles(facts: Mapping[str, ColumnFacts], target: str, themes: bool = True) -> list[ColumnRole]:
    """Roles for the experiments: theme columns by name, long texts out, the rest by type."""
    roles = []
    for name, f in facts.items():
        if name == target:
            roles.append(ColumnRole(name, "target", "target column"))
        elif themes and is_theme_name(name):
            roles.append(ColumnRole(name, "theme", "name rule"))
        elif f.is_free_text:
            roles.append(ColumnRole(name, "text", "long text"))
        elif f.is_text:
            roles.append(ColumnRole(name, "categorical", "short text"))
        else:
            roles.append(ColumnRole(name, "numeric", "boolean" if f.is_boolean else "number"))
    return roles


def with_role(roles: Sequence[ColumnRole], *wanted: str) -> list[str]:
    return [r.column for r in roles if r.role in wanted]


def roles_table(df: DataFrame, roles: Sequence[ColumnRole]) -> DataFrame:
    rows = [(i, r.column, r.role, r.reason) for i, r in enumerate(roles)]
    return local_table(df.sparkSession, rows, "position int, column string, role string, reason string")


# ---- fitted statistics as literals: the projections stay inside code generation -------------------------

@dataclass(frozen=True)
class Imputer:
    fill: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, names: Sequence[str]) -> Imputer:
        """Medians of the given rows; 0 for a column without any value."""
        return cls({n: 0.0 if m is None else m for n, m in medians(df, names).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        out = {n: F.coalesce(nan_to_null(column(n).cast("double")), F.lit(v)) for n, v in self.fill.items()}
        return df.withColumns(out) if out else df


@dataclass(frozen=True)
class Scaler:
    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, names: Sequence[str]) -> Scaler:
        """Mean and population deviation, one aggregate; a constant column is divided by 1."""
        aggs = []
        for i, n in enumerate(names):
            c = column(n).cast("double")
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        return cls({n: row[f"m{i}"] or 0.0 for i, n in enumerate(names)},
                   {n: row[f"s{i}"] or 1.0 for i, n in enumerate(names)})

    def scaled(self, name: str) -> Column:
        return (column(name).cast("double") - F.lit(self.mean[name])) / F.lit(self.scale[name])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: self.scaled(n) for n in self.mean})

    def unscaled(self, value: Column, name: str) -> Column:
        return value * F.lit(self.scale[name]) + F.lit(self.mean[name])

    def unscaled_spread(self, value: Column, name: str) -> Column:
        return value * F.lit(self.scale[name])


# ---- categories -----------------------------------------------------------------------------------------

def _long_categories(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and categorical column: ``(…, feature, category)``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"),
                               F.coalesce(column(n).cast("string"), F.lit(MISSING_CATEGORY)).alias("category"))
                      for n in names])
    return df.select(*keep, F.inline(pairs))


def category_vocabulary(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, category, n)`` of the training rows, as a written table.

    Equal values are combined before the shuffle, so a category that holds a third of all rows costs
    no more than a rare one. Being written, its size is known to whatever joins it later."""
    return materialize(_long_categories(train, names).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("n")), "vocabulary")


def indexed_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Adds the 0-based column index inside each feature, in category order."""
    rank = F.row_number().over(W.partitionBy("feature").orderBy("category"))
    return vocabulary.withColumn("index", (rank - 1).cast("bigint"))


def one_hot_long(df: DataFrame, vocabulary: DataFrame, names: Sequence[str], key: str = "row_key") -> DataFrame:
    """The ones of the indicator matrix as rows. A category outside the vocabulary has no row: all
    its indicators are 0. A written vocabulary is broadcast only while it is small; a larger one is
    joined by shuffle, where adaptive execution splits a hot category."""
    long = _long_categories(df, names, [key])
    return long.join(vocabulary, ["feature", "category"]).select(key, "feature", "category", F.lit(1.0).alias("value"))


# ---- mutual information -------------------------------------------------------------------------------------

def quantile_edges(df: DataFrame, names: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct bin edges at the i/bins percentiles, ends included."""
    found = exact_percentiles(df, {n: [i / bins for i in range(bins + 1)] for n in names})
    return {n: sorted({v for v in q if v is not None}) for n, q in found.items()}


def bin_index(c: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the value: 0 for values up to the first edge."""
    index = F.lit(0)
    for edge in edges:
        index = index + (c > F.lit(edge)).cast("int")
    return index


def contingency(df: DataFrame, binned: Mapping[str, Column], target: Column) -> DataFrame:
    """``(feature, x, y, n)`` counts of all features in one pass, combined before the shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("string").alias("x")) for n, c in binned.items()])
    return (df.select(target.alias("y"), F.inline(cells))
            .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def mutual_information(df: DataFrame, binned: Mapping[str, Column], target: Column) -> DataFrame:
    """``(feature, mutual_information)`` in nats between each binned feature and the target.

    A plug-in estimate over counts: it needs one grouped count, while a nearest-neighbour estimate
    would compare rows with each other. With counts n(x,y) and margins, N*MI is
    sum n(x,y) ln n(x,y) - sum n(x) ln n(x) - sum n(y) ln n(y) + N ln N, so joint counts, margins and
    totals are four grouping sets of one aggregate and no group of rows is ever gathered.
    """
    counts = contingency(df, binned, target)
    f, x, y = F.col("feature"), F.col("x"), F.col("y")
    level = F.grouping_id("feature", "x", "y")          # 0 joint, 1 x margin, 2 y margin, 3 total
    parts = counts.groupingSets([[f, x, y], [f, x], [f, y], [f]], f, x, y).agg(
        F.sum("n").alias("n"), level.alias("level"))
    weight = F.when(F.col("level").isin(1, 2), -1.0).otherwise(1.0)
    score = (F.sum(weight * F.col("n") * F.log(F.col("n").cast("double")))
             / F.max(F.when(F.col("level") == 3, F.col("n"))))
    return parts.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("mutual_information"))


def top_features(scores: DataFrame, n: int = TOP_DERIVED_FEATURES) -> DataFrame:
    """``(feature_rank, feature, mutual_information)``, best first, ties by name."""
    ranked = scores.select("feature", rounded(F.col("mutual_information"), 9).alias("mutual_information"))
    order = W.orderBy(F.desc("mutual_information"), "feature")
    best = ranked.orderBy(F.desc("mutual_information"), "feature").limit(n)
    return best.select(F.row_number().over(order).alias("feature_rank"), "feature", "mutual_information")


# ---- names ---------------------------------------------------------------------------------------------------

def unique_names(df: DataFrame, name: str, position: str, chunk: int = 1 << 20) -> DataFrame:
    """Adds ``unique_name``: the second and later holders of a name, in position order, get `` (1)``, …

    ``position`` is a dense row position (``with_file_position`` and ``dense_position`` make one).

    One name may hold a third of all rows, so rows are not numbered per name in one task: they are
    numbered per name and position range, and the counts of the earlier ranges are added.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)))
    counts = cut.groupBy(name, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(name).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(name, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(name, "_chunk").orderBy(position))
    repeat = F.col("_before") + inside - 1
    other = before.toDF("_name", "_part", "_before")
    same = cut[name].eqNullSafe(other["_name"]) & (cut["_chunk"] == other["_part"])
    return (cut.join(other, same).withColumn("_repeat", repeat)
            .withColumn("unique_name", F.when(F.col("_repeat") == 0, F.col(name)).otherwise(
                F.concat(F.col(name), F.lit(" ("), F.col("_repeat").cast("string"), F.lit(")"))))
            .drop("_chunk", "_before", "_repeat", "_name", "_part"))


def unique_name_list(names: Sequence[str]) -> list[str]:
    """The same rule for a short list of column names."""
    return [n if (k := names[:i].count(n)) == 0 else f"{n} ({k})" for i, n in enumerate(names)]
