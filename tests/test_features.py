import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.operators import features as feat
from glosswork.operators import split as sp
from glosswork.session import materialize
from glosswork.operators.percentiles import exact_percentiles, medians


def test_coercion_choice(make):
    df = make([("yes", "yes", True), ("no", "2", False), ("1", None, None)], "a string, b string, c boolean")
    facts = feat.column_facts(df)
    assert (facts["a"].choice, facts["b"].choice) == ("words", "number")
    got = [tuple(r) for r in feat.numeric_columns(df, facts, ["a", "b", "c"]).collect()]
    assert got == [(1.0, None, 1.0), (0.0, 2.0, 0.0), (None, None, None)]


def test_free_text_threshold(make):
    df = make([("x" * 25, "y" * 24, None), ("x" * 25, "y" * 25, None)], "a string, b string, c string")
    facts = feat.column_facts(df)
    assert [facts[c].is_free_text for c in "abc"] == [True, False, False]


def test_roles(make):
    df = make([(4.0, 1, "yes", "w" * 30, "s", None, 1)],
              "Rating double, llm_x int, fit_present string, note string, size string, gone string, T1_A int")
    facts = feat.column_facts(df)
    explain = {r.column: r.role for r in feat.explainer_roles(facts, "Rating")}
    assert explain == {"Rating": "target", "llm_x": "derived", "fit_present": "derived", "note": "dropped",
                       "size": "dropped", "gone": "dropped", "T1_A": "baseline"}
    experiment = {r.column: r.role for r in feat.experiment_roles(facts, "Rating")}
    assert experiment == {"Rating": "target", "llm_x": "numeric", "fit_present": "categorical", "note": "text",
                          "size": "categorical", "gone": "categorical", "T1_A": "theme"}
    with pytest.raises(ValueError, match="no derived"):
        feat.explainer_roles({"a": facts["size"]}, "Rating")


def test_missing_target_and_metadata(make):
    df = make([("4", 1, "t"), ("x", 2, "t"), (None, 3, "t")], "Rating string, a int, Title string")
    kept = feat.drop_metadata(feat.drop_missing_target(df, "Rating"), "Rating")
    assert kept.columns == ["Rating", "a"] and [tuple(r) for r in kept.collect()] == [(4.0, 1)]


def test_imputer(make):
    df = make([(1.0, None, math.nan), (3.0, None, 2.0), (None, None, 5.0)], "a double, b double, c double")
    got = feat.Imputer.fit(df, ["a", "b", "c"])
    assert got.fill == {"a": 2.0, "b": 0.0, "c": 3.5}
    assert [tuple(r) for r in got.transform(df).collect()] == [(1.0, 0.0, 3.5), (3.0, 0.0, 2.0), (2.0, 0.0, 5.0)]


def test_scaler(make):
    df = make([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = feat.Scaler.fit(df, ["a", "b"])
    got = [tuple(r) for r in scaler.transform(df).orderBy("a").collect()]
    assert np.allclose(got, [(-1.224745, 0), (0, 0), (1.224745, 0)], atol=1e-6)


def test_one_hot(make):
    train = make([(1, "a"), (2, "b"), (3, None)], "row_key bigint, c string")
    test = make([(4, "z"), (5, "b"), (6, None)], "row_key bigint, c string")
    got = feat.one_hot_long(test, feat.category_vocabulary(train, ["c"]), ["c"]).collect()
    assert sorted((r["row_key"], r["category"]) for r in got) == [(5, "b"), (6, "__missing__")]


def test_percentiles_match_numpy_and_depend_on_no_budget(make):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)] + [5.0] * 1500 + [None, math.nan]
    rng.shuffle(values)
    df = make([(v, float(i % 7), None) for i, v in enumerate(values)], "a double, b double, empty double").repartition(5)
    probs = [0.0, 0.025, 0.25, 0.5, 0.6, 0.975, 1.0]
    clean = np.array([v for v in values if v is not None and not math.isnan(v)])
    other = np.array([float(i % 7) for i in range(len(values))])
    every = []
    for buckets, parts in ((1 << 16, 5), (300, 1), (40, 3)):
        got = exact_percentiles(df.repartition(parts), {"a": probs, "b": [0.5, 0.9], "empty": [0.5], "none": []}, buckets)
        assert np.allclose(got["a"], np.quantile(clean, probs), rtol=1e-12)
        assert np.allclose(got["b"], np.quantile(other, [0.5, 0.9])) and got["empty"] == [None] and got["none"] == []
        every.append(got)
    assert every[0] == every[1] == every[2]  # equal bits
    assert medians(df.where("b < 0"), ["a"]) == {"a": None}


def test_percentiles_of_many_columns_are_those_of_the_built_in_function(spark):
    """A hundred thousand rows and thirty columns: some spread, some tied, some with one value on a third of all rows."""
    columns = {f"c{i}": F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise(F.rand(i) * 10 ** (i % 9)) if i % 3 == 0 else
               F.floor(F.randn(i) * 50) / 8 if i % 3 == 1 else F.exp(F.randn(i) * 4) for i in range(30)}
    df = materialize(spark.range(100_000, numPartitions=6).select(*[c.cast("double").alias(n) for n, c in columns.items()]), "columns")
    probs = [0.1, 0.5, 0.9]
    got = exact_percentiles(df, {n: probs for n in columns})
    want = df.agg(*[F.percentile(n, F.array(*map(F.lit, probs))).alias(n) for n in columns]).first()
    assert all(got[n] == list(want[n]) for n in columns)


def test_order_statistics_at_the_ends_of_doubles(make):
    near = [1.0, math.nextafter(1.0, 2)]
    values = sorted([-math.inf, -math.inf, -1.7e308, -5e-324, 0.0, 5e-324, *near, *near, 1.7e308, math.inf])
    df = make([(v,) for v in values], "a double")
    for buckets in (8, 1 << 16):
        got = exact_percentiles(df, {"a": [k / (len(values) - 1) for k in range(len(values))]}, buckets)["a"]
        assert [x for x in got if abs(x) < 1e300] == [x for x in values if abs(x) < 1e300] and got[0] == -math.inf and got[-1] == math.inf


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=60))
def test_percentiles_property(make, values):
    df = make([(v,) for v in values], "a double")
    got = exact_percentiles(df, {"a": [0.1, 0.5, 0.77]}, 12)["a"]
    assert np.allclose(got, np.quantile(values, [0.1, 0.5, 0.77]), rtol=1e-9, atol=1e-9)


def test_mutual_information(make):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.randint(0, 1), float(rng.randint(1, 5))) for _ in range(2000)]
    df = make(rows, "a int, b int, y double").withColumn("copy", F.col("y"))
    got = {r[0]: r[1] for r in feat.mutual_information(
        df, {c: F.col(c) for c in ("a", "b", "copy")}, F.col("y")).collect()}

    def brute(xs, ys):
        n, total = len(xs), 0.0
        for x in set(xs):
            for y in set(ys):
                p = sum(1 for a, b in zip(xs, ys) if (a, b) == (x, y)) / n
                if p:
                    total += p * math.log(p / (xs.count(x) / n * ys.count(y) / n))
        return total

    ys = [r[2] for r in rows]
    assert abs(got["a"] - brute([r[0] for r in rows], ys)) < 1e-10
    assert abs(got["b"] - brute([r[1] for r in rows], ys)) < 1e-10
    entropy = -sum(ys.count(v) / len(ys) * math.log(ys.count(v) / len(ys)) for v in set(ys))
    assert abs(got["copy"] - entropy) < 1e-10


def test_top_features_breaks_ties_by_name(make):
    scores = make([("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", 0.1)], "feature string, mutual_information double")
    assert [(r[0], r[1]) for r in feat.top_features(scores, 3).orderBy("feature_rank").collect()] == [
        (1, "c"), (2, "a"), (3, "b")]


def test_unique_names(make):
    df = make([(i, "abaa"[i]) for i in range(4)], "p bigint, n string")
    got = [r["unique_name"] for r in feat.unique_names(df, "n", "p").orderBy("p").collect()]
    assert got == feat.unique_name_list(list("abaa")) == ["a", "b", "a (1)", "a (2)"]


def test_unique_names_keeps_missing_names(make):
    df = make([(0, None), (1, "a"), (2, None)], "p bigint, n string")
    assert [r["unique_name"] for r in feat.unique_names(df, "n", "p").orderBy("p").collect()][1] == "a"
    assert feat.unique_names(df, "n", "p").count() == 3


def test_unique_names_with_a_hot_name(spark):
    """One name on every row, numbered over many position ranges."""
    df = spark.range(3000).select(F.col("id").alias("p"), F.lit("x").alias("n"))
    got = [r["unique_name"] for r in feat.unique_names(df, "n", "p", chunk=100).orderBy("p").collect()]
    assert got == ["x"] + [f"x ({i})" for i in range(1, 3000)]


@pytest.mark.parametrize("n, want", [(2000, 400), (1999, 400), (399, 80), (1, 1)])
def test_exact_split_sizes(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "row_key")
    split = sp.exact_split(df)
    assert split.where("split = 'test'").count() == want and split.count() == n
    worst = split.withColumn("h", sp.key_hash("row_key"))
    highest = worst.where("split = 'test'").agg(F.max("h")).first()[0]
    assert worst.where("split = 'train'").where(F.col("h") < highest).count() == 0


def test_exact_split_narrows(spark, monkeypatch):
    monkeypatch.setattr(sp, "_FEW", 0)
    df = spark.range(500).withColumnRenamed("id", "row_key")
    assert sp.exact_split(df).where("split = 'test'").count() == 100


def test_exact_bootstrap(spark, make):
    df = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    got = {r["k"]: r["draws"] for r in sp.exact_bootstrap(df.repartition(7), "k", [3, 4]).collect()}
    again = {r["k"]: r["draws"] for r in sp.exact_bootstrap(df.coalesce(1), "k", [3, 4]).collect()}
    assert got == again and len(got) == 2000
    for member in range(2):
        counts = [d[member] for d in got.values()]
        assert sum(counts) == 2000 and abs(counts.count(0) / 2000 - math.exp(-1)) < 0.04
    assert sum(a == b for a, b in got.values()) < 1200  # members differ
    assert sp.exact_bootstrap(df.where("k < 0"), "k", [3]).collect() == []
    assert [tuple(r) for r in sp.exact_bootstrap(make([(5,)], "k int"), "k", [3, 9]).collect()] == [(5, [1, 1])]
