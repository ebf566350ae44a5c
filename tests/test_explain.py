import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.operators import ensemble as ens
from glosswork.operators import lime, shap
from glosswork.session import ship_by_value

ship_by_value(__name__)
FEATURES = ["a", "b", "c", "d"]


@pytest.fixture
def table(make):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(30, 4)), 3)
    return make([(i, *map(float, r)) for i, r in enumerate(x)], "row_key bigint, a double, b double, c double, d double"), x


def model():
    beta = np.array([[1.0, 2.0, -1.0, 0.0, 0.5], [0.0, 1.0, -2.0, 0.0, 0.5]])
    return ens.LinearMembers(tuple(FEATURES), (0, 1), beta)


def curved(x):
    return np.stack([x[:, 0] * x[:, 1] + np.maximum(x[:, 2], 0), x[:, 0] - x[:, 1] * x[:, 2]])


def collect(df):
    rows = df.orderBy("row_key").collect()
    return tuple(np.array([r[c] for r in rows]) for c in ("phis", "base_value", "prediction"))


def test_linear_values_are_known(table):
    df, x = table
    background = x[:10]
    beta = model().coefficients.mean(0)[1:]
    want = beta * (x - background.mean(0))
    for got in (shap.shap_by_join(df, background, FEATURES, model().score, 2),
                shap.shap_in_batches(df, background, FEATURES, model().predict)):
        phi, base, pred = collect(got)
        assert np.allclose(phi, want) and np.allclose(phi[:, 2], 0)
        assert np.allclose(base, model().predict(background).mean()) and np.allclose(pred, model().predict(x).mean(0))


def test_both_plans_agree_and_add_up(table):
    df, x = table
    background = x[5:12]

    def score(d):
        a, b, c = F.col("a"), F.col("b"), F.col("c")
        return d.withColumn("preds", F.array(a * b + F.greatest(c, F.lit(0.0)), a - b * c))

    joined = collect(shap.shap_by_join(df, background, FEATURES, score, 2))
    batched = collect(shap.shap_in_batches(df, background, FEATURES, curved))
    for left, right in zip(joined, batched):
        assert np.allclose(left, right, atol=1e-9)
    phi, base, pred = batched
    assert np.allclose(phi.sum(1) + base, pred, atol=1e-9) and np.allclose(phi[:, 3], 0)


def test_values_against_brute_force(table):
    df, x = table
    background = x[:4]
    phi, _, _ = collect(shap.shap_in_batches(df, background, FEATURES, curved))

    def value(row, subset):
        mixed = background.copy()
        mixed[:, list(subset)] = row[list(subset)]
        return curved(mixed).mean()

    for key in range(5):
        order = sorted(range(4), key=lambda i: hashlib.md5(f"{key}:{FEATURES[i]}:42".encode()).hexdigest())
        want = np.zeros(4)
        for path in (order, order[::-1]):
            for n, i in enumerate(path):
                want[i] += (value(x[key], path[:n + 1]) - value(x[key], path[:n])) / 2
        assert np.allclose(phi[key], want)


def test_waterfall(table):
    df, x = table
    steps = shap.waterfall_steps(shap.shap_in_batches(df, x[:6], FEATURES, curved), FEATURES).toPandas()
    one = steps[steps["row_key"] == 3].sort_values("step")
    assert np.allclose(one["end"].to_numpy()[:-1], one["start"].to_numpy()[1:])
    assert np.isclose(one["end"].iloc[-1], curved(x[3:4]).mean())
    assert list(one["phi"].abs()) == sorted(one["phi"].abs())


def test_bins_and_draws(table):
    df, x = table
    bins = lime.QuartileBins.fit(df, ["a", "b"])
    assert np.allclose(bins.edges[0], np.unique(np.quantile(x[:, 0], [0.25, 0.5, 0.75])))
    assert sum(bins.counts[0]) == 30 and len(bins.rule_texts()[0]) == 4
    drawn = lime.draw_bins(bins, 4000)
    share = np.bincount(drawn[:, 0], minlength=4) / len(drawn)
    assert np.allclose(share, np.array(bins.counts[0]) / 30, atol=0.03)


def test_local_fit_against_brute_force(table, spark):
    df, x = table
    bins = lime.QuartileBins.fit(df, FEATURES)
    drawn = lime.draw_bins(bins, 300)
    f = lime.score_samples(spark, bins, drawn, model().score, 2)
    local = lime.lime_explain(model().score(df), bins, drawn, f, 2).orderBy("row_key").collect()
    width = 0.75 * np.sqrt(4)
    for key in (0, 7, 29):
        own = np.array([np.searchsorted(e, v, side="left") for e, v in zip(bins.edges, x[key])])
        z = np.vstack([np.ones(4), (drawn == own).astype(float)])
        y = np.concatenate([[model().predict(x[key:key + 1]).mean()], f])
        w = np.sqrt(np.exp(-(4 - z.sum(1)) / width ** 2))
        mz, my = np.average(z, axis=0, weights=w), np.average(y, weights=w)
        beta = np.linalg.solve(((z - mz) * w[:, None]).T @ (z - mz) + np.eye(4), ((z - mz) * w[:, None]).T @ (y - my))
        assert np.allclose(local[key]["coefficients"], beta) and np.isclose(local[key]["intercept"], my - mz @ beta)
        assert abs(beta[2]) < 0.15 * np.abs(beta).max()


def test_forgetting_shared_sums_changes_nothing(table, spark, monkeypatch):
    df, _ = table
    bins = lime.QuartileBins.fit(df, FEATURES)
    drawn = lime.draw_bins(bins, 100)
    f = np.arange(99.0)
    own = np.array(list(itertools.product([0, 1], repeat=4)) * 2)
    whole = lime.local_sums(own, np.ones(32), drawn, f, {})
    monkeypatch.setattr(lime, "_MEMORY", 1)
    assert np.allclose(whole, lime.local_sums(own, np.ones(32), drawn, f, {}))


def test_explanation_lines(make):
    rules = [[(-2.0, "llm_b <= 1.00", 2.0), (-1.5, "b > 0.00", -1.5), (-1.0, "zzz", 1.0), (-0.5, "a > 3.00", -0.5)],
             [(-1.0, "zzz", 1.0)]]
    df = make([(i, 4.0, 1.0, r) for i, r in enumerate(rules)],
              "row_key bigint, a double, b double, rules array<struct<size:double,rule:string,contribution:double>>")
    got = lime.explanation_table(df, ["a", "b"], ["a", "llm_b"], integers=["b"]).orderBy("row_key", "position").collect()
    assert [tuple(r) for r in got] == [
        (0, 1, "llm_b", "1", 2.0, "+2.000", "pos"), (0, 2, "a", "4.0000", -0.5, "-0.500", "neg"),
        (1, 1, "a", "4.0000", 0.0, "+0.000", "pos"), (1, 2, "llm_b", "1", 0.0, "+0.000", "pos")]


def test_equal_rows_are_solved_once(spark, make):
    """Few values: what is solved and exchanged doesn't grow with the rows, and rows stay where they are."""
    def few(n):
        return spark.range(n).select(F.col("id").alias("row_key"), *[
            F.pmod(F.xxhash64("id", F.lit(f)), F.lit(2)).cast("double").alias(f) for f in FEATURES])

    background = np.array(list(itertools.product([0.0, 1.0], repeat=4)))[::3]
    sizes = [shap.solved_pairs(few(n), background, FEATURES, model().score, 2).count() for n in (5_000, 50_000)]
    assert sizes == [16 * 24, 16 * 24]
    got = shap.shap_by_join(few(5_000), background, FEATURES, model().score, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    for left, right in zip(collect(got), collect(shap.shap_in_batches(few(5_000), background, FEATURES, model().predict))):
        assert len(left) == 5_000 and np.allclose(left, right, atol=1e-9)


def test_pairs_with_missing_values_meet(make):
    df = make([(0, None, 1.0), (1, None, 1.0), (2, float("nan"), -0.0), (3, float("nan"), 0.0)], "row_key bigint, a double, b double")
    score = lambda d: d.withColumn("preds", F.array(F.coalesce(F.nanvl("a", F.lit(3.0)), F.lit(5.0)) + F.col("b")))
    _, _, pred = collect(shap.shap_by_join(df, np.zeros((2, 2)), ["a", "b"], score, 1))
    assert list(pred) == [6.0, 6.0, 3.0, 3.0]


def test_truncated_normal():
    u = (np.arange(200_000) + 0.5) / 200_000
    one = lambda *v: lime.truncated_normal(u, *[np.full(len(u), x) for x in v])
    got = one(1.0, 2.0, 0.0, 4.0)
    assert got.min() >= 0 and got.max() <= 4 and (np.diff(got) >= 0).all()
    phi = lambda z: np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    from statistics import NormalDist
    below = NormalDist().cdf
    a, b = -0.5, 1.5
    mass = below(b) - below(a)
    mean = 1 + 2 * (phi(a) - phi(b)) / mass
    var = 4 * (1 + (a * phi(a) - b * phi(b)) / mass - ((phi(a) - phi(b)) / mass) ** 2)
    assert abs(got.mean() - mean) < 1e-5 and abs(got.var() - var) < 1e-4
    exact = [1 + 2 * NormalDist().inv_cdf(below(a) + p * mass) for p in u[::9973]]
    assert np.allclose(got[::9973], exact, atol=1e-5)
    assert (one(7.0, 0.0, 7.0, 7.0) == 7).all()


def test_continuous_draws(table):
    df, x = table
    bins = lime.QuartileBins.fit(df, FEATURES)
    tables = lime.draw_tables(bins)
    drawn, values = lime.row_draws(tables, 5, 4000)
    again = lime.row_draws(tables, 5, 4000)
    assert (again[0] == drawn).all() and (again[1] == values).all()
    assert not (lime.row_draws(tables, 6, 4000)[1] == values).any()
    for j in range(4):
        low, high = bins.bounds(j)
        assert low[0] == x[:, j].min() and high[-1] == x[:, j].max()
        assert (np.searchsorted(bins.edges[j], values[:, j], side="left") == drawn[:, j])[values[:, j] > low[drawn[:, j]]].all()
        for b in range(4):
            assert abs((drawn[:, j] == b).mean() - bins.counts[j][b] / 30) < 0.03
    outside = lime.drawn_outside(df, bins, 200).groupBy("feature").agg(F.sum("draws"), F.sum("outside")).collect()
    assert sorted(tuple(r) for r in outside) == [(f, 30 * 199, 0) for f in FEATURES]


def test_continuous_fit_against_brute_force(table, monkeypatch):
    df, x = table
    bins = lime.QuartileBins.fit(df, FEATURES)
    local = lime.lime_continuous(df, bins, curved, 300, keep=["b"]).orderBy("row_key").collect()
    assert len(local) == 30 and [r["b"] for r in local] == list(x[:, 1])
    width = 0.75 * np.sqrt(4)
    for key in (0, 7, 29):
        own = np.array([np.searchsorted(e, v, side="left") for e, v in zip(bins.edges, x[key])])
        drawn, values = lime.row_draws(lime.draw_tables(bins), key, 300)
        z = np.vstack([np.ones(4), (drawn == own).astype(float)])
        y = curved(np.vstack([x[key], values])).mean(axis=0)
        w = np.sqrt(np.exp(-(4 - z.sum(1)) / width ** 2))
        mz, my = np.average(z, axis=0, weights=w), np.average(y, weights=w)
        beta = np.linalg.solve(((z - mz) * w[:, None]).T @ (z - mz) + np.eye(4), ((z - mz) * w[:, None]).T @ (y - my))
        assert np.allclose(local[key]["coefficients"], beta) and np.isclose(local[key]["prediction"], y[0])
    other = lime.lime_continuous(df.repartition(7), bins, curved, 300).orderBy("row_key").collect()
    assert [r["coefficients"] for r in other] == [r["coefficients"] for r in local]


def test_kept_columns_are_carried(table, spark):
    df, x = table
    bins = lime.QuartileBins.fit(df, FEATURES)
    drawn = lime.draw_bins(bins, 50)
    f = lime.score_samples(spark, bins, drawn, model().score, 2)
    big = df.withColumns({"n": (F.col("row_key") + 2 ** 60).cast("bigint"), "gap": F.when(F.col("row_key") > 3, 1)})
    got = lime.lime_explain(model().score(big), bins, drawn, f, 2, keep=["n", "gap", "a"]).orderBy("row_key").collect()
    assert [(r["n"], r["gap"], r["a"]) for r in got] == [(2 ** 60 + i, 1 if i > 3 else None, x[i, 0]) for i in range(30)]
    assert lime.lime_explain(model().score(big.limit(0)), bins, drawn, f, 2, keep=["n"]).collect() == []
