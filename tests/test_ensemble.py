from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.operators import ensemble as ens
from glosswork.operators import evaluate as ev


def test_summary_matches_numpy(make):
    rng = np.random.default_rng(0)
    preds = rng.uniform(1, 6, (50, 5))
    df = make([(i, p.tolist()) for i, p in enumerate(preds)], "row_key bigint, preds array<double>")
    got = df.withColumns(ens.summary_columns(5)).orderBy("row_key").toPandas()
    assert np.allclose(got["pred_mean"], preds.mean(1))
    assert np.allclose(got["pred_std_pop"], preds.std(1))
    assert np.allclose(got["pred_std_samp"], preds.std(1, ddof=1))
    assert np.allclose(got["pred_low"], np.percentile(preds, 2.5, axis=1))
    assert np.allclose(got["pred_high"], np.percentile(preds, 97.5, axis=1))
    assert np.allclose(got["share_lt_3"] + got["share_3_to_4"] + got["share_ge_4"], 1)
    assert (got["pred_low"] <= got["pred_mean"]).all() and (got["pred_mean"] <= got["pred_high"]).all()
    exact = make([(0, [1.0, 2.0, 3.0, 4.0, 5.0])], "row_key bigint, preds array<double>").withColumns(ens.summary_columns(5)).first()
    assert (round(exact["pred_low"], 9), round(exact["pred_high"], 9)) == (1.1, 4.9)


def test_single_and_equal_members(make):
    one = make([(0, [2.5])], "row_key bigint, preds array<double>").withColumns(ens.summary_columns(1)).first()
    assert (one["pred_mean"], one["pred_std_pop"], one["pred_std_samp"], one["pred_low"]) == (2.5, 0.0, 0.0, 2.5)
    same = make([(0, [2.5] * 3)], "row_key bigint, preds array<double>").withColumns(ens.summary_columns(3)).first()
    assert same["pred_std_pop"] == same["pred_std_samp"] == 0.0


def test_mean_of_clamped(make):
    row = make([(0, [4.0, 7.0])], "row_key bigint, preds array<double>").withColumns(ens.clamped_summary(2)).first()
    assert row["pred_mean"] == 4.5


def test_long_predictions(make):
    df = make([(7, [1.0, 2.0])], "row_key bigint, preds array<double>")
    assert [tuple(r) for r in ens.long_predictions(df, [43, 44]).orderBy("member").collect()] == [(7, 43, 1.0), (7, 44, 2.0)]


def test_cell_means(make):
    train = make([(1, "a", 2.0), (2, "a", 4.0), (3, None, 9.0)], "row_key bigint, c string, y double")
    weights = {0: F.lit(1), 1: F.when(F.col("c") == "a", 0).otherwise(2)}
    model = ens.CellMeans.fit(train, ["c"], "y", weights)
    df = make([(10, "a"), (11, None), (12, "new")], "row_key bigint, c string")
    got = {r["row_key"]: r["preds"] for r in model.score(df).collect()}
    assert got == {10: [3.0, 9.0], 11: [9.0, 9.0], 12: [5.0, 9.0]}
    assert len({r["member"] for r in model.long_params().collect()}) == 2


def test_linear_members(make, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=300)
    w = rng.integers(0, 4, 300)
    df = make([(i, *map(float, x[i]), float(y[i]), int(w[i])) for i in range(300)],
              "row_key bigint, a double, b double, c double, y double, w int").repartition(4)
    full = np.column_stack([np.ones(300), x])
    want = np.linalg.lstsq(full * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    for terms in (1000, 0):
        monkeypatch.setattr(ens, "JVM_TERMS", terms)
        model = ens.LinearMembers.fit(df, ["a", "b", "c"], "y", {0: F.col("w"), 1: F.lit(1)})
        assert np.allclose(model.coefficients[0], want)
        assert np.allclose(model.coefficients[1], np.linalg.lstsq(full, y, rcond=None)[0])
        scored = model.score(df).orderBy("row_key").collect()
        assert np.allclose([r["preds"] for r in scored], model.predict(x).T)


def test_linear_members_with_a_constant_feature(make):
    df = make([(i, float(i), 0.0, 2.0 * i) for i in range(9)], "row_key bigint, a double, b double, y double")
    model = ens.LinearMembers.fit(df, ["a", "b"], "y", ens.equal_weights([0]))
    assert np.allclose(model.predict(np.array([[3.0, 0.0]])), 6.0)


@pytest.mark.parametrize("rows, want", [
    ([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], None), ([(2.0, 2.0), (2.0, 2.0)], 1.0), ([(2.0, 2.0), (2.0, 3.0)], 0.0)])
def test_metrics(make, rows, want):
    y, p = np.array(rows).T
    got = ev.regression_metrics(make(rows, "y double, pred_mean double"), "y").first()
    assert np.isclose(got["mae"], np.abs(y - p).mean()) and np.isclose(got["rmse"], np.sqrt(((y - p) ** 2).mean()))
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() if want is None else want
    assert np.isclose(got["r2"], r2)
    doubled = make([(*r, 2) for r in rows], "y double, pred_mean double, w int")
    weighted = ev.regression_metrics(doubled, "y", weight="w").first()
    assert weighted["n"] == 2 * len(rows) and np.isclose(weighted["r2"], r2) and np.isclose(weighted["mae"], got["mae"])


def test_weighted_metrics_keep_their_digits(make):
    """Targets far from zero, in groups far from each other, against exact arithmetic."""
    rng = np.random.default_rng(7)
    rows = [(g, base + float(y), base + float(y) + 0.1 * float(e), 1 + i % 3)
            for g, base in ((None, 1e9), ("b", 2e9)) for i, (y, e) in enumerate(rng.uniform(size=(600, 2)))]

    def exact(group):
        held = [(Fraction(y), Fraction(p), w) for g, y, p, w in rows if g == group]
        n = sum(w for *_, w in held)
        mean = sum(w * y for y, _, w in held) / n
        return n, float(1 - sum(w * (y - p) ** 2 for y, p, w in held) / sum(w * (y - mean) ** 2 for y, _, w in held))

    df = make(rows, "g string, y double, pred_mean double, w int")
    got = {r["g"]: r for r in ev.regression_metrics(df, "y", by=["g"], weight="w").collect()}
    got["alone"] = ev.regression_metrics(df.where("g = 'b'"), "y", weight="w").first()
    assert set(got) == {None, "b", "alone"}
    for g, row in got.items():
        n, r2 = exact("b" if g == "alone" else g)
        assert row["n"] == n and abs(row["r2"] - r2) < 1e-9 and 0.5 < r2 < 1


def test_ensemble_is_no_worse_than_its_members(make):
    rng = np.random.default_rng(2)
    y = rng.normal(size=200)
    preds = y[:, None] + rng.normal(size=(200, 5))
    df = make([(float(y[i]), preds[i].tolist()) for i in range(200)], "y double, preds array<double>")
    rmse = ev.regression_metrics(df.withColumns(ens.summary_columns(5)), "y").first()["rmse"]
    assert rmse <= np.sqrt(((preds - y[:, None]) ** 2).mean(0)).mean()
