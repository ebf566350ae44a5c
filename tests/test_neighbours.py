import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.functions.hashing import uniform
from glosswork.operators import neighbours as nb


def psi(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def brute(x, y, classes=None, k=3):
    """Both estimators over all pairs of rows; classes in place of y for the second."""
    dx = np.abs(x[:, None] - x[None, :])
    if classes is None:
        near = np.maximum(dx, np.abs(y[:, None] - y[None, :]))
        np.fill_diagonal(near, np.inf)
        radius = np.maximum(np.sort(near, axis=1)[:, k - 1], 5e-324)
        n_x = (dx < radius[:, None]).sum(axis=1)
        n_y = (np.abs(y[:, None] - y[None, :]) < radius[:, None]).sum(axis=1)
        return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(n_x, n_y)]))
    size = np.array([sum(classes == c) for c in classes])
    x, classes, size = x[size > 1], classes[size > 1], size[size > 1]
    dx = np.abs(x[:, None] - x[None, :])
    parts = []
    for i in range(len(x)):
        same = np.sort([dx[i, j] for j in range(len(x)) if j != i and classes[j] == classes[i]])
        k_i = min(k, size[i] - 1)
        parts.append(psi(k_i) - psi(size[i]) - psi((dx[i] < max(same[k_i - 1], 5e-324)).sum()))
    return max(0.0, psi(len(x)) + float(np.mean(parts)))


def blurred(df, names):
    """The numbers as the operator sees them."""
    rows = df.select(*names, *[uniform("id", n).alias(f"u_{n}") for n in names]).collect()
    out = {}
    for n in names:
        v = np.array([r[n] for r in rows], float)
        v = v / (float(np.float32(v.std())) or 1.0)
        out[n] = v + 1e-10 * np.maximum(1.0, np.abs(v)) * (np.array([r[f"u_{n}"] for r in rows]) - 0.5)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 2000
    y = rng.normal(size=n)
    rows = [(i, float(y[i]), float(y[i] + rng.normal()), float(round(2 * y[i])), 0.0 if i % 3 else float(rng.normal()), float(
        rng.pareto(0.7)), "abcdefgh"[min(7, int(abs(y[i]) * 3))] if i else "once") for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, noisy double, steps double, tied double, heavy double, kind string").cache()


@pytest.mark.parametrize("slab", [150, 1 << 16])
def test_equals_all_pairs(table, slab):
    names = ["noisy", "steps", "tied", "heavy"]
    got = {r[0]: r[1] for r in nb.neighbour_information(table, "id", [*names, "kind"], "y", {"kind"}, slab=slab).collect()}
    seen = blurred(table, [*names, "y"])
    for n in names:
        assert got[n] == pytest.approx(brute(seen[n], seen["y"]), abs=1e-9), n
    kinds = np.array([r[0] for r in table.select("kind").collect()])
    assert got["kind"] == pytest.approx(brute(seen["y"], None, kinds), abs=1e-9)
    assert got["noisy"] > 0.2 > got["heavy"]


def test_classes_as_target_and_both(table):
    got = {r[0]: r[1] for r in nb.neighbour_information(table.withColumn("copy", F.col("kind")), "id", ["y", "copy"], "kind", {
        "kind", "copy"}, slab=300).collect()}
    kinds = np.array([r[0] for r in table.select("kind").collect()])
    assert got["y"] == pytest.approx(brute(blurred(table, ["y"])["y"], None, kinds), abs=1e-9)
    shares = [np.mean(kinds == c) for c in set(kinds)]
    assert got["copy"] == pytest.approx(-sum(p * math.log(p) for p in shares), abs=1e-9)


def test_nulls_few_rows_and_empty(make):
    rows = [(1, None, 1.0, "a"), (2, float("nan"), 2.0, None), (3, 1.0, 3.0, "b"), (4, None, None, "b"), (5, None, float("inf"), "c")]
    df = make(rows, "id int, `a.b` double, y double, kind string")
    assert {r[0]: r[1] for r in nb.neighbour_information(df, "id", ["a.b", "kind"], "y", {"kind"}).collect()} == {"a.b": 0.0, "kind": 0.0}
    assert {r[0]: r[1] for r in nb.neighbour_information(df.where("id > 9"), "id", ["a.b"], "y").collect()} == {"a.b": 0.0}
    assert nb.neighbour_information(df, "id", [], "y").collect() == []
    # two rows: each is the other's only neighbour, at its distance in one dimension and beyond that in the other
    pair = make([(1, 1.0, 1.0), (2, 2.0, 3.0)], "id int, x double, y double")
    seen = blurred(pair, ["x", "y"])
    assert nb.neighbour_information(pair, "id", ["x"], "y").collect()[0][1] == pytest.approx(brute(seen["x"], seen["y"], k=1), abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e300, 1e300), st.floats(5e-324, 1e300)), min_size=1, max_size=20))
def test_ends_are_exact(pairs):
    x, r = (np.array(v) for v in zip(*pairs))
    c = nb.first_beyond(x, r)
    with np.errstate(over="ignore"):
        assert (c - x >= r).all() and (np.nextafter(c, -np.inf) - x < r).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 4), st.integers(0, 3))
def test_nearest_in_a_slab(n, k, seed):
    rng = np.random.default_rng(seed)
    px, py = np.sort(rng.integers(0, 40, n).astype(float)), rng.normal(size=n) * 20
    got = nb.nearest(px, py, px, py, np.full(n, k), np.full(n, np.inf), np.arange(n))
    apart = np.maximum(np.abs(px[:, None] - px), np.abs(py[:, None] - py))
    np.fill_diagonal(apart, np.inf)
    want = np.full((n, k), np.inf)
    want[:, :min(k, n)] = np.sort(apart, axis=1)[:, :k]
    assert np.array_equal(got, want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 60), st.integers(0, 1000), st.sampled_from([1, 3, 16]), st.sampled_from([20, 1 << 20]))
def test_nearest_for_guests(n, m, seed, leaf, pairs):
    """Rows that are not among the points, each with a k and a limit of its own."""
    rng = np.random.default_rng(seed)
    draw = [rng.standard_normal, lambda size: rng.integers(0, 9, size) / 2, lambda size: rng.pareto(0.4, size), np.zeros]
    (px, qx), (py, qy) = ((f(n), f(m)) for f in (draw[seed % 4], draw[seed // 4 % 4]))
    k, limit = rng.integers(1, 4, m), np.where(rng.random(m) < 0.3, np.inf, rng.random(m))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(nb, "_LEAF", leaf)
        patch.setattr(nb, "_PAIRS", pairs)
        got = nb.nearest(px, py, qx, qy, k, limit)
    apart = np.sort(np.maximum(np.abs(px - qx[:, None]), np.abs(py - qy[:, None])), axis=1)
    for found, want, some, below in zip(got, apart, k, limit):
        assert np.array_equal(found[:some][found[:some] < below], want[:some][want[:some] < below])


def test_a_flag_costs_no_more_than_other_numbers():
    """A flag against five ratings: within any small distance in x are rows of all ratings, the more the more rows there are."""
    rng = np.random.default_rng(1)
    n = 1 << 16
    x = np.sort(1e-10 * rng.random(4 * n))[:n]  # the first slab of four
    y = rng.integers(1, 6, n) + 1e-10 * (rng.random(n) - 0.5)
    began = time.process_time()
    got = nb.nearest(x, y, x, y, np.full(n, 3), np.full(n, np.inf), np.arange(n))
    assert time.process_time() - began < 3
    for row in range(0, n, 9973):
        assert np.array_equal(got[row], np.sort(np.maximum(np.abs(x - x[row]), np.abs(y - y[row])))[1:4])


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", nb.digamma(F.col("id")).alias("psi")).collect()
    assert all(abs(r["psi"] - psi(r["id"])) < 1e-13 for r in rows)
