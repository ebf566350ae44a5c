from fractions import Fraction

import numpy as np
import pytest

from glosswork.llm import whitening
from glosswork.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def plain(vectors):
    """Whole numbers, their sums, and the covariance, in exact fractions."""
    rows = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, dim = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(dim)]
    cov = [[sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in rows) / n for j in range(dim)] for i in range(dim)]
    return rows, sums, np.array([[float(x) for x in line] for line in cov])


def test_against_exact_fractions(make):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((60, 5)) * [1, 3, .2, 2, .5] + [5, -2, 0, 1, 0]).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(vectors)] + [(7, [float(c) for c in vectors[7]], "again")]
    bad = [(100, None, "x"), (101, [1.0, None, 0.0, 0.0, 0.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("inf")] * 5, "x"),
           (104, [1.0, 2.0], "x"), (105, [], "x"), (106, [1e30] * 5, "x")]
    used = [*vectors, vectors[7]]
    whole, sums, cov = plain(used)
    got = whitening.whiten(make(rows + bad, SCHEMA), most=3).collect()
    assert len(got) == 61 * 3 and {r["n"] for r in got} == {61}
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert max(abs(r["explained"] / (values[r["component"] - 1] / cov.trace()) - 1) for r in got) < 1e-12
    for k in (1, 2, 3):
        mine = sorted((r["id"], r["whitened"], r["deviation"]) for r in got if r["component"] == k)
        want = sorted((i, sum((x[d] - sums[d] / 61) * vecs[d, k - 1] for d in range(5)) / np.sqrt(values[k - 1]), sum(
            (61 * x[d] - sums[d]) ** 2 for d in range(5))) for i, x in zip([*range(60), 7], whole))
        sign = np.sign(mine[0][1] * want[0][1])
        assert [m[0] for m in mine] == [w[0] for w in want] and [int(m[2]) for m in mine] == [w[2] for w in want]
        assert np.allclose([m[1] for m in mine], [sign * w[1] for w in want], atol=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-12


def true_error(cov, values, vectors):
    residual = cov.astype(np.longdouble) @ vectors - vectors * values
    return float(np.abs(residual).max() / np.abs(cov).max()), float(np.abs(vectors.T @ vectors - np.eye(len(cov))).max())


@pytest.mark.parametrize("values", [
    np.linspace(1, 64, 32), [5, 5, 5, 1, 1, 0, 0, 0], [1, 1 + 1e-9, 1 + 2e-9, 3, 3 + 1e-13, 7], [1e9, 1e9 * (1 + 1e-7), 1e-3, 1e-3], [4], [2, 2]])
def test_refinement_reaches_double_precision_also_in_clusters(values):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    cov = (turn * np.array(values, float)) @ turn.T
    cov = (cov + cov.T) / 2
    found, vectors = whitening.refine(cov)
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-12, atol=1e-12 * max(values))
    residual, unit = true_error(cov, found, vectors)
    assert residual < 4e-16 * len(values) and unit < 1e-15 * len(values)


def test_close_values_are_told_apart_better_than_by_the_solver_alone():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((12, 12)).astype(np.longdouble).astype(float))[0]
    cov = (turn * np.array([1 + 1e-6 * i for i in range(12)])) @ turn.T
    cov = (cov + cov.T) / 2
    _, vectors = whitening.refine(cov)
    start = np.linalg.eigh(cov.astype(np.float32))[1].astype(float)
    exact = np.linalg.eigh(cov)[1][:, ::-1]
    off = lambda v: np.abs(np.abs((exact * v).sum(axis=0)) - 1).max()
    assert off(vectors) < 1e-12 and off(start[:, ::-1]) > 1e-4


def test_exact_products_of_large_numbers():
    rng = np.random.default_rng(3)
    for reach in (10, 1 << 26, 1 << 46):
        rows = rng.integers(-reach, reach, (50, 4))
        want = [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(4)] for i in range(4)]
        assert whitening.exact_gram(rows).tolist() == want


def test_no_variance_and_no_rows(make):
    assert whitening.whiten(make([], SCHEMA)).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0], "a")], SCHEMA)).count() == 0
    assert whitening.whiten(make([(1, None, "a")], SCHEMA)).count() == 0
    flat = whitening.whiten(make([(None, [1.0, float(i)], "a") for i in range(4)], SCHEMA)).collect()
    assert {r["component"] for r in flat} == {1} and {r["explained"] for r in flat} == {1.0}


def test_query_over_the_whole_table(spark, sf):
    got = op12_whitening(spark, sf)
    assert got.schema.simpleString() == ("struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,"
                                         "explained:double,identity_error:double>")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    out = got.collect()
    assert len(out) == 8 * rows and out[0]["identity_error"] < 1e-10
    w = np.array([r["whitened"] for r in sorted(out, key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 8)
    assert np.allclose(w.T @ w / len(w), np.eye(8), atol=1e-10)
    one, other = ({(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(
        spark.read.parquet(f"{sf}/embeddings.parquet").repartition(k)).withColumnRenamed("id", "vec_id").collect()} for k in (1, 5))
    assert one == other  # exact sums: the layout doesn't matter
