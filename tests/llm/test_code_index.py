import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import code_index
from glosswork.llm.code_index import Plan

DDL = "vec_id long, embedding array<float>, code int, table string"


def brute(rows, most):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and None not in v
            and np.isfinite(v).all() and np.any(v)]
    if not good:
        return {}
    dims = [len(v) for _, v in good]
    dim = max(sorted(set(dims)), key=dims.count)
    good = [g for g in good if len(g[1]) == dim]
    out = {}
    for q, x in sorted(good, key=lambda g: g[1].tobytes(), reverse=True):
        if q % 20 == 0:
            ranked = sorted((-float((v * x).sum()), i) for i, v in good if i != q)[:most]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()]
    return sum(hits) / sum(len(w) for w in want.values())


def vectors(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("plan", [Plan(), Plan(group_rows=60, group_queries=7)])
def test_recall_ranks_and_scores(make, plan):
    x = vectors(700, 24, 3)
    x[100:330] = x[100]  # a third of all vectors are equal
    rows = [(i, v.tolist(), 1, "t") for i, v in enumerate(x)]
    got, want = found(code_index.nearest_neighbours(make(rows, DDL), F.col("id") % 20 == 0, 20, plan=plan)), brute(rows, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    by_id = {i: np.array(v, np.float64) for i, v, *_ in rows}
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(s == (by_id[q] * by_id[i]).sum() and i != q for i, s in near)


def test_full_radius_is_exact_however_it_is_split(make):
    rows = [(i, v.tolist(), 1, "t") for i, v in enumerate(vectors(300, 8, 4))]
    want = brute(rows, 5)
    search = code_index.Search(make(rows, DDL), "vec_id", "embedding", 5, Plan(coverage=1.0, probe_queries=300, group_rows=40, group_queries=3))
    hits = search.nearest(F.col("id") % 20 == 0)
    got = found(hits.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"))
    assert got == want  # the radius holds all neighbours of all queries, so by the pigeonhole principle all are found


def test_odd_rows(make):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, ""), (1, [0.5, 0.5], 1, ""), (2, [0.5, 0.5], 1, ""), (3, None, 1, ""), (4, [0.0, 0.0], 1, ""), (5, [nan, 1.0], 1, ""),
            (6, [inf, 1.0], 1, ""), (7, [None, 1.0], 1, ""), (8, [1.0], 1, ""), (None, [1.0, 1.0], 1, ""), (20, [0.25, 2.0], 1, ""),
            (20, [0.25, 2.0], 1, ""), (9, [], 1, ""), (40, [-1.0, -1.0], 1, "")]
    assert found(code_index.nearest_neighbours(make(rows, DDL), F.col("id") % 20 == 0)) == brute(rows, 20)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "")], [(20, [1.0, 2.0], 1, "")]])
def test_no_candidates(make, rows):
    assert code_index.nearest_neighbours(make(rows, DDL), F.col("id") % 20 == 0).count() == 0


def test_query_recall(spark, sf):
    from glosswork.llm import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(queries.QUERIES["op10_code_index"](spark, sf)), brute(rows, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
