"""Every registered query against its SQL, and again with the tables laid out differently."""

import check_queries
import pytest

import __spark_entry__ as entry
from glosswork.sources import tables

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return check_queries.duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, duck, sf, name):
    result = check_queries.compare(duck, ORACLES[name], QUERIES[name](spark, sf))
    assert result.startswith("ok") and "TYPES" not in result, result


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["regression_metrics", "unique_names", "row_lookup", "shap_importance",
                                  "lime_weighted_sums", "hash_split_exact", "category_vocab", "linear_gram"])
def test_layout_does_not_matter(spark, duck, sf, name, monkeypatch):
    plain = tables.table
    for module in ("glosswork.sources.tables", "glosswork.plans.modelling"):
        monkeypatch.setattr(f"{module}.table", lambda s, d, n: plain(s, d, n).repartition(5))
    assert check_queries.compare(duck, ORACLES[name], QUERIES[name](spark, sf)).startswith("ok")


def test_every_check_names_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 70


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "test"}


def test_expected_numbers(spark):
    """Known results of the flagship at the largest scale."""
    rows = {r["split"]: r for r in QUERIES["regression_metrics"](spark, "/root/testdata/sf0.1").collect()}
    assert (rows["test"]["n"], rows["test"]["mae"], rows["test"]["rmse"], rows["test"]["r2"], rows["test"]["mean_std"]) == (
        800, 0.278834, 0.575609, 0.715279, 0.011035)
    assert (rows["train"]["n"], rows["train"]["mae"], rows["train"]["rmse"], rows["train"]["r2"], rows["train"]["mean_std"]) == (
        3180, 0.286592, 0.611542, 0.693848, 0.011611)
