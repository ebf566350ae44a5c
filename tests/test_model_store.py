import numpy as np
import pytest

from glosswork.operators.ensemble import PREDS
from glosswork.operators.model_store import load_model, save_model, versions
from glosswork.operators.neural import NetConfig, NetMembers


def net(seed=1):
    rng = np.random.default_rng(seed)
    return NetMembers(("a", "kind=x", "kind=__missing__", "t"), NetConfig(hidden=(3,), seeds=(7, 8), clamp=True), rng.normal(size=(2, 19)), rng.normal(
        size=4), np.ones(4), 2.5, 0.1 + 0.2, ((7, 1, 0.5), (8, 1, 0.25)))


PREPARED = {"fill": {"a": 1 / 3}, "zero": ["t"], "categories": [("kind", "x"), ("kind", "__missing__")]}


def test_round_trip_in_a_new_session(spark, make, tmp_path):
    path = str(tmp_path / "store")
    assert [save_model(spark, net(seed), path, **PREPARED) for seed in (1, 2)] == [1, 2]
    other = spark.newSession()
    for version, seed in ((None, 2), (1, 1), (2, 2)):
        stored, model = load_model(other, path, version), net(seed)
        assert np.array_equal(stored.model.flat, model.flat) and stored.model.history == model.history
        assert stored.model.config == model.config and stored.model.features == model.features and stored.version == seed
        assert stored.model.target_scale == model.target_scale and np.array_equal(stored.model.mean, model.mean)
    assert stored.columns() == ["a", "t", "kind"]
    rows = make([(1.0, "x", 1), (None, None, None), (2.0, "new", 0)], "a double, kind string, t int")
    got = np.array([r[PREDS] for r in stored.score(rows).collect()])
    want = net(2).predict(np.array([[1.0, 1, 0, 1], [1 / 3, 0, 1, 0], [2.0, 0, 0, 0]])).T
    assert np.array_equal(got, want)
    with pytest.raises(ValueError, match="not found"):
        stored.score(rows.drop("kind"))


def test_unfinished_and_damaged_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no version at all"):
        load_model(spark, path)
    save_model(spark, net(), path)
    net(2).table(spark).write.parquet(f"{path}/half/weights")  # a writer that was lost before its marker
    assert load_model(spark, path).version == 1 and list(versions(spark, path)) == [1]
    with pytest.raises(ValueError, match="no version 5"):
        load_model(spark, path, 5)
    (folder,) = versions(spark, path).values()
    net(2).table(spark).write.mode("overwrite").parquet(f"{path}/{folder}/weights")
    with pytest.raises(ValueError, match="digest"):
        load_model(spark, path)
