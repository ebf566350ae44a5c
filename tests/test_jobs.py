"""The whole jobs on small review files."""

import csv
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glosswork.operators import coding
from glosswork.operators.neural import SETUPS
from glosswork.plans import jobs

QUICK = dict(rounds=2, rows_per_block=100)


@pytest.fixture(scope="module")
def review_file(tmp_path_factory):
    rng, path = random.Random(4), tmp_path_factory.mktemp("in") / "reviews.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([" Title", "Review Text", "Rating", "Age", "Division Name", "llm_mood", "fit_present", "dull_polarity"])
        for i in range(160):
            mood = rng.choice([0, 1])
            out.writerow([f"title {i}" if i % 4 else "", f'A long enough "text", line\nnumber {i} ' + "good" * mood,
                          "" if i % 40 == 7 else 1 + 3 * mood + rng.choice([0, 1]), rng.randint(18, 80) if i % 9 else "",
                          rng.choice(["North", "South"]), mood, rng.choice(["yes", "no", ""]), 0.5])
        f.write("1,2,3,4,5,6,7,8,9\n")
    return str(path)


def test_load(spark, review_file):
    df, bad = jobs.load_reviews(spark, review_file)
    assert df.count() == 160 and bad.count() == 1 and "Title" in df.columns
    assert sorted(r[0] for r in df.select("row_key").collect()) == list(range(160))
    assert jobs.load_reviews(spark, review_file, first_rows=50)[0].count() == 50


def test_coding_job_resumes(spark, review_file, tmp_path):
    def flags(text, lowered):
        return {"T1_GOOD": F.contains(text, F.lit("goodgood")).cast("int") * 0 + F.contains(text, F.lit("good")).cast("int")}

    book = {"T1_GOOD": "Says good."}
    out = str(tmp_path / "out")
    common = dict(codebook=book)
    first = jobs.coding_job(spark, review_file, out, coding.codebook_labeller(flags), first_rows=60, **common)
    assert first.count() == 60
    full = jobs.coding_job(spark, review_file, out, coding.codebook_labeller(flags), **common)
    assert full.count() == 160 and full.where("T1_GOOD is null").count() == 0
    runs = {r["run"]: r["count"] for r in spark.read.parquet(f"{out}/coded").groupBy("run").count().collect()}
    assert sum(n for run, n in runs.items() if run < 8) == 60 and sum(runs.values()) == 160
    assert full.agg(F.sum("T1_GOOD")).first()[0] == full.agg(F.sum("llm_mood")).first()[0]
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/reviews-csv/run=8")
    assert text.count() == 160 and "T1_GOOD" in text.columns


def _reviews(folder, name, texts):
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([["Title", "Review Text", "id"], *[["t", x, f"{name}{i}"] for i, x in enumerate(texts)]])
        f.write("t,surplus,1,2\n")


@pytest.mark.parametrize("key", [None, "id"])
def test_coding_goes_on_after_files_were_added(spark, tmp_path, key):
    """A file that sorts first moves every position; results stay with their reviews, and only new texts are asked."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def ask(prompt):
            calls.add(1)
            return '{"T1_GOOD": %d}' % ("good" in prompt.rsplit("Review:", 1)[1])
        return ask

    def run():
        start = calls.value
        full = jobs.coding_job(spark, str(folder), out, coding.function_labeller(connect), codebook={"T1_GOOD": "Says so."}, key=key)
        rows = full.collect()
        assert all(r["T1_GOOD"] == ("good" in (r["Review Text"] or "")) for r in rows)
        assert sorted(r["row_position"] for r in rows) == list(range(len(rows)))
        return len(rows), calls.value - start

    _reviews(folder, "b.csv", ["good one", "bad", "good two", "worse", "bad"])
    assert run() == (5, 4 if key is None else 5)
    _reviews(folder, "a.csv", ["new good", "new"])
    assert run() == (7, 2)
    assert run() == (7, 0)
    assert spark.read.json(f"{out}/bad-lines").count() == 1 + 2 + 2


def test_finished_parts_of_a_failed_coding_run_are_kept(spark, tmp_path):
    folder, out, broken = tmp_path / "in", str(tmp_path / "out"), tmp_path / "broken"
    folder.mkdir()
    broken.touch()
    _reviews(folder, "b.csv", [f"text {i}" for i in range(40)])

    class Failing:
        parts = 0

        def __call__(self, rows):
            self.parts += 1
            if self.parts == 3 and broken.exists():
                raise RuntimeError("killed")
            return rows.withColumn("response", F.lit("{}"))

    with pytest.raises(RuntimeError, match="killed"):
        jobs.coding_job(spark, str(folder), out, Failing(), codebook={"T1_GOOD": "x"}, commits=4)
    kept = spark.read.parquet(f"{out}/coded").count()
    assert 0 < kept < 40
    broken.unlink()
    jobs.coding_job(spark, str(folder), out, Failing(), codebook={"T1_GOOD": "x"}, commits=4)
    coded = spark.read.parquet(f"{out}/coded")
    assert coded.count() == coded.select("row_key").distinct().count() == 40


def test_experiment_job(spark, review_file, tmp_path):
    out = str(tmp_path / "out")
    result = jobs.experiment_job(spark, review_file, out, themes=False, setup=replace(SETUPS["tabular"], epochs=20), **QUICK)
    row = result.first()
    assert row["rows_used"] == 156 and row["test_size"] == 32 and row["n_members"] == 5 and row["rmse"] > 0
    roles = {r["column"]: r["role"] for r in spark.read.parquet(f"{out}/roles").collect()}
    assert roles["Review Text"] == "text" and roles["Division Name"] == "categorical" and roles["Age"] == "numeric"
    assert spark.read.option("header", True).csv(f"{out}/predictions").count() == 32
    split = spark.read.parquet(f"{out}/split")
    # the stored model gives the test rows of the same file the same scores
    fresh = jobs.score_job(spark, review_file, f"{out}/model", str(tmp_path / "new"))
    old = spark.read.option("header", True).csv(f"{out}/predictions").selectExpr("cast(row_key as bigint) row_key", "cast(y_pred_mean as double) old")
    assert fresh.count() > 156 - 32 and fresh.join(old, "row_key").where("abs(old - pred_mean) < 1e-9").count() == 32
    again = jobs.experiment_job(spark, review_file, str(tmp_path / "out2"), setup=replace(SETUPS["tabular_clamped"], epochs=20),
                                split=split, experiment="same split", **QUICK).first()
    assert again["test_size"] == 32 and again["experiment"] == "same split"
    with pytest.raises(ValueError, match="missing values"):
        jobs.experiment_job(spark, review_file, str(tmp_path / "out3"), impute=False, themes=False, **QUICK)


def test_lime_job(spark, review_file, tmp_path):
    out = str(tmp_path / "out")
    config = replace(SETUPS["decay"], epochs=30)
    lines = jobs.lime_job(spark, review_file, out, positions=[10, 11], config=config, samples=400, **QUICK)
    assert {r["row_key"] for r in lines.select("row_key").distinct().collect()} == {10, 11}
    best = {r["row_key"]: r["feature"] for r in lines.where("position = 1").collect()}
    assert set(best.values()) == {"llm_mood"}
    row = spark.read.parquet(f"{out}/distribution").first()
    assert abs(row["share_lt_3"] + row["share_3_to_4"] + row["share_ge_4"] - 1) < 1e-9
    drawn = jobs.lime_job(spark, review_file, str(tmp_path / "o1"), positions=[10], config=config, samples=400, perturb="normal", **QUICK)
    assert drawn.where("position = 1").first()["feature"] == "llm_mood" and drawn.count() == lines.where("row_key = 10").count()
    with pytest.raises(ValueError, match="out of range"):
        jobs.lime_job(spark, review_file, str(tmp_path / "o2"), positions=[999], config=config, **QUICK)


def test_shap_job(spark, review_file, tmp_path):
    out = str(tmp_path / "out")
    points = jobs.shap_job(spark, review_file, out, explain_rows=20, background_rows=15, fit_on="all", information="deciles",
                           config=replace(SETUPS["bootstrap"], epochs=30), **QUICK)
    assert points.select("row_key").distinct().count() == 20
    importance = {r["feature"]: r["importance"] for r in spark.read.parquet(f"{out}/importance").collect()}
    assert max(importance, key=importance.get) == "llm mood" and importance["llm dull polarity"] < 1e-6
    features = {r["raw_feature_name"]: r["feature_type"] for r in spark.read.parquet(f"{out}/features").collect()}
    assert features["Age"] == "Original dataset feature" and features["fit_present"] == "LLM-derived feature"
