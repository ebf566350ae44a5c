import os
import time

import pytest
from pyspark.sql import functions as F

from glosswork.operators import coding
from glosswork.operators.calls import CallLimits
from glosswork.session import ship_by_value
from glosswork.streaming import theme_stream as ts

ship_by_value(__name__)

THEMES = ["T1_A", "T2_B"]


def flags(text, lowered):
    return {"T1_A": F.contains(lowered, F.lit("red")).cast("int"), "T2_B": text.rlike("[0-9]").cast("int")}


@pytest.fixture
def reviews(make):
    return make([(0, "t", "Red 7"), (1, None, None), (2, None, "blue"), (3, "5", None)],
                "row_key bigint, title string, review_text string")


def result(df):
    return {r["row_key"]: tuple(r)[1:] for r in df.collect()}


def test_codebook_labeller(reviews):
    got = result(coding.code_themes(reviews, coding.codebook_labeller(flags), THEMES))
    assert got == {0: ("ok", 1, 1), 1: ("empty", 0, 0), 2: ("ok", 0, 0), 3: ("ok", 0, 1)}


def test_recorded_labeller(reviews, make):
    answers = make([(0, 'x {"T1_A": "1"} y'), (1, '{"T1_A": 1}'), (2, "no")], "row_key bigint, response string")
    got = result(coding.code_themes(reviews, coding.recorded_labeller(answers), THEMES))
    assert got == {0: ("ok", 1, 0), 1: ("empty", 0, 0), 2: ("bad_json", 0, 0), 3: ("error", 0, 0)}


def test_function_labeller(reviews):
    def connect():
        def ask(prompt):
            if prompt.endswith("blue"):
                raise TimeoutError("no answer")
            return '{"T1_A": true, "T2_B": %d}' % ("Red" in prompt)
        return ask

    coded = coding.code_themes(reviews.repartition(3), coding.function_labeller(connect), THEMES)
    got = result(coded.drop("error_text"))
    assert got == {0: ("ok", 1, 1), 1: ("empty", 0, 0), 2: ("error", 0, 0), 3: ("ok", 1, 0)}
    assert {r["row_key"]: r["error_text"] for r in coded.collect()} == {0: None, 1: None, 2: "TimeoutError: no answer", 3: None}


def test_labeller_asks_again(spark, reviews):
    def connect():
        calls = []

        async def ask(prompt):
            calls.append(prompt)
            if calls.count(prompt) < 2:
                raise ConnectionError("busy")
            return '{"T1_A": 1}'
        return ask

    got = coding.code_themes(reviews.coalesce(1), coding.function_labeller(connect, CallLimits(pause=0.01)), THEMES)
    assert result(got) == {0: ("ok", 1, 0, None), 1: ("empty", 0, 0, None), 2: ("ok", 1, 0, None), 3: ("ok", 1, 0, None)}


def test_no_call_without_a_text(spark, reviews):
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def ask(prompt):
            calls.add(1)
            return "{}"
        return ask

    assert coding.code_themes(reviews, coding.function_labeller(connect), THEMES).collect()
    assert calls.value == 3


def test_search_does_not_see_the_layout(make):
    bar = lambda text, lowered: {"T1_A": F.contains(text, F.lit("|")).cast("int"), "T2_B": F.contains(lowered, F.lit("title")).cast("int")}
    rows = make([(0, "t", "x"), (1, "t", "a | b"), (2, "TITLE", None)], "row_key bigint, title string, review_text string")
    got = result(coding.code_themes(rows, coding.codebook_labeller(bar), THEMES))
    assert got == {0: ("ok", 0, 0), 1: ("ok", 1, 0), 2: ("ok", 0, 1)}


def test_recorded_answers_do_not_move_texts(spark, reviews, make, tmp_path):
    reviews.write.parquet(str(tmp_path / "reviews"))
    reviews = spark.read.parquet(str(tmp_path / "reviews"))
    answers = make([(0, "{}")], "row_key bigint, response string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = coding.code_themes(reviews, coding.recorded_labeller(answers), THEMES)
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    join = plan[plan.index("Join"):plan.index("Filter", plan.index("Join"))]
    assert "review_text" not in join and "title" not in join


def test_missing_columns_are_empty_texts(make):
    got = result(coding.code_themes(make([(5,)], "row_key bigint"), coding.codebook_labeller(flags), THEMES))
    assert got == {5: ("empty", 0, 0)}


def test_write_back_and_pending(reviews, make):
    coded = make([(0, "ok", 1, 0), (2, "bad_json", 0, 0)], "row_key bigint, status string, T1_A int, T2_B int")
    got = {r["row_key"]: (r["T1_A"], r["T2_B"]) for r in coding.write_back(reviews, coded, THEMES).collect()}
    assert got == {0: (1, 0), 1: (None, None), 2: (0, 0), 3: (None, None)}
    assert {r["row_key"] for r in coding.pending_rows(reviews, coded).collect()} == {1, 3}
    assert {r["row_key"] for r in coding.pending_rows(reviews, coded, retry=["bad_json"]).collect()} == {1, 2, 3}


def test_stream_restart(spark, make, tmp_path):
    """A job killed in its second batch, run again, ends like a job that was never interrupted."""
    folder = str(tmp_path / "in")
    schema = "row_key bigint, title string, review_text string"
    for start in (0, 10, 5):            # the last file repeats rows of the other two
        make([(i, "t", f"red {i}") for i in range(start, start + 10)], schema).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: ts.read_stream(spark, folder, make([], schema).schema, files_per_batch=1)
    code = lambda rows: coding.code_themes(rows, coding.codebook_labeller(flags), THEMES)

    calls = []

    def breaking(rows):
        calls.append(1)
        if len(calls) == 2:
            code(rows).limit(3).write.mode("overwrite").parquet(f"{tmp_path}/sink/batch_id=1")
            raise RuntimeError("executor lost")
        return code(rows)

    sink, log = str(tmp_path / "sink"), str(tmp_path / "log")
    with pytest.raises(Exception, match="executor lost"):
        ts.run_theme_stream(read(), breaking, sink, log)
    done = ts.run_theme_stream(read(), code, sink, log)
    whole = ts.run_theme_stream(read(), code, str(tmp_path / "sink2"), str(tmp_path / "log2"))
    keys = sorted(r["row_key"] for r in done.collect())
    assert keys == list(range(20)) == sorted(r["row_key"] for r in whole.collect())
    assert done.select("batch_id").distinct().count() >= 2
    assert ts.run_theme_stream(read(), code, sink, log).count() == 20


def test_no_sink_yet(spark, tmp_path):
    assert ts.coded_rows(spark, str(tmp_path / "none")) is None


REVIEWS = "row_key bigint, title string, review_text string"


def files(make, folder, *starts, rows=10):
    for start in starts:
        made = [(i, None if i % 10 == 9 else "t", None if i % 10 == 9 else f"red {i}") for i in range(start, start + rows)]
        make(made, REVIEWS).coalesce(1).write.mode("append").parquet(folder)


def test_seen_keys_are_in_the_state(spark, make, tmp_path):
    """A later run doesn't need the sink to know what came before, and its batches read as much as the first."""
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    code = lambda rows: coding.code_themes(rows, coding.codebook_labeller(flags), THEMES)
    read = lambda: ts.read_stream(spark, folder, make([], REVIEWS).schema, files_per_batch=1)
    files(make, folder, 0, 5)
    first = ts.run_theme_stream(read(), code, str(tmp_path / "a"), log)
    files(make, folder, 10, 12)
    query = ts.start_theme_stream(read(), code, str(tmp_path / "b"), log)
    query.awaitTermination()
    second = spark.read.parquet(str(tmp_path / "b"))
    keys = lambda df: sorted(r["row_key"] for r in df.collect())
    assert keys(first) == list(range(15)) and keys(second) == list(range(15, 22))
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [10, 10]
    assert batches[-1]["stateOperators"][0]["numRowsTotal"] == 22


def test_keys_of_a_span(spark, make, tmp_path):
    folder, schema = str(tmp_path / "in"), "row_key bigint, at timestamp, title string, review_text string"
    for keys, day in (([1, 2], 1), ([2, 3], 2), ([9], 20), ([8], 21), ([1, 3], 22)):
        rows = spark.createDataFrame([(k, f"2024-01-{day:02d} 00:00:00") for k in keys], "row_key bigint, day string")
        rows.select("row_key", F.to_timestamp("day").alias("at"), F.lit("t").alias("title"), F.lit("x").alias("review_text")).coalesce(
            1).write.mode("append").parquet(folder)
        time.sleep(1.1)     # files are taken by their times
    read = ts.read_stream(spark, folder, make([], schema).schema, files_per_batch=1)
    code = lambda rows: coding.code_themes(rows, coding.codebook_labeller(flags), THEMES)
    done = ts.run_theme_stream(read, code, str(tmp_path / "sink"), str(tmp_path / "log"), remember=("at", "5 days"))
    assert sorted(r["row_key"] for r in done.collect()) == [1, 1, 2, 3, 3, 8, 9]


def test_csv_stream(spark, make, tmp_path):
    from glosswork.sources.sinks import write_quoted_csv
    folder = str(tmp_path / "in")
    made = [(0, 'a "quoted", title', "red\nline 7"), (1, "t", "blue")]
    write_quoted_csv(make(made, REVIEWS).coalesce(1), folder)
    code = lambda rows: rows.select("row_key", "title", "review_text")
    read = lambda: ts.read_stream(spark, folder, make([], REVIEWS).schema, file_format="csv")
    got = ts.run_theme_stream(read(), code, str(tmp_path / "sink"), str(tmp_path / "log"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == made
    write_quoted_csv(make(made, REVIEWS).select("title", "row_key", "review_text").coalesce(1), folder, "append")
    with pytest.raises(Exception, match="(?i)header"):
        ts.run_theme_stream(read(), code, str(tmp_path / "sink"), str(tmp_path / "log"))


@pytest.mark.parametrize("query", ["stream_theme_coding", "stream_answers"])
def test_streams_read_a_table_of_many_files(spark, sf, tmp_path, query):
    """documents as a folder of part files, as Spark writes it, beside other tables: the same rows as from one file."""
    from glosswork.plans import catalog
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda folder: sorted(map(tuple, catalog.queries()[query](spark, folder).collect()))
    whole = rows(sf)
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count() and rows(str(tmp_path)) == whole


def service(folder):
    """A client that notes every call, answers even rows at once and odd ones when the service is up."""
    def connect():
        def ask(prompt):
            number = int(prompt.split("red ")[1])
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{number}\n")
            if number % 2 and not os.path.exists(f"{folder}/up"):
                raise ConnectionError("down")
            return '{"T1_A": %d}' % (number % 4 == 0)
        return ask
    return connect


def test_stream_asks_again(spark, make, tmp_path):
    folder, sink, log = (str(tmp_path / n) for n in ("in", "sink", "log"))
    options = dict(themes={t: t for t in THEMES}, limits=CallLimits(tries=1), wait_seconds=0.0, buckets=8, rounds=3)
    read = lambda: ts.read_stream(spark, folder, make([], REVIEWS).schema, files_per_batch=1)
    calls = lambda: sorted(map(int, (tmp_path / "calls").read_text().split()))
    files(make, folder, 0)
    got = result(ts.run_answer_stream(read(), service(tmp_path), sink, log, **options).drop("batch_id"))
    want = {i: ("ok", int(i % 4 == 0), 0, None, 1) for i in range(0, 10, 2)} | {9: ("empty", 0, 0, None, 0)}
    assert {k: v for k, v in got.items() if v[0] != "error"} == want
    (tmp_path / "up").touch()
    files(make, folder, 5)      # repeats five keys
    got = ts.run_answer_stream(read(), service(tmp_path), sink, log, **options).drop("batch_id")
    rows = result(got)
    assert got.count() == len(rows) == 15
    assert {k: v[0] for k, v in rows.items()} == {i: "empty" if i == 9 else "ok" for i in range(15)}
    assert {k: v[4] for k, v in rows.items() if k % 2 and k < 9}.keys() == {1, 3, 5, 7} and all(rows[k][4] >= 2 for k in (1, 3, 5, 7))
    assert [n for n in calls() if n % 2 == 0] == [0, 2, 4, 6, 8, 10, 12, 14]     # nothing is asked again that has an answer


def test_timers_of_a_running_stream(spark, make, tmp_path):
    """Without new files the timers fire; after the last round a row is given with its reason."""
    folder, sink, log = (str(tmp_path / n) for n in ("in", "sink", "log"))
    files(make, folder, 0)
    read = ts.read_stream(spark, folder, make([], REVIEWS).schema)
    query = ts.start_answer_stream(read, service(tmp_path), sink, log, {t: t for t in THEMES}, every="1 second",
                                   limits=CallLimits(tries=1), wait_seconds=0.5, buckets=8, rounds=2)
    try:
        for _ in range(60):
            time.sleep(1)
            done = ts.coded_rows(spark, sink)
            if done is not None and done.count() == 10:
                break
    finally:
        query.stop()
    got = result(ts.coded_rows(spark, sink).drop("batch_id"))
    assert {k: v[0] for k, v in got.items()} == {i: "empty" if i == 9 else "error" if i % 2 else "ok" for i in range(10)}
    assert got[3] == ("error", 0, 0, "ConnectionError: down", 2)
