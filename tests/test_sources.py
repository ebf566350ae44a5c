import pytest
from pyspark.sql import functions as F

from glosswork.session import scratch_dir
from glosswork.sources import csv, sinks


@pytest.fixture
def folder(tmp_path):
    return lambda name, text: (tmp_path.joinpath(name).write_text(text, encoding="utf-8"), str(tmp_path / name))[1]


def test_tolerant_read(spark, folder):
    path = folder("a.csv", "a,b,c\n1,2,3\n1,2\n1,2,3,4\n7,8,9\n")
    read = csv.read_csv_tolerant(spark, path)
    assert sorted(map(tuple, read.rows.collect()), key=str) == [("1", "2", "3"), ("1", "2", None), ("7", "8", "9")]
    assert [tuple(r) for r in read.bad_lines.collect()] == [("1", "2", "3", "4")]


@pytest.fixture
def mixed(tmp_path):
    """Files with the same names in another order, with one more, and with one fewer."""
    for name, text in {"a": "n,s\n1,x\n2,y\n", "b": " s ,n\nz,3\nw,4,surplus\n", "c": "\nn,s\n5,v\n", "d": 'n,"more, still",s\n6,m,u\n7\n',
                       "e": "s\nt\nq,8\n", "f": ""}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


@pytest.mark.parametrize("multi_line", [True, False])
def test_headers_that_differ(spark, mixed, multi_line):
    read = csv.read_csv_tolerant(spark, mixed, multi_line=multi_line)
    assert read.rows.columns == ["n", "s", "more, still"]
    rows = {("1", "x", None), ("2", "y", None), ("3", "z", None), ("5", "v", None), ("6", "u", "m"), ("7", None, None), (None, "t", None)}
    assert set(map(tuple, read.rows.collect())) == rows and read.rows.count() == len(rows)
    assert {tuple(r) for r in read.bad_lines.collect()} == {("4", "w", None, "surplus"), (None, "q", None, "8")}
    keyed = csv.with_file_position(read.rows).orderBy("row_key").collect()
    assert [(r["row_key"], r["n"], r["s"]) for r in keyed] == [
        (0, "1", "x"), (1, "2", "y"), (2, "3", "z"), (3, "5", "v"), (4, "6", "u"), (5, "7", None), (6, None, "t")]
    typed = csv.read_csv(spark, mixed, multi_line=multi_line)
    assert dict(typed.dtypes) == {"n": "bigint", "s": "string", "more, still": "string"} and typed.count() == 9
    with pytest.raises(ValueError, match="different headers"):
        csv.read_csv(spark, mixed, typed.select("n", "s").schema, multi_line=multi_line)


@pytest.mark.parametrize("header", [" n,n", "N,x", '"n\nn",s'])
def test_headers_that_cannot_be_matched(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(f"{header}\n1,2\n")
    (tmp_path / "b.csv").write_text("n,s\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        csv.read_csv_tolerant(spark, str(tmp_path))


def test_typed_read(spark, folder):
    path = folder("b.csv", ' n ,x,flag,text,empty\n1,1.5,True,"a ""q"", \nnext",NA\n2,,False,NULL,\n,inf,True,z,n/a\n')
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "text": "string", "empty": "double"}
    assert [tuple(r) for r in df.orderBy(F.col("n").asc_nulls_last()).collect()] == [
        (1, 1.5, True, 'a "q", \nnext', None), (2, None, False, None, None), (None, float("inf"), True, "z", None)]


def test_quoted_roundtrip(spark, make, tmp_path):
    rows = [(0, 'x"y'), (1, "b\\c"), (2, None), (3, "l1\nl2"), (4, "d,e"), (5, ""), (6, "''"), (7, "\\\"")]
    path = str(tmp_path / "q")
    sinks.write_quoted_csv(make(rows, "i int, v string"), path)
    back = {r["i"]: r["v"] for r in csv.read_csv(spark, path).collect()}
    assert back == {i: (v or None) for i, v in rows}
    assert all(line.startswith('"') for f in (tmp_path / "q").glob("*.csv") for line in f.read_text().splitlines()[:1])


def test_required_columns(make):
    with pytest.raises(ValueError, match="Rating"):
        csv.require_columns(make([(1,)], "a int"), ["a", "Rating"])


def test_file_position(spark, folder, tmp_path):
    for part in range(3):
        folder(f"p{part}.csv", "k\n" + "".join(f"{part * 1000 + i}\n" for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = csv.read_csv_tolerant(spark, str(tmp_path), multi_line=False)
        rows = csv.with_file_position(read.rows).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [str(part * 1000 + i) for part in range(3) for i in range(700)]
    assert [r["k"] for r in sorted(rows, key=lambda r: r["row_key"])] == want
    assert sorted(r["row_key"] for r in rows) == list(range(2100))


def test_dense_position(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "key")
    got = csv.dense_position(df.repartition(6), "key").orderBy("key").collect()
    assert [r["position"] for r in got] == list(range(len(got)))
    far = spark.range(3000).select((F.xxhash64("id")).alias("key"))
    got = csv.dense_position(far, "key").orderBy("key").collect()
    assert [r["position"] for r in got] == list(range(3000))
    assert [r["key"] for r in csv.rows_at(df, [0, 10], "key").orderBy("key").collect()] == [0, 70]
    with pytest.raises(ValueError, match="out of range"):
        csv.rows_at(df, [10_000], "key")
    assert csv.rows_at(df, [10_000], "key", clamp=True).first()["key"] == 4998


def _changed(spark, parallelism, split_bytes):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallelism)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")


def test_positions_do_not_depend_on_how_files_are_cut(spark, folder, tmp_path):
    for part in range(4):
        folder(f"p{part}.csv", "k\n" + "".join(f"{part * 1000 + i}\n" for i in range(1000)))
    try:
        for multi_line in (False, True):
            _changed(spark, 2, "10000000")
            keyed = csv.with_file_position(csv.read_csv_tolerant(spark, str(tmp_path), multi_line=multi_line).rows)
            ranked = csv.dense_position(spark.range(40_000).repartition(3), "id")
            _changed(spark, 64, "1000")
            assert sorted((r["row_key"], int(r["k"])) for r in keyed.collect()) == [(i, i) for i in range(4000)]
            assert ranked.count() == 40_000 and ranked.where("id <> position").count() == 0
    finally:
        for key in ("leafNodeDefaultParallelism", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{key}")


def test_split_sink_and_selected_features(spark, make, tmp_path):
    split = make([(1, "train"), (2, "test"), (3, "train")], "row_key bigint, split string")
    sinks.write_split(split, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["row_key"], r["split"]) for r in back.collect()) == [(1, "train"), (2, "test"), (3, "train")]
    chosen = sinks.selected_features(spark, ["age", "llm_x"], {"age": "age", "llm_x": "llm x"}, ["llm_x"])
    assert [tuple(r) for r in chosen.orderBy("position").collect()] == [
        (0, "age", "age", "Original dataset feature"), (1, "llm_x", "llm x", "LLM-derived feature")]


class _Session:
    """The parts of a session that decide the scratch folder."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-{folder}"})


def test_scratch_dir_follows_the_session():
    assert scratch_dir(_Session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(_Session("spark://host:7077", None))
    local = _Session("local[2]", None)
    assert scratch_dir(local) == scratch_dir(local)
