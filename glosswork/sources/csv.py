"""CSV scans: typed, tolerant of broken lines, and with a row position."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glosswork.functions.coerce import clear_null_tokens, text_to_number
from glosswork.session import materialize

SURPLUS = "_extra"


class TolerantRead(NamedTuple):
    rows: DataFrame
    bad_lines: DataFrame


def _reader(spark: SparkSession, multi_line: bool, header: bool = True):
    return (spark.read.option("header", header).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; available columns: {df.columns}")
    return df


def clear_missing(df: DataFrame) -> DataFrame:
    """Null for every missing-value token and, in number columns, for NaN."""
    out = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            out[field.name] = clear_null_tokens(c)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            out[field.name] = F.when(~F.isnan(c), c)
    return df.withColumns(out) if out else df


def file_headers(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> list[tuple[list[str], list[str]]]:
    """The different headers (trimmed names) of the files of a scan, each with its files; the commonest first, of equally common
    ones that of the first file. One job reads the first lines of all files. Blank lines before a header are passed over."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id")).where("start = 0 and trim(value) != ''")
    by_line: dict[str, list[str]] = {}
    for row in lines.groupBy("path").agg(F.min_by("value", "id").alias("line")).orderBy("path").collect():
        by_line.setdefault(row["line"], []).append(row["path"])
    if len(by_line) > 1 and any(line.count('"') % 2 for line in by_line):
        raise ValueError("files with different headers cannot have line breaks inside their names")
    by_names: dict[tuple, list[str]] = {}
    for files in by_line.values():
        names = tuple(name.strip() for name in _reader(spark, multi_line).csv(files[0]).columns)
        by_names.setdefault(names, []).extend(files)
    return sorted(((list(names), files) for names, files in by_names.items()), key=lambda h: -len(h[1]))


def _by_name(spark: SparkSession, headers: list[tuple[list[str], list[str]]], path: str | list[str], multi_line: bool) -> DataFrame:
    """One scan of files whose headers differ, as text: each field in the column that its own file's header names, and the first
    field beyond that header in ``SURPLUS``. Names that a file does not have are null there. The rows keep their metadata."""
    for names, files in headers:
        if len(set(names)) < len(names):
            raise ValueError(f"{files[0]}: a name stands twice in its header, which differs from that of other files: {names}")
    width = max(len(names) for names, _ in headers)
    cells = [f"_c{i}" for i in range(width + 1)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    raw = (_reader(spark, multi_line).option("mode", "PERMISSIVE").option("enforceSchema", True).schema(schema).csv(path))
    here = F.col("_metadata.file_path")

    def chosen(values: list[Column]) -> Column:
        out = values[0]  # the commonest header needs no list of files
        for (_, files), value in zip(headers[1:], values[1:]):
            out = F.when(here.isin(files), value).otherwise(out)
        return out

    nothing = F.lit(None).cast("string")
    wanted = dict.fromkeys(name for names, _ in headers for name in names)
    if len({name.lower() for name in wanted}) < len(wanted):
        raise ValueError(f"names in the headers of different files differ in case only: {list(wanted)}")
    columns = [chosen([F.col(cells[names.index(n)]) if n in names else nothing for names, _ in headers]).alias(n) for n in wanted]
    surplus = chosen([F.coalesce(*[F.col(c) for c in cells[len(names):]]) for names, _ in headers]).alias(SURPLUS)
    return raw.select(*columns, surplus)


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the type their content shows: BOOLEAN, BIGINT, DOUBLE, else STRING.

    One aggregate over all columns; only its single row of counts reaches the driver.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    flags = ("True", "TRUE", "true", "False", "FALSE", "false")
    aggs = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count(text_to_number(c)).alias(f"num{i}"),
            F.count_if(c.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"int{i}"),
            F.count_if(c.isin(*flags)).alias(f"flag{i}"),
        ]
    seen = df.agg(*aggs).first()
    out = {}
    for i, name in enumerate(names):
        c, n = F.col(f"`{name}`"), seen[f"n{i}"]
        if n == 0:
            out[name] = c.try_cast("double")
        elif seen[f"flag{i}"] == n:
            out[name] = F.lower(c) == "true"
        elif seen[f"int{i}"] == n:
            out[name] = F.trim(c).try_cast("bigint")
        elif seen[f"num{i}"] == n:
            out[name] = text_to_number(c)
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
             typed: bool = True, multi_line: bool = True) -> DataFrame:
    """Quoted CSV with a header. With a schema nothing is inferred; without one every column is read
    as text and then typed from its content. Files whose headers differ are put together by name; with a schema that is an error.

    ``multi_line`` allows line breaks inside quotes, but a file is then read by one task: for big
    data either supply many files or turn it off.
    """
    plain = _reader(spark, multi_line).csv(path) if schema is None else _reader(spark, multi_line).schema(schema).csv(path)
    headers = file_headers(spark, path, multi_line) if len(plain.inputFiles()) > 1 else []
    if schema is not None:
        if len(headers) > 1:
            raise ValueError(f"a schema goes by position, but the files have different headers: {[names for names, _ in headers]}")
        return clear_missing(trim_header(plain))
    df = clear_missing(_by_name(spark, headers, path, multi_line).drop(SURPLUS) if len(headers) > 1 else trim_header(plain))
    return infer_types(df) if typed else df


def read_csv_tolerant(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
                      header: bool = True, multi_line: bool = True) -> TolerantRead:
    """All-text scan that keeps short lines (missing fields null) and sets aside lines with too many
    fields. One extra column after the header's last one catches the surplus.

    Files whose headers differ are put together by name, and each line is measured by its own file's header; given ``columns`` go by
    position. A surplus field that is empty cannot be told from no field at all, so such a line is kept.
    """
    if columns is None and header:
        plain = _reader(spark, multi_line).csv(path)
        headers = file_headers(spark, path, multi_line) if len(plain.inputFiles()) > 1 else []
        if len(headers) > 1:
            raw = _by_name(spark, headers, path, multi_line)
            return TolerantRead(clear_missing(raw.where(F.col(SURPLUS).isNull()).drop(SURPLUS)), raw.where(F.col(SURPLUS).isNotNull()))
        columns = plain.columns
    columns = columns or _reader(spark, multi_line, header).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*columns, SURPLUS]])
    # header and schema differ in length on purpose, so the header line is not checked against it
    raw = (_reader(spark, multi_line, header).option("mode", "PERMISSIVE").option("enforceSchema", True)
           .schema(schema).csv(path))
    rows = trim_header(raw.where(F.col(SURPLUS).isNull()).drop(SURPLUS))
    return TolerantRead(clear_missing(rows), trim_header(raw.where(F.col(SURPLUS).isNotNull())))


#: monotonically_increasing_id holds the task in the bits above these.
_TASK_SHIFT = 33


def _running_offsets(counts: DataFrame, order: list[str]) -> DataFrame:
    """``counts`` with ``_offset``, the sum of ``_n`` before each row: a small table, one row per file block or task. It is
    written, so its size is known, and Spark broadcasts it only below the session's threshold."""
    before = F.sum("_n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return materialize(counts.withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_n"), "offsets")


def _placed(tagged: DataFrame, offsets: DataFrame, on: list[str], index: Column, name: str) -> DataFrame:
    """Every row with its block's offset plus its index there; a row of an unknown block stops the job."""
    lost = F.raise_error(F.lit("a row belongs to a block that was not counted")).cast("bigint")
    joined = tagged.join(offsets, on, "left")
    return joined.withColumn(name, F.coalesce(F.col("_offset") + index, lost))


def with_file_position(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Dense 0-based position in file order (paths as text) for a frame scanned from files.

    How Spark cuts files into tasks can change from job to job. The rows are therefore written once, tagged with their
    block and their number in the task, and counting and numbering both read what was written. Rows are counted per file
    block and the blocks' offsets summed in file order; a row's position is its block's offset plus its index inside the
    block. No global sort. ``df`` must be a plain scan, filtered or not (its rows still carry metadata).
    """
    tagged = materialize(df.select("*", F.col("_metadata.file_path").alias("_path"),
                                   F.col("_metadata.file_block_start").alias("_start"),
                                   F.monotonically_increasing_id().alias("_id")), "tagged")
    blocks = tagged.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    offsets = _running_offsets(blocks, ["_path", "_start"])
    return _placed(tagged, offsets, ["_path", "_start"], F.col("_id") - F.col("_first"), name).drop(
        "_path", "_start", "_id", "_first", "_offset")


def dense_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """0-based rank by a unique key without ordering everything in one task.

    The rows are cut into even ranges by sampling, sorted there, tagged with their task and their number in it, and written
    once. Tasks are in key order, so a row's rank is the count of the rows of earlier tasks plus its own number, however the
    keys are distributed and however the written files are read. The result reads the written table, so using it twice does
    not sort twice.
    """
    number = F.monotonically_increasing_id()
    ordered = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", number).withColumn(
        "_task", F.shiftright("_id", _TASK_SHIFT)), "ordered")
    offsets = _running_offsets(ordered.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")), ["_task"])
    index = F.col("_id") - F.shiftleft("_task", _TASK_SHIFT)
    return _placed(ordered, offsets, ["_task"], index, name).drop("_id", "_task", "_offset")


def rows_at(df: DataFrame, positions: Iterable[int], key: str, total: int | None = None,
            clamp: bool = False) -> DataFrame:
    """Rows at the given positions. A position past the end is an error, or with ``clamp`` the last
    row. Pass ``total`` if the row count is known."""
    total = df.count() if total is None else total
    wanted = [int(p) for p in positions]
    if clamp:
        wanted = [min(p, total - 1) for p in wanted]
    outside = [p for p in wanted if p < 0 or p >= total]
    if outside:
        raise ValueError(f"position(s) {outside} out of range: the table has {total} rows")
    return dense_position(df, key).where(F.col("position").isin(sorted(set(wanted))))


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name}`")
