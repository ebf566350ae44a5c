"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.session import materialize, ship_by_value

__all__ = ["WS", "documents", "fresh", "joined_spans", "let", "materialize", "prefix_sums", "ship_by_value", "table", "text_of",
           "texts_in", "words_of"]

#: Fixed value: the white space that ends a word, as the inside of a character class.
WS = r"\x20\x09-\x0D"
_CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs without white space; an empty array if there are none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS}]+"))


def _running(sizes: Column) -> Column:
    """0, then the sum so far after each element."""
    return F.aggregate(sizes, F.array(F.lit(0).cast("long")),
                       lambda seen, size: F.concat(seen, F.array(F.element_at(seen, -1) + size)))


def prefix_sums(sizes: Column) -> Column:
    """For each element of an array of longs, the sum of those before it.

    Sums run over chunks, so that growing the accumulators stays cheap for arrays of many elements."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(_CHUNK)),
                         lambda at: _running(F.slice(sizes, at + 1, F.lit(_CHUNK))))
    return let(chunks, lambda runs: let(
        _running(F.transform(runs, lambda run: F.element_at(run, -1))),
        lambda starts: F.flatten(F.transform(
            runs, lambda run, i: F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda x: x + starts[i])))))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def texts_in(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each Arrow batch with its texts; a null is an empty text."""
    for batch in batches:
        yield batch, [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
