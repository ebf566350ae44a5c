"""Substring deduplication by line or paragraph hashing.

Each unit of each text is normalised and hashed to 128 bits. Per hash the earliest occurrence (by rank, then place) is found
with a combining aggregate, written, and joined back to the units, so that a very common line makes no hot task. Later
occurrences are cut out of the texts; their places in the original text are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import WS, fresh, materialize, ship_by_value, text_of, words_of

#: What separates units. Paragraphs are separated by empty lines.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}


@dataclass(frozen=True)
class Units:
    """kind: line or paragraph. Units of fewer than ``min_words`` words are left alone."""

    kind: str = "line"
    min_words: int = 5


def _normal(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(unit, F.lit(" \t\n\x0b\x0c\r"))), f"[{WS}]+", " ")


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def repeated_units(docs: DataFrame, units: Units, rank: str, text_col: str = "text") -> DataFrame:
    """(rank, d1, d2, places): for the documents with later occurrences of units, the ascending numbers of these units.

    A document is told by its rank and its text's hashes; rows that agree on both are one document."""
    rows = docs.select(F.col(rank).alias("rank"), text_of(text_col).alias("text")).where("text <> ''")
    found = rows.select("rank", *[h.alias(f"d{i}") for i, h in enumerate(_hashes(F.col("text")), 1)], F.posexplode(
        F.split("text", SEPARATORS[units.kind], -1)).alias("place", "unit"))
    long = F.char_length("unit") >= 2 * units.min_words - 1  # a quick look before the words are counted
    kept = found.where(long & (F.size(words_of(F.col("unit"))) >= units.min_words)).withColumn("unit", _normal(F.col("unit")))
    hashed = materialize(kept.select("rank", "d1", "d2", "place", *[h.alias(f"u{i}") for i, h in enumerate(
        _hashes(F.col("unit")), 1)]), "units")
    place = F.struct(F.col("rank").isNull().alias("null"), "rank", "d1", "d2", "place")  # null ranks come last
    first = materialize(hashed.groupBy("u1", "u2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(
        "n > 1").select("u1", "u2", "first"), "first")
    later = hashed.join(first, ["u1", "u2"]).where(place != F.col("first"))
    return later.groupBy("rank", "d1", "d2").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup(docs: DataFrame, units: Units = Units(), rank: str = "doc_id", text_col: str = "text",
          spans: str = "removed") -> DataFrame:
    """The documents with repeated units cut out, and a column of the (start, end) of what was cut, in code points of the
    original text, the end exclusive.

    Of the equal units of all texts the earliest stays: least rank (null last), then, among equal ranks, by text and place.
    What is left of a text is its other units, joined as they were. Rows with equal rank and text are one document and get
    equal results. A null or empty text stays as it is, without cuts; so does an empty table. A column named like ``spans`` is
    replaced, other columns stay.
    """
    r, d1, d2, places = (fresh(docs, n) for n in ("_rank", "_d1", "_d2", "_places"))
    later = repeated_units(docs, units, rank, text_col).toDF(r, d1, d2, places)
    hashes = _hashes(text_of(text_col))
    marked = docs.join(later, F.col(rank).eqNullSafe(F.col(r)) & (hashes[0] == F.col(d1)) & (hashes[1] == F.col(d2)), "left")
    marked = marked.drop(r, d1, d2, spans)
    separator = SEPARATORS[units.kind]
    names = [c for c in marked.columns if c != places]
    at = [c.lower() for c in names].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cuts = batch.column(batch.schema.get_field_index(places)).to_pylist()
            texts = batch.column(at).to_pylist()
            removed = [[] for _ in texts]
            for i, cut in enumerate(cuts):
                if cut:
                    texts[i], removed[i] = without(texts[i], set(cut), separator)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, span)], [*names, spans])

    schema = marked.select(names).withColumn(spans, F.lit(None).cast("array<struct<start:bigint,end:bigint>>")).schema
    return marked.mapInArrow(run, schema)


def without(text: str, places: set[int], separator: str) -> tuple[str, list[dict]]:
    """The text without the units at the given places, and where these were."""
    kept, cut, start = [], [], 0
    for place, unit in enumerate(text.split(separator)):
        if place in places:
            cut.append({"start": start, "end": start + len(unit)})
        else:
            kept.append(unit)
        start += len(unit) + len(separator)
    return separator.join(kept), cut


ship_by_value(__name__)
