"""Removal of passages that repeat across documents, wherever in a line they stand.

A word of a document goes if it is in a run of ``words`` words that an earlier document also has. To find all such runs
without comparing every place of every text, each text names the least hash of each window of its half-length runs
(winnowing): two texts with a run in common name one inside it. Only the full runs around a hash that several texts name
are then grouped; the union of those that an earlier text has is the whole passage. Equal texts are one text here: what the
first of them has goes from the others whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import WS, fresh, materialize, ship_by_value, text_of, texts_in
from glosswork.llm.line_dedup import SEPARATORS, Units, repeated_units
from glosswork.session import scratch

_WORD = re.compile(f"[^{WS}]+")
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x ^ (x >> np.uint64(29))) * _ODD


def word_hashes(text: str) -> np.ndarray:
    found = [xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass"), 7) for w in _WORD.findall(text)]
    return np.array(found, np.uint64)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by its place."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    powers = lambda base: np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], (hashes * powers(_BASE)).cumsum(dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * powers(_INVERSE)[:len(hashes) - size + 1])


def anchors(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes that a text names. Every run of ``words`` words has one, which depends on the run only."""
    half = (words + 1) // 2
    runs = run_hashes(hashes, half)
    window = words - half + 1
    if len(runs) < window:
        return np.empty(0, np.int64), runs[:0]
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return at, runs[at]


def runs_around(hashes: np.ndarray, wanted: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places and two hashes of the runs of ``words`` words that hold a wanted anchor."""
    at, found = anchors(hashes, words)
    at = at[np.isin(found, wanted)]
    count, reach = len(hashes) - words + 1, words - (words + 1) // 2
    near = np.unique((at[:, None] - np.arange(reach + 1)[None, :]).ravel())
    near = near[(near >= 0) & (near < count)]
    return near, run_hashes(hashes, words)[near], run_hashes(_mixed(hashes), words)[near]


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """The text without runs of words, given by their first and last word, and the (start, end) of these in it. Of the white
    space around a cut one side stays, that with a line break if one has it."""
    at = [m.span() for m in _WORD.finditer(text)]
    cuts: list[list[int]] = []
    for first, last in sorted(runs):
        if cuts and first <= cuts[-1][1] + 1:
            cuts[-1][1] = max(cuts[-1][1], last)
        else:
            cuts.append([first, last])
    kept, start, spans = [], 0, []
    for first, last in cuts:
        begin, end = at[first][0], at[last][1]
        spans.append({"start": begin, "end": end})
        before = text[at[first - 1][1] if first else 0:begin]
        after = text[end:at[last + 1][0] if last + 1 < len(at) else len(text)]
        if last + 1 == len(at) or "\n" in after and "\n" not in before:
            kept.append(text[start:begin - len(before)])
            start = end if last + 1 < len(at) else len(text)
        else:
            kept.append(text[start:begin])
            start = end + len(after)
    return "".join(kept) + text[start:], spans


def unit_runs(text: str, units: Units, places: list[int] | None = None) -> list[tuple[int, int]]:
    """The first and last word of the units at the given places, or of all that are long enough."""
    out, word = [], 0
    for place, unit in enumerate(text.split(SEPARATORS[units.kind])):
        n = len(_WORD.findall(unit))
        if n >= max(1, units.min_words) if places is None else place in places:
            out.append((word, word + n - 1))
        word += n
    return out


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def repeated_runs(docs: DataFrame, words: int, rank: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(d1, d2, least, more) of each text: the (null, rank) of its first document, and whether there are others; and (d1, d2,
    places) of the runs of texts that an earlier text has too. Texts are told by their hashes."""
    text = text_of(text_col)
    one, two = _key(text)
    rows = docs.select(one.alias("d1"), two.alias("d2"), text.alias("text")).where("text <> ''")
    ranked = docs.where(text != "").select(one.alias("d1"), two.alias("d2"), F.struct(
        F.col(rank).isNull().alias("null"), F.col(rank).alias("rank")).alias("at"))  # null ranks come last
    seen = materialize(ranked.groupBy("d1", "d2").agg(F.min("at").alias("least"), (F.max("at") > F.min("at")).alias("more")), "texts")
    long = pa.list_(pa.int64())
    head, longs = rows.select("d1", "d2"), F.array().cast("array<bigint>")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, "text"):
            found = [np.unique(anchors(word_hashes(t), words)[1]).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, long)], ["d1", "d2", "anchors"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, "text"):
            wanted = batch.column(4).to_pylist()
            found = [runs_around(word_hashes(t), np.array(w, np.int64).view(np.uint64), words) for t, w in zip(texts, wanted)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([f[i].view(np.int64) for f in found], long) for i in range(3)]],
                                             ["d1", "d2", "least", "place", "g1", "g2"])

    # copies name the same anchors: what only they share is not kept
    named = materialize(rows.mapInArrow(name, head.withColumn("anchors", longs).schema).select(
        "d1", "d2", F.explode("anchors").alias("anchor")).where("anchor is not null"), "anchors")
    shared = materialize(named.groupBy("anchor").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("anchor"), "shared")
    wanted = named.join(shared, "anchor").groupBy("d1", "d2").agg(F.collect_set("anchor").alias("wanted"))
    wanted = materialize(wanted.join(seen.drop("more"), ["d1", "d2"]).withColumnsRenamed({"d1": "w1", "d2": "w2"}), "wanted")
    # the few texts with a shared anchor are found first, and each of them once
    opened = rows.join(wanted, (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).dropDuplicates(["w1", "w2"]).select(
        "d1", "d2", "least", "text", "wanted")
    runs = opened.mapInArrow(around, opened.select("d1", "d2", "least").withColumns({"place": longs, "g1": longs, "g2": longs}).schema)
    runs = materialize(runs.select("d1", "d2", "least", F.inline(F.arrays_zip("place", "g1", "g2"))), "runs")
    doc = F.struct("least", "d1", "d2")
    first = materialize(runs.groupBy("g1", "g2").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where(
        "first <> last").select("g1", "g2", "first"), "first")
    later = runs.join(first, ["g1", "g2"]).where(doc != F.col("first")).groupBy("d1", "d2").agg(F.collect_set("place").alias("places"))
    return seen, materialize(later, "later")


def dedup(docs: DataFrame, words: int = 51, rank: str = "doc_id", text_col: str = "text", spans: str = "cut",
          units: Units | None = None) -> DataFrame:
    """The documents without passages of at least ``words`` words that an earlier one has, and a column of the (start, end) of
    what was cut, in code points of the text given, the end exclusive. With ``units`` also without such lines or paragraphs that
    occur before, in an earlier document or in the same.

    Earlier is of less rank (null last), then by text; what is earlier is decided on the texts as given. Runs that repeat inside
    one document stay; rows with equal rank and text are one document and get equal results. Case and white space don't count.
    A null or empty text stays; so does an empty table. A column named like ``spans`` is replaced, other columns stay.
    """
    d1, d2, places, least, lines = (fresh(docs, n) for n in ("_d1", "_d2", "_places", "_least", "_units"))
    none = F.lit(None).cast("array<int>")
    with scratch(docs.sparkSession) as tables:
        seen, later = repeated_runs(docs, words, rank, text_col)
        cuts = seen.where("more").drop("more").join(later, ["d1", "d2"], "full")
        if units:  # those of the first document of a text; in the others every unit is a later one
            found = repeated_units(docs, units, rank, text_col).join(seen.drop("more"), ["d1", "d2"]).where(
                F.col("rank").eqNullSafe(F.col("least")["rank"]))
            cuts = cuts.join(found.select("d1", "d2", F.col("places").alias("lines")), ["d1", "d2"], "full")
        cuts = cuts.select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("places").alias(places), F.col("least")["rank"].alias(
            least + "r"), F.col("least").isNotNull().alias(least), (F.col("lines") if units else none).alias(lines))
        cuts = tables.keep(materialize(cuts, "cuts"))
    one, two = _key(text_of(text_col))
    marked = docs.join(cuts, (one == F.col(d1)) & (two == F.col(d2)), "left")
    marked = marked.withColumn(least, F.col(least) & ~F.col(least + "r").eqNullSafe(F.col(rank))).drop(d1, d2, least + "r", spans)
    names = [c for c in marked.columns if c not in (places, least, lines)]
    at = [c.lower() for c in names].index(text_col.lower())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            texts, removed = batch.column(at).to_pylist(), []
            for i, (here, copy, found) in enumerate(zip(of(places), of(least), of(lines))):
                if copy:
                    n = len(_WORD.findall(texts[i]))
                    runs = [(0, n - 1)] if n >= words else unit_runs(texts[i], units) if units else []
                else:
                    runs = [(p, p + words - 1) for p in here or ()] + (unit_runs(texts[i], units, found) if found else [])
                texts[i], gone = without(texts[i], runs) if runs else (texts[i], [])
                removed.append(gone)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, span)], [*names, spans])

    return marked.mapInArrow(cut, marked.select(names).withColumn(
        spans, F.lit(None).cast("array<struct<start:bigint,end:bigint>>")).schema)


ship_by_value(__name__)
