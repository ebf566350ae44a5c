"""Exact percentiles whose memory does not grow with the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.numeric import rounded

#: Rows that one pass may send to the driver, shared by all order statistics that are still open.
BUCKETS = 1 << 16
_INF = float("inf")


def _clean(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def exact_percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]],
                      buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Linear-interpolated percentiles per column, nulls and NaN left out; None for an empty column.

    The built-in exact percentile keeps every distinct value in one task, which fails on big data.
    Here each wanted order statistic is found by counting, and the same way for a table of any size,
    so the result does not depend on ``buckets`` or on the layout.
    """
    names = [n for n in wanted if len(wanted[n])]
    if not names:
        return {n: [] for n in wanted}
    aggs = []
    for i, n in enumerate(names):
        c = _clean(n)
        inner = F.when(F.abs(c) < F.lit(_INF), c)
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c == F.lit(-_INF)).alias(f"below{i}"), F.count(inner).alias(f"in{i}"),
                 F.min(inner).alias(f"low{i}"), F.max(inner).alias(f"high{i}")]
    row = df.agg(*aggs).first()
    counts = {n: row[f"n{i}"] for i, n in enumerate(names)}
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}  # low and high of the values left, and how many are below
    for i, n in enumerate(names):
        for p in wanted[n] if counts[n] else ():
            h = p * (counts[n] - 1)
            for k in (math.floor(h), math.ceil(h)):
                if k < row[f"below{i}"]:
                    found[n, k] = -_INF
                elif k >= row[f"below{i}"] + row[f"in{i}"]:
                    found[n, k] = _INF
                else:
                    open_[n, k] = (row[f"low{i}"], row[f"high{i}"], row[f"below{i}"])
    found |= order_statistics(df, open_, buckets)

    def at(n: str, p: float) -> float | None:
        if not counts[n]:
            return None
        h = p * (counts[n] - 1)
        low, high = found[n, math.floor(h)], found[n, math.ceil(h)]
        return low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high

    return {n: [at(n, p) for p in ps] for n, ps in wanted.items()}


def order_statistics(df: DataFrame, wanted: Mapping[tuple[str, int], tuple[float, float, int]], buckets: int) -> dict[tuple[str, int], float]:
    """The k-th smallest value (0-based) for each (column, k), given the least and the greatest value that it can be, and how many
    values are below these.

    Every pass counts the values of all open ranges in buckets of equal width, with the least and greatest value of each; a rank
    goes on with the bucket that holds it. Tasks add up their counts, so what moves and what the driver gets is at most
    ``buckets`` rows and one per range, and no value is ever sorted. A range shrinks to the values of its bucket, and each
    pass cuts off its ends, so it comes down to one value."""
    found = {key: low for key, (low, high, _) in wanted.items() if low == high}
    open_ = {key: span for key, span in wanted.items() if key not in found}
    while open_:
        ranges = sorted({(key[0], low, high) for key, (low, high, _) in open_.items()})
        width = max(2, buckets // len(ranges))
        by_column: dict[str, list[Column]] = {}
        for i, (name, low, high) in enumerate(ranges):
            c = _clean(name)
            # halves, as the whole width may be beyond a double; the quotient rises with the value
            share = (c / 2 - F.lit(low / 2)) / F.lit(max(high / 2 - low / 2, 5e-324))
            bucket = F.when(c == F.lit(low), 0).when(c == F.lit(high), width).otherwise(F.least(
                F.floor(share * (width - 1)) + 1, F.lit(width - 1)))
            by_column.setdefault(name, []).append(F.when(c.between(F.lit(low), F.lit(high)), F.struct(
                F.lit(i).alias("range"), bucket.cast("int").alias("bucket"), c.alias("value"))))
        # the ranges of a column have no value in common but for their ends, which are then one-value ranges and not open
        each = df.select(F.explode(F.array(*[F.coalesce(*spans) for spans in by_column.values()])).alias("x")).where(
            "x is not null").select("x.*")
        rows = each.groupBy("range", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        held: dict[tuple, list] = {r: [] for r in ranges}
        for r in rows:
            held[ranges[r["range"]]].append(r)
        for spans in held.values():
            spans.sort(key=lambda r: r["bucket"])
        for key, (low, high, below) in list(open_.items()):
            for r in held[key[0], low, high]:
                if key[1] < below + r["n"]:
                    break
                below += r["n"]
            if r["low"] == r["high"]:
                found[key] = r["low"]
                del open_[key]
            else:
                open_[key] = (r["low"], r["high"], below)
    return found


def medians(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> dict[str, float | None]:
    return {n: q[0] for n, q in exact_percentiles(df, {n: [0.5] for n in columns}, buckets).items()}


def rounded_columns(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})
