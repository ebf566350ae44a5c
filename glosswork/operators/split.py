"""Splits, samples and the order of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.fixed_values import BACKGROUND_ROWS, SEED, TEST_SHARE
from glosswork.functions.hashing import key_hash, split_label
from glosswork.sources.csv import dense_position

_FEW = 5_000


def threshold_split(df: DataFrame, key: str = "row_key", share: float = TEST_SHARE,
                    seed: object = SEED) -> DataFrame:
    """Adds ``split``: each row decides by its own hash. No shuffle, about ``share`` test rows."""
    return df.withColumn("split", split_label(key, share, seed))


def _rank_cut(hashed: DataFrame, rank: int) -> str:
    """The hash of the ``rank``-th smallest row (1-based).

    Counts per leading hex digits narrow the search: each round costs one aggregate with at most
    65,536 groups, and hashes spread evenly however skewed the data is.
    """
    prefix, below = "", 0
    while True:
        inside = hashed.where(F.col("_hash").startswith(prefix)) if prefix else hashed
        width = len(prefix) + 4
        counts = (inside.groupBy(F.substring("_hash", 1, width).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
        for row in counts:
            if below + row["n"] >= rank:
                prefix, size = row["p"], row["n"]
                break
            below += row["n"]
        if width >= 32:     # one hash, however many rows repeat its key
            return prefix
        if size <= _FEW:
            rows = (hashed.where(F.col("_hash").startswith(prefix))
                    .select("_hash").orderBy("_hash").limit(rank - below).collect())
            return rows[-1]["_hash"]


def exact_split(df: DataFrame, key: str = "row_key", share: float = TEST_SHARE,
                seed: object = SEED) -> DataFrame:
    """Adds ``split`` with exactly ``ceil(share * n)`` test rows: those with the smallest hashes.

    The cut is found by counting, then every row compares its hash with it. Nothing is sorted and
    the test rows never pass through one task. Keys must be unique.
    """
    hashed = df.select(key_hash(key, seed).alias("_hash"))
    rank = math.ceil(round(share * hashed.count(), 9))
    if rank == 0:
        return df.withColumn("split", F.lit("train"))
    cut = _rank_cut(hashed, rank)
    return df.withColumn("split", F.when(key_hash(key, seed) <= cut, "test").otherwise("train"))


def split_table(df: DataFrame, key: str = "row_key") -> DataFrame:
    return df.select(key, "split")


def apply_split(df: DataFrame, split: DataFrame, key: str = "row_key") -> DataFrame:
    """Rows with the part a saved split table gives them."""
    return df.join(split, key)


def first_rows(df: DataFrame, n: int, key: str = "row_key") -> DataFrame:
    """The first ``n`` rows in key order (each task keeps n, the driver merges them)."""
    return df.orderBy(key).limit(n)


def background_sample(df: DataFrame, n: int = BACKGROUND_ROWS, key: str = "row_key",
                      seed: object = SEED) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest hashes."""
    return df.withColumn("_hash", key_hash(key, f"bg{seed}")).orderBy("_hash").limit(n).drop("_hash")


def explained_rows(df: DataFrame, n: int | None, key: str = "row_key") -> DataFrame:
    """The first ``n`` rows to explain, or all of them."""
    return df if n is None else first_rows(df, n, key)


def by_split(value: Column, part: str) -> Column:
    return F.when(F.col("split") == part, value)


def exact_bootstrap(df: DataFrame, key: str, salts: Sequence[int], total: int | None = None) -> DataFrame:
    """Adds ``draws``, one count per salt: how often the row is among n draws with replacement from the n rows.

    Each draw is a hash of its number and salt, which picks a row by its rank in the order of the unique key. Draws are counted per
    row before they are joined, every salt's counts add up to exactly n, and layout or retries do not change them."""
    placed = dense_position(df, key, "_rank")
    n = placed.count() if total is None else total
    digits = F.substring(F.md5(F.concat_ws(":", "salt", "number")), 1, 13)
    share = F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))
    numbers = df.sparkSession.range(n * len(salts)).select(
        F.element_at(F.array(*map(F.lit, salts)), (F.expr(f"id div {max(n, 1)}") + 1).cast("int")).alias("salt"), (F.col("id") % max(n, 1)).alias("number"))
    picked = numbers.select("salt", F.floor(share * n).alias("_picked"))
    counts = picked.groupBy("_picked").agg(F.array(*[F.count_if(F.col("salt") == s) for s in salts]).alias("draws"))
    none = F.array(*[F.lit(0).cast("bigint")] * len(salts))
    return placed.join(counts, placed["_rank"] == counts["_picked"], "left").withColumn(
        "draws", F.coalesce("draws", none)).drop("_rank", "_picked")
