"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its key. Each shard owns the arcs that end at its virtual nodes and takes the rows of
its own arcs up to its capacity; the rest of an arc continues clockwise to the next shards that are not full. Only the number
of rows per arc decides where an arc's rows go, and there are shards x virtual nodes arcs, so the driver plans the flow from
that many numbers. Rows find their shard and slot from their number within the arc, which a running count over small, even
blocks gives: no shard, arc or key gathers in a task.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.common import materialize, ship_by_value, text_of
from glosswork.session import local_table

#: Rows that a block within an arc should have, and the least number of blocks in an arc.
_BLOCK, _BLOCKS = 50_000, 8


@dataclass(frozen=True)
class Segment:
    """Rows [low, high) of an arc, which go to ``shard`` from ``slot`` on."""

    arc: int
    low: int
    high: int
    shard: int
    slot: int


class Ring:
    def __init__(self, shards: int, nodes: int):
        self.shards = shards
        points = sorted((xxhash.xxh64_intdigest(f"{s}:{n}".encode()), s) for s in range(shards) for n in range(nodes))
        self.points = np.array([p for p, _ in points], np.uint64)
        self.owner = [s for _, s in points]

    def arc(self, places: np.ndarray) -> np.ndarray:
        """The arcs of ring places: the first virtual node at or after each."""
        return (np.searchsorted(self.points, places.astype(np.int64).view(np.uint64)) % len(self.points)).astype(np.int32)

    def capacities(self, rows: int, slack: float) -> list[int]:
        """Without slack the counts that are at most one apart, else an equal bound above the mean."""
        if slack:
            return [math.ceil((1 + slack) * rows / self.shards)] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]

    def plan(self, counts: list[int], slack: float = 0.0) -> list[Segment]:
        """Where the rows of each arc go. Own rows first, arc by arc; then the overflow, clockwise."""
        space = self.capacities(sum(counts), slack)
        taken: list[tuple[int, int, int, int]] = []  # arc, low, high, shard
        waiting: list[int] = []
        for arc, n in enumerate(counts):
            own = min(n, space[self.owner[arc]])
            space[self.owner[arc]] -= own
            waiting.append(own)
            if own:
                taken.append((arc, 0, own, self.owner[arc]))
        carried: deque[list[int]] = deque()  # arc, low, high
        for step in range(2 * len(counts)):
            arc = step % len(counts)
            shard = self.owner[arc]
            while carried and space[shard]:
                first = carried[0]
                some = min(space[shard], first[2] - first[1])
                taken.append((first[0], first[1], first[1] + some, shard))
                space[shard] -= some
                first[1] += some
                if first[1] == first[2]:
                    carried.popleft()
            if step < len(counts) and waiting[arc] < counts[arc]:
                carried.append([arc, waiting[arc], counts[arc]])
        used, out = [0] * self.shards, []
        for arc, low, high, shard in sorted(taken):
            out.append(Segment(arc, low, high, shard, used[shard]))
            used[shard] += high - low
        return out


def _arc_of(ring: Ring, place: Column) -> Column:
    @F.pandas_udf("int")
    def find(places: pd.Series) -> pd.Series:
        return pd.Series(ring.arc(places.to_numpy()))

    return find(place)


def shard_rows(rows: DataFrame, key: str, shards: int = 8, nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """The rows with two more columns: shard, from 0, and slot, the row's number within the shard, gapless from 0.

    Without slack the shards' counts are at most one apart. The result depends on the rows' values only. Equal rows are
    counted before they are shuffled and share a run of slots. Null keys have one place on the ring. Any columns are allowed
    that can be grouped by; one named shard or slot is an error, and an empty table gives none.
    """
    if {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError("the rows have a column shard or slot")
    ring = Ring(shards, nodes)
    inner = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    columns = inner.columns
    place = F.xxhash64(F.col(columns[[c.lower() for c in rows.columns].index(key.lower())]))
    counted = inner.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("place", place)
    counted = materialize(counted.withColumn("arc", _arc_of(ring, F.col("place"))), "ring")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(_BLOCKS, -(-total // (len(ring.owner) * _BLOCK)))
    blocked = counted.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy("arc", "block").agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(sizes.withColumn("start", F.coalesce(before, F.lit(0))).select("arc", "block", "rows", "start"), "starts")
    counts = dict(starts.groupBy("arc").agg(F.sum("rows")).collect())  # one number per arc at most
    plan = ring.plan([counts.get(a, 0) for a in range(len(ring.owner))], slack)
    by_arc: dict[int, list[tuple]] = {}
    for s in plan:
        by_arc.setdefault(s.arc, []).append((s.low, s.high, s.shard, s.slot))
    segments = local_table(rows.sparkSession, [(a, s) for a, s in sorted(by_arc.items())],
                           "arc int, segments array<struct<low: long, high: long, shard: int, slot: long>>")
    running = F.sum("n").over(Window.partitionBy("arc", "block").orderBy("place", *columns).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    numbered = blocked.withColumn("until", running).join(starts.select("arc", "block", "start"), ["arc", "block"])
    # a table of at most two segments per virtual node and shard: bounded by the parameters
    numbered = numbered.join(F.broadcast(segments), "arc")
    each = numbered.select(*columns, "segments", F.explode(F.sequence(
        F.col("start") + F.col("until") - F.col("n"), F.col("start") + F.col("until") - 1)).alias("at"))
    found = each.withColumn("s", F.filter("segments", lambda s: (s["low"] <= F.col("at")) & (F.col("at") < s["high"]))[0])
    return found.select(*[F.col(c).alias(name) for c, name in zip(columns, rows.columns)], F.col("s.shard").alias("shard"),
                        (F.col("s.slot") + F.col("at") - F.col("s.low")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document, by doc_id; a null text is empty. The texts don't move."""
    text = text_of()
    return shard_rows(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast(
        "binary")).alias("text_crc32")), "doc_id", shards)


ship_by_value(__name__)
