"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of rotated vectors, the rotations learned by iterative quantisation on a bounded sample. A code is split
into substrings, each the key of a table of its own. By the pigeonhole principle two codes within a radius have a substring
within radius / substrings, so a query that probes all buckets so near to its own, in every table, retrieves every code
within the radius. Retrieved vectors are then ranked by their exact inner products.

The radius is fitted: the smallest that holds the wanted share of the true neighbours of a sample of queries. A bucket group
is a range of substring values; groups with many rows are salted, and so are the queries, so a group that a task holds has a
bounded size, also if a third of all vectors are equal. Each group gives a query's best rows only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.common import materialize, ship_by_value
from glosswork.session import local_table


@dataclass(frozen=True)
class Plan:
    """bits: code length, a multiple of 32; tables of 32-bit substrings. sample: vectors that the rotations are learned from;
    probe_queries: queries that the radius is fitted on; coverage: share of their neighbours within it. group_rows and
    group_queries bound what one task holds at a time."""

    bits: int = 128
    sample: int = 4096
    rounds: int = 30
    probe_queries: int = 128
    coverage: float = 0.97
    group_rows: int = 16_384
    group_queries: int = 4096
    seed: int = 7


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def learn_rotations(sample: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and a matrix whose products with centred vectors have the codes' bits as signs."""
    rng, mean = np.random.default_rng(plan.seed), sample.mean(0)
    centred, dim = sample - mean, sample.shape[1]
    turns = []
    while sum(t.shape[1] for t in turns) < plan.bits:
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(plan.rounds):
            signs = np.where(centred @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(centred.T @ signs)
            turn = left @ right
        turns.append(turn)
    return mean, np.concatenate(turns, axis=1)[:, :plan.bits]


def codes_of(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One row of 32-bit substrings per vector."""
    return np.packbits((vectors - mean) @ turn >= 0, axis=1).view(np.uint32)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), "<f8").reshape(len(values), -1)


def _substrings(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties to the smaller id."""
    if len(scores) > 4 * most:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return near[np.lexsort((ids[near], -scores[near]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def scores_of(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; each depends on its two vectors only, not on the others in the matrix."""
    return (vectors * query).sum(axis=1)


class Search:
    """An index and its fitted parameters."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, most: int, plan: Plan = Plan()):
        """Index all usable rows. Vectors of another length than the commonest take no part."""
        self.plan, self.most = plan, most
        good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("vector")))
        sizes = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        self.rows = None
        if sizes is None:
            return
        self.dim = sizes["dim"]
        good = good.where(F.size("vector") == self.dim)
        first = good.orderBy(F.xxhash64("id"), "id").limit(plan.sample).collect()  # bounded by the parameter
        sample = np.array([r["vector"] for r in first], np.float64)
        self.mean, self.turn = learn_rotations(sample, plan)
        mean, turn = self.mean, self.turn

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                vectors = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(lists), -1)
                codes = codes_of(vectors, mean, turn) if len(vectors) else np.zeros((0, 1), np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(
                    [v.tobytes() for v in vectors], pa.binary())], ["id", "code", "vector"])

        self.rows = materialize(good.mapInArrow(encode, "id long, code binary, vector binary"), "codes")
        self.count = self.rows.count()
        self.radius = self._fit([r["id"] for r in first[:plan.probe_queries]], sample[:plan.probe_queries])

    def _fit(self, ids: list[int], queries: np.ndarray) -> int:
        """The radius that holds ``coverage`` of the true neighbours of a few queries among all rows."""
        codes, most = codes_of(queries, self.mean, self.turn), self.most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, vectors = batch.column(0).to_numpy(), _matrix(batch.column(2))
                subs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(len(own), -1)
                out = []
                for i, query in enumerate(queries):
                    score = np.where(own == ids[i], -np.inf, vectors @ query)
                    top = best(score, own, most)
                    far = np.bitwise_count(subs[top] ^ codes[i]).sum(axis=1)
                    out += [(i, float(s), int(d)) for s, d in zip(score[top], far) if s > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), ()), (
                    pa.int32(), pa.float64(), pa.int32()))], ["query", "score", "far"])

        ranked = Window.partitionBy("query").orderBy(F.desc("score"))
        near = self.rows.mapInArrow(scan, "query int, score double, far int").withColumn("n", F.row_number().over(ranked)).where(
            F.col("n") <= most).select("far").collect()  # at most probe_queries x most rows
        far = sorted(r["far"] for r in near)
        return far[min(len(far) - 1, math.ceil(self.plan.coverage * len(far)) - 1)] if far else self.plan.bits

    def nearest(self, is_query: Column) -> DataFrame:
        """(query, id, score, rank) of the nearest rows found for each row with ``is_query`` (a condition on id).

        The rows are those within the radius; queries with too few of these get the nearest of all rows. Of rows that share
        a query's id one is the query, the one of the least bytes; none of them is a candidate for it."""
        queries = self.rows.where(is_query).groupBy("id").agg(F.min(F.struct("vector", "code")).alias("x")).select(
            F.col("id").alias("query"), "x.code", "x.vector")
        queries = materialize(queries, "queries")
        found = materialize(self._probe(queries, self.radius), "found")
        few = queries.select("query").join(found.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(
            F.coalesce("n", F.lit(0)) < self.most).select("query")
        few = materialize(few, "few")
        if few.isEmpty():
            return found
        rest = self._probe(queries.join(few, "query"), self.plan.bits)
        return found.join(few, "query", "left_anti").unionByName(rest)

    def _probe(self, queries: DataFrame, radius: int) -> DataFrame:
        plan, most, tables = self.plan, self.most, self.plan.bits // 32
        near = radius // tables  # pigeonhole: some substring is at most so far
        used = tables if radius < plan.bits else 1  # at the full radius one table has every pair
        prefix = min(12, max(0, math.ceil(math.log2(max(1, self.count / plan.group_rows)))))
        query_salts = max(1, -(-queries.count() // plan.group_queries))

        def entries(df: DataFrame) -> DataFrame:
            """A row per table: its number and the first bits of the substring."""
            value = lambda j: F.conv(F.hex(F.substring("code", 4 * j + 1, 4)), 16, 10).cast("long")
            first = lambda j: F.shiftrightunsigned(value(j), 32 - prefix)
            return df.withColumn("entry", F.explode(F.array(*[F.struct(
                F.lit(j).alias("table"), first(j).cast("int").alias("prefix")) for j in range(used)]))).select(
                    *df.columns, "entry.*")

        rows = entries(self.rows)
        per = rows.groupBy("table", "prefix").count().collect()  # at most tables x 4096 numbers
        salts = {(r["table"], r["prefix"]): max(1, -(-r["count"] // plan.group_rows)) for r in per}
        salted = F.broadcast(local_table(self.rows.sparkSession, [(t, p, s) for (t, p), s in salts.items()],
                                         "table int, prefix int, salts int"))
        dealt = rows.join(salted, ["table", "prefix"]).select(
            "table", "prefix", F.pmod(F.xxhash64("id", "vector"), F.col("salts")).alias("salt"),
            F.explode(F.sequence(F.lit(0), F.lit(query_salts - 1))).alias("query_salt"), "id", "code", "vector")
        # a query goes to every prefix from which a substring within the radius may follow
        own = entries(queries).withColumnRenamed("prefix", "own").join(salted, "table").where(
            F.bit_count(F.col("own").bitwiseXOR(F.col("prefix"))) <= near)
        asked = own.select("table", "prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"),
                           F.pmod(F.xxhash64("query"), F.lit(query_salts)).cast("int").alias("query_salt"),
                           "query", "code", "vector")
        keys = ["table", "prefix", "salt", "query_salt"]

        def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if left.num_rows and right.num_rows:
                table, ids, vectors = key[0].as_py(), left.column("id").to_numpy(), _matrix(left.column("vector"))
                codes, inverse = np.unique(_substrings(left.column("code")), axis=0, return_inverse=True)
                by_code = np.argsort(inverse.ravel(), kind="stable")  # the rows of each distinct code
                starts = np.searchsorted(inverse.ravel()[by_code], np.arange(len(codes) + 1))
                lengths = np.diff(starts)
                names, asks, subs = right.column("query").to_numpy(), _matrix(right.column("vector")), _substrings(
                    right.column("code"))
                for at in range(0, len(names), 128):
                    block = subs[at:at + 128]
                    far = [distances(block[:, j], codes[:, j]) for j in range(tables)]
                    hit = (far[table] <= near) & (sum(f.astype(np.uint16) for f in far) <= radius)
                    for j in range(table):  # the pair belongs to the first table that has it
                        hit &= far[j] > near
                    for i, mask in enumerate(hit):
                        some = np.flatnonzero(mask)
                        if not len(some):
                            continue
                        if len(codes) == len(ids):
                            places = by_code[some]
                        else:
                            places = by_code[np.repeat(starts[some] - np.cumsum(lengths[some]) + lengths[some], lengths[some]) +
                                             np.arange(lengths[some].sum())]
                        places = places[ids[places] != names[at + i]]
                        score = scores_of(vectors[places], asks[at + i])
                        top = best(score, ids[places], most)
                        out.append((np.full(len(top), names[at + i]), ids[places][top], score[top]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table({"query": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(
                columns[2], pa.float64())})

        hits = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query long, id long, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest_neighbours(rows: DataFrame, is_query: Column, most: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", plan: Plan = Plan()) -> DataFrame:
    """(query_id, rank, vec_id, score): the rows of largest inner product found for each query, nearest first.

    is_query: a condition on the column id. Rows with a null id or an unusable vector take no part; repeated rows are
    candidates each; ties go to the smaller id. A table without usable vectors gives none. Other columns are ignored.
    """
    search = Search(rows, id_col, vector_col, most, plan)
    if search.rows is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search.nearest(is_query).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                                           F.col("id").alias("vec_id"), "score")


ship_by_value(__name__)
