"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant at most ``radius / 2`` bits from each. Every
fingerprint emits all its variants within half the radius; fingerprints that meet in a variant are linked. Whoever shares a
variant is within the radius by the triangle inequality, so all who meet there are linked to the smallest of them: no link is
lost and no pairs are listed.

The variants are never shuffled one by one. They are dealt by the parities of ``n`` groups of bits. Flipping a bit flips one
parity, so a fingerprint goes to the few parity patterns within half the radius of its own, and the task of a pattern
generates from it just those variants that have the pattern. ``n`` follows from the number of distinct fingerprints, so that
a pattern's variants fit in memory at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import fresh, materialize, ship_by_value, text_of, texts_in

BITS = 64
#: Shingles that are hashed and counted at a time: bounds the memory that a very long text takes.
_SLICE = 65_536
#: Variants that the task of one parity pattern should hold.
_VARIANTS = 1_000_000


def fingerprint(text: str, words: int) -> int:
    """SimHash of the XXH64 values of the ``words``-word shingles, repeats included; zero without a word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    count = max(1, len(parts) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, _SLICE):
        n = min(_SLICE, count - at)
        hashes = np.fromiter((digest(join(parts[i:i + words]), 42) for i in range(at, at + n)), np.uint64, n)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """The columns of a table, with ``fp`` (the fingerprint's 64 bits as a long) in place of its column ``text``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], [*kept, "fp"])

    return docs.mapInArrow(run, docs.select(kept).withColumn("fp", F.lit(0).cast("long")).schema)


def bit_groups(n: int) -> list[list[int]]:
    """The bits, dealt into n groups of sizes at most one apart."""
    return [list(range(g, BITS, n)) for g in range(n)]


def _ball(n: int, most: int) -> list[int]:
    return [sum(1 << i for i in pick) for size in range(most + 1) for pick in combinations(range(n), size)]


def _pattern(fp: Column, groups: list[list[int]]) -> Column:
    parity = [F.bit_count(fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))) % 2 for group in groups]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(p.cast("int"), i) for i, p in enumerate(parity)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks_by_parity(n: int, half: int) -> dict[int, np.ndarray]:
    """Flips of at most ``half`` bits, by the parities that they flip."""
    group_of = {bit: g for g, bits in enumerate(bit_groups(n)) for bit in bits}
    found: dict[int, list[int]] = {}
    for size in range(half + 1):
        for pick in combinations(range(BITS), size):
            parity = 0
            for bit in pick:
                parity ^= 1 << group_of[bit]
            found.setdefault(parity, []).append(sum(1 << b for b in pick))
    return {parity: np.array(masks, np.uint64) for parity, masks in found.items()}


def meet(fps: np.ndarray, flips: np.ndarray, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints that share a variant of one pattern with a smaller one, and the smallest that they reach here.

    flips: the parities that separate each fingerprint from the pattern."""
    order = np.argsort(fps, kind="stable")
    fps, flips = fps[order], flips[order]
    variants, owners = [], []
    for flip in np.unique(flips):
        own, mask = np.flatnonzero(flips == flip), masks[int(flip)]
        variants.append((fps[own][:, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(own, len(mask)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    by = np.argsort(variant, kind="stable")
    variant, owner = variant[by], owner[by]
    same = np.concatenate([[False], variant[1:] == variant[:-1]])
    meets = same | np.concatenate([same[1:], [False]])
    owner, starts = owner[meets], np.flatnonzero(~same[meets])
    label = np.arange(len(fps))
    if len(owner):
        lengths = np.diff(np.append(starts, len(owner)))
        while True:
            before = label.copy()
            np.minimum.at(label, owner, np.repeat(np.minimum.reduceat(label[owner], starts), lengths))
            label = label[label]
            if np.array_equal(before, label):
                break
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def fingerprint_links(fps: DataFrame, radius: int, count: int) -> DataFrame:
    """(high, low): links between distinct fingerprints, enough to connect all those within ``radius`` bits.

    fps: one column fp, distinct. count: about how many there are; it sets only into how many patterns they are dealt."""
    half = (radius + 1) // 2  # radius 4: every pair has a variant within 2 of both
    if radius % 2:
        raise ValueError("the radius must be even: fingerprints that meet half way are then within it")
    variants = sum(math.comb(BITS, i) for i in range(half + 1))
    n = min(24, max(6, math.ceil(math.log2(max(1, count * variants / _VARIANTS)))))
    flips, masks = _ball(n, half), masks_by_parity(n, half)
    dealt = fps.select("fp", _pattern(F.col("fp"), bit_groups(n)).alias("own")).select(
        "fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"), "own").select(
        F.col("own").bitwiseXOR(F.col("flip")).alias("pattern"), "fp", "flip")

    def run(group: pa.Table) -> pa.Table:
        high, low = meet(group.column("fp").to_numpy().astype(np.int64).view(np.uint64),
                         group.column("flip").to_numpy(), masks)
        return pa.table({"high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64))})

    return dealt.groupBy("pattern").applyInArrow(run, "high long, low long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of an undirected graph that isn't the representative of its component, with that.

    Each round a node keeps its link to the least of its neighbours on one side and hands the others on to it, until every
    node has one such link; the resulting trees are then flattened by pointer jumping. Only a node's links on its own side
    are joined, so a hub in many links doesn't make a hot key. Each round is a written table."""
    edges = materialize(links.select(F.greatest("high", "low").alias("u"), F.least("high", "low").alias("v")).where(
        "u <> v").distinct(), "links")
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("f"), F.count("*").alias("n"))
        if least.where("n > 1").isEmpty():
            break
        moved = edges.join(least, "u")
        edges = materialize(moved.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("f").alias("v")),
            F.struct(F.greatest("v", "f").alias("u"), F.least("v", "f").alias("v")))).alias("e")).select("e.*").where(
            "u <> v").distinct(), "links")
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(tree.join(above, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "trees")
        tree = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return tree


def _rooted(prints: DataFrame, least: Column, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, least, root) and (root, least): the least value of each fingerprint's rows, and of each component's."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    links = fingerprint_links(nodes.select("fp"), radius, nodes.count())
    roots = components(links).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that a join with a component of very many fingerprints can be split
    return rooted, materialize(rooted.groupBy("root").agg(F.min("least").alias("least")), "least")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id that links reach from it.

    A null or empty text, or one of white space only, has fingerprint zero, which links like any other. Rows with equal
    texts or fingerprints are in one component; repeated rows stay. A null id never is the smallest; a component of null ids
    only has a null. An empty table gives none. Other columns are ignored.
    """
    prints = materialize(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words),
                         "fingerprints")
    rooted, least = _rooted(prints, F.col("id"), radius)
    of_print = materialize(rooted.select("fp", "root").join(least, "root").select("fp", F.col("least").alias("component")),
                           "components")
    return prints.join(of_print, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table, one of each component of near duplicates: the one of the least id, null last.

    Of rows with equal ids one with the least hash of the text stays, and of equal rows of that kind one. Texts without a word
    are one group. Columns stay as they are; an empty table gives none.
    """
    i, h1, h2 = (fresh(docs, n) for n in ("_id", "_h1", "_h2"))
    text = text_of(text_col)
    keyed = docs.withColumns({i: F.col(id_col), h1: F.xxhash64(text), h2: F.xxhash64(F.lit("second"), text)})
    wanted = keyed.select(F.col(i).alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), text.alias("text"))
    prints = materialize(with_fingerprints(wanted, words), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "h1", "h2")
    _, least = _rooted(prints, order, radius)
    keep = least.select(F.col("least.id").alias("id"), F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2"))
    # equal rows are reduced before the shuffle that the join needs anyway
    single = keyed.dropDuplicates([i, h1, h2])
    return single.join(keep, single[i].eqNullSafe(keep["id"]) & (single[h1] == keep["h1"]) & (single[h2] == keep["h2"]),
                       "left_semi").select(docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


ship_by_value(__name__)
