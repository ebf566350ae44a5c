"""Mutual information from nearest neighbours, for rows spread over many tasks.

Two numbers are compared by the first estimator of Kraskov, Stögbauer and Grassberger (2004), a number and a class by that of
Ross (2014). Both need, for each row, the distance to its k-th neighbour (the greater of the two differences) and then how many
rows are nearer than that in one dimension.

Neighbours: the rows are cut into slabs by x, each searched by one task, which halves it into small boxes. A row whose distance
reaches beyond its slab also visits those other slabs that can hold something nearer. Counts: the ends of each row's interval are
sorted among the values, tasks number what they hold, and the numbers of the tasks before are added. Nothing compares all rows
with each other.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosswork.functions.hashing import uniform
from glosswork.operators.features import mutual_information
from glosswork.session import local_table, materialize, ship_by_value

NEIGHBOURS = 3
#: Rows of one slab, which a task holds in memory.
SLAB = 1 << 16
#: Half the width of what is added to a number so that equal ones differ, as a part of it (of 1, if it is less).
_BLUR = 1e-10
#: Points that are compared one by one, rows that are asked for at a time, and boxes these may have to look at.
_LEAF, _ASKED, _PAIRS = 16, 4096, 1 << 20
_INF = float("inf")
_EULER = 0.5772156649015329
_GROUP = ["feature", "class"]


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on."""
    exact = [sum(1 / i for i in range(1, m)) - _EULER for m in range(1, 16)]
    x = n.cast("double")
    t = 1 / (x * x)
    series = F.log(x) - 0.5 / x - t * (1 / 12 - t * (1 / 120 - t * (1 / 252 - t * (1 / 240 - t / 132))))
    return F.when(n > len(exact), series).otherwise(F.element_at(F.array(*map(F.lit, exact)), n.cast("int")))


# ---- distances to the k-th neighbour ------------------------------------------------------------------------

def _highest(v: np.ndarray) -> np.ndarray:
    return np.where(v < _INF, v, -_INF).max(axis=1)


def _boxes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least and greatest x and y of each row of points, ``(4, rows)``; what is infinite only fills up."""
    return np.stack([x.min(axis=1), _highest(x), y.min(axis=1), _highest(y)])


def _halved(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The points cut at the median of the wider side, again and again until at most ``_LEAF`` are together: their places
    ``(leaves, points)``, filled up with -1, and the boxes around them, from the one around all to those of the leaves."""
    cuts = max(0, math.ceil(math.log2(len(x) / _LEAF)))
    places = np.full((1, -(-len(x) >> cuts) << cuts), -1)
    places[0, :len(x)] = np.arange(len(x))
    x, y = np.append(x, _INF), np.append(y, _INF)
    for _ in range(cuts):
        px, py = x[places], y[places]
        left, right, low, high = _boxes(px, py)
        half = places.shape[1] // 2
        cut = np.argpartition(np.where((right - left >= high - low)[:, None], px, py), half, axis=1)
        places = np.take_along_axis(places, cut, axis=1).reshape(-1, half)
    boxes = [_boxes(x[places], y[places])]
    for _ in range(cuts):
        pairs = boxes[0].reshape(4, -1, 2)
        low, high = pairs.min(axis=2), pairs.max(axis=2)
        boxes.insert(0, np.stack([low[0], high[1], low[2], high[3]]))
    return places, boxes


def _gap(boxes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far each box is from a point, less than nothing inside."""
    return np.maximum(np.maximum(boxes[0] - x, x - boxes[1]), np.maximum(boxes[2] - y, y - boxes[3]))


def nearest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: np.ndarray, limit: np.ndarray,
            own: np.ndarray | None = None) -> np.ndarray:
    """For each q the k least distances to the points p: one row each, filled up with infinity. What is not below ``limit`` may
    be missing. With ``own``, the places of the q among the p, these are left out.

    The points are halved into leaves with boxes around them. A q looks at one leaf near it, then at the others, nearest box
    first, until no box is nearer than what it has; so it meets few points, however many the slab holds beside it."""
    best = np.full((len(qx), int(k.max())), _INF)
    if not len(px):
        return best
    with np.errstate(over="ignore", invalid="ignore"):
        places, boxes = _halved(px, py)
        x, y = np.append(px, _INF)[places], np.append(py, _INF)[places]
        todo = [np.arange(at, min(at + _ASKED, len(qx))) for at in range(0, len(qx), _ASKED)]
        while todo:
            rows = todo.pop()
            found = _search(places, x, y, boxes, qx[rows], qy[rows], k[rows], limit[rows], None if own is None else own[rows], best.shape[1])
            if found is None:
                todo += np.array_split(rows, 2)
            else:
                best[rows] = found
    return best


def _search(places: np.ndarray, px: np.ndarray, py: np.ndarray, boxes: list[np.ndarray], x: np.ndarray, y: np.ndarray,
            k: np.ndarray, limit: np.ndarray, own: np.ndarray | None, width: int) -> np.ndarray | None:
    """The distances for some q; None if they have more than ``_PAIRS`` boxes to look at, and are more than one."""
    every = np.arange(len(x))
    found, reach = np.full((len(x), width), _INF), limit.copy()

    def look(who: np.ndarray, leaf: np.ndarray) -> None:
        apart = np.maximum(np.abs(px[leaf] - x[who, None]), np.abs(py[leaf] - y[who, None]))
        if own is not None:
            apart[places[leaf] == own[who, None]] = _INF
        both = np.concatenate([found[who], apart], axis=1)
        both.partition(width - 1, axis=1)
        found[who] = both = np.sort(both[:, :width], axis=1)
        reach[who] = np.minimum(both[np.arange(len(who)), k[who] - 1], limit[who])

    first = np.zeros(len(x), np.int64)
    for level in boxes[1:]:
        first = 2 * first + (_gap(level[:, 2 * first + 1], x, y) < _gap(level[:, 2 * first], x, y))
    look(every, first)

    who, box, gap = every, np.zeros(len(x), np.int64), _gap(boxes[0], x, y)
    for level in boxes[1:]:
        who, box = np.repeat(who, 2), np.stack([2 * box, 2 * box + 1], axis=1).ravel()
        gap = _gap(level[:, box], x[who], y[who])
        on = gap < reach[who]
        who, box, gap = who[on], box[on], gap[on]
        if len(who) > _PAIRS and len(x) > 1:
            return None
    on = box != first[who]
    who, box, gap = who[on], box[on], gap[on]
    order = np.lexsort((gap, who))
    who, box, gap = who[order], box[order], gap[order]
    at, end = np.searchsorted(who, every), np.searchsorted(who, every, side="right")
    rows = every[at < end]
    while rows.size:
        rows = rows[gap[at[rows]] < reach[rows]]
        look(rows, box[at[rows]])
        at[rows] += 1
        rows = rows[at[rows] < end[rows]]
    return found


def _numbers(table: pa.Table, name: str, kind: str = "float64") -> np.ndarray:
    return table.column(name).to_numpy().astype(kind)


def _runs(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where rows with equal values of the named columns begin, and the end."""
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The search inside a slab. ``crosses`` tells whether another slab may hold something nearer."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    starts = _runs(table, _GROUP)
    for a, b in zip(starts, starts[1:]):
        part = table.slice(a, b - a)
        x, y, k = _numbers(part, "x"), _numbers(part, "y"), _numbers(part, "k", "int64")
        best = nearest(x, y, x, y, k, np.full(b - a, _INF), np.arange(b - a))
        reach = best[np.arange(b - a), k - 1]
        crosses = (x - x[0] < reach) | (x[-1] - x < reach)
        done = part.append_column("near", _lists(best)).append_column("reach", pa.array(reach)).append_column("crosses", pa.array(crosses))
        yield from done.combine_chunks().to_batches()


def kth_distance(points: DataFrame, rows: int, slab: int = SLAB) -> DataFrame:
    """(feature, class, id, x, y, radius): the distance of each row to its ``k``-th neighbour in its feature and class, the greater
    of the differences in x and in y. ``points`` has feature, class, id, x, y and k, which is less than the rows of the class;
    ``rows`` is their number."""
    order = [*_GROUP, "x", "y", "id"]
    ddl = points.select(*order, "k").schema
    cut = points.select(*order, "k").repartitionByRange(max(1, -(-rows // slab)), *order).sortWithinPartitions(*order)
    shape = cut.withColumn("slab", F.spark_partition_id()).selectExpr(
        "*", "cast(null as array<double>) as near", "0d as reach", "true as crosses").schema
    home = materialize(cut.withColumn("slab", F.spark_partition_id()).mapInArrow(_at_home, shape), "near")
    cells = materialize(home.groupBy(*_GROUP, "slab").agg(F.min("x").alias("low"), F.max("x").alias("high")), "cells")

    guests = home.where("crosses").withColumnRenamed("slab", "own").drop("near")
    gap = F.greatest(F.col("low") - F.col("x"), F.col("x") - F.col("high"))
    visits = guests.join(cells, _GROUP).where((F.col("slab") != F.col("own")) & (gap < F.col("reach"))).select(
        *_GROUP, "slab", "id", "x", "y", "k", "reach")
    visits = visits.toDF(*visits.columns)  # its columns are not those of the hosts
    kind = ddl["id"].dataType.simpleString()

    def visit(hosts: pa.Table, came: pa.Table) -> pa.Table:
        if hosts.num_rows and came.num_rows:
            px, py = _numbers(hosts, "x"), _numbers(hosts, "y")
            best = nearest(px, py, _numbers(came, "x"), _numbers(came, "y"), _numbers(came, "k", "int64"), _numbers(came, "reach"))
            return came.select([*_GROUP, "id"]).append_column("near", _lists(best))
        return came.select([*_GROUP, "id"]).slice(0, 0).append_column("near", pa.array([], pa.list_(pa.float64())))

    keys = [*_GROUP, "slab"]
    hosts = home.select(*keys, "x", "y")
    found = hosts.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(
        visit, f"feature string, class string, id {kind}, near array<double>")
    more = found.groupBy(*_GROUP, "id").agg(F.flatten(F.collect_list("near")).alias("more"))
    crossing = home.where("crosses").join(more, [*_GROUP, "id"], "left")
    every = F.array_sort(F.concat("near", F.coalesce("more", F.array().cast("array<double>"))))
    place = [*_GROUP, "id", "x", "y"]
    return home.where("not crosses").select(*place, F.col("reach").alias("radius")).unionByName(
        crossing.select(*place, F.element_at(every, F.col("k")).alias("radius")))


# ---- rows inside an interval ----------------------------------------------------------------------------------

def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, or back."""
    i = v.view(np.int64)
    return i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def first_beyond(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least double c above x with c - x >= radius, as doubles subtract; radius is above 0."""
    low, high = _ordered(x + 0.0), _ordered(np.full(len(x), _INF))
    for _ in range(65):
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        far = _ordered(middle).view(np.float64) - x >= radius
        low, high = np.where(far, low, middle), np.where(far, middle, high)
    return _ordered(high).view(np.float64)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as its value (1), the end below which its last near value lies (0) and the one above which its first lies (2)."""
    for batch in batches:
        v, radius = _numbers(batch, "v") + 0.0, np.maximum(_numbers(batch, "radius"), 5e-324)
        for kind, at in ((0, first_beyond(v, radius)), (1, v), (2, -first_beyond(-v, radius))):
            yield pa.RecordBatch.from_arrays([batch.column("feature"), batch.column("dim"), pa.array(at + 0.0), pa.array(
                [kind] * len(v), pa.int32()), batch.column("id")], ["feature", "dim", "v", "kind", "id"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per end, the values of the task before it; and, with kind 1, the values of the task."""
    last, count = None, 0

    def total() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([1], pa.int32()), pa.array(
            [None], id_type), pa.array([last[2]], pa.int32()), pa.array([count], pa.int64())], names)

    names, id_type = ["feature", "dim", "kind", "id", "task", "n"], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        id_type = batch.column("id").type
        starts = _runs(table, ["feature", "dim"])
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            part = table.slice(a, b - a)
            this = tuple(part.column(c)[0].as_py() for c in ("feature", "dim", "task"))
            if last is not None and this != last:
                yield total()
                count = 0
            last = this
            values = _numbers(part, "kind", "int64") == 1
            before = count + np.cumsum(values)
            count = int(before[-1])
            ends = part.append_column("n", pa.array(before, pa.int64())).filter(pa.array(~values)).select(names).combine_chunks()
            for piece in ends.to_batches():
                yield pa.RecordBatch.from_arrays(piece.columns, names)
    if last is not None:
        yield total()


def counts_within(values: DataFrame, rows: int, slab: int = SLAB) -> DataFrame:
    """(feature, dim, id, n): how many ``v`` of the feature and dimension are nearer to the row's own than ``radius``, itself
    included (with radius 0: equal to it). ``values`` has feature, dim, id, v and radius; ``rows`` is their number."""
    kind = values.schema["id"].dataType.simpleString()
    events = values.mapInArrow(_ends, f"feature string, dim int, v double, kind int, id {kind}")
    order = ["feature", "dim", "v", "kind", "id"]
    in_order = events.repartitionByRange(max(1, -(-3 * rows // (4 * slab))), *order).sortWithinPartitions(*order)
    numbered = materialize(in_order.withColumn("task", F.spark_partition_id()).mapInArrow(
        _numbered, f"feature string, dim int, kind int, id {kind}, task int, n long"), "numbered")
    earlier = W.partitionBy("feature", "dim").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(numbered.where("kind = 1").select("feature", "dim", "task", F.coalesce(
        F.sum("n").over(earlier), F.lit(0)).alias("offset")), "offsets")
    ends = numbered.where("kind != 1").join(offsets, ["feature", "dim", "task"])
    sign = F.when(F.col("kind") == 0, 1).otherwise(-1)
    return ends.groupBy("feature", "dim", "id").agg(F.sum(sign * (F.col("n") + F.col("offset"))).alias("n"))


# ---- the estimate -----------------------------------------------------------------------------------------------

def _blurred(name: str, scale: float, key: str) -> Column:
    c = F.col(f"`{name}`").cast("double") / F.lit(scale)
    return c + F.lit(_BLUR) * F.greatest(F.lit(1.0), F.abs(c)) * (uniform(key, name) - 0.5)


def neighbour_information(df: DataFrame, key: str, features: Sequence[str], target: str, discrete: Collection[str] = (),
                          k: int = NEIGHBOURS, slab: int = SLAB) -> DataFrame:
    """``(feature, mutual_information)`` in nats between each feature and the target, from k nearest neighbours.

    Columns in ``discrete`` hold classes, the others numbers, which are brought to a deviation of 1 and blurred by a draw from
    the key so that no two are equal. Rows with a null, NaN or infinite value are left out of that feature, and so are classes of one
    row. ``key`` must be unique. A feature without two usable rows has 0; two columns of classes are compared by their counts. The
    result does not depend on the layout or on ``slab``."""
    spark = df.sparkSession
    pairs = {f: (f in discrete, target in discrete) for f in features}
    plain = [f for f, both in pairs.items() if all(both)]
    counted = mutual_information(df.dropna(subset=[f"`{target}`"]), {f: F.col(f"`{f}`") for f in plain}, F.col(f"`{target}`")) if plain else None
    rest = [f for f in features if f not in plain]
    if not rest:
        return counted if counted is not None else local_table(spark, [], "feature string, mutual_information double")

    numbers = [c for c in dict.fromkeys([*rest, target]) if c not in discrete]
    finite = {c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < _INF, F.col(f"`{c}`").cast("double")) for c in numbers}
    spread = df.agg(*[F.stddev_pop(finite[c]).alias(str(i)) for i, c in enumerate(numbers)]).first()
    # as a float, so that the order in which tasks add up does not show
    scale = {c: float(np.float32(spread[i])) if spread[i] else 1.0 for i, c in enumerate(numbers)}
    blurred = {c: F.when(finite[c].isNotNull(), _blurred(c, scale[c] if 0 < scale[c] < _INF else 1.0, key)) for c in numbers}
    rows = []
    for f in rest:
        classes = f if f in discrete else target if target in discrete else None
        x, y = (blurred[f], blurred[target]) if classes is None else (blurred[target if classes == f else f], F.lit(0.0))
        label = F.lit("") if classes is None else F.col(f"`{classes}`").cast("string")
        rows.append(F.struct(F.lit(f).alias("feature"), label.alias("class"), x.alias("x"), y.alias("y")))
    points = materialize(df.select(F.col(f"`{key}`").alias("id"), F.inline(F.array(*rows))).dropna(subset=["class", "x", "y"]), "points")
    sizes = materialize(points.groupBy(*_GROUP).agg(F.count("*").alias("size")), "sizes")
    usable = points.join(sizes.where("size > 1"), _GROUP).withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int"))
    total = sizes.where("size > 1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    two = [f for f, both in pairs.items() if not any(both)]
    radii = materialize(kth_distance(usable, total, slab), "radii")
    dims = F.array(F.struct(F.lit(0).alias("dim"), F.col("x").alias("v")), F.struct(F.lit(1).alias("dim"), F.col("y").alias("v")))
    values = radii.select("feature", "id", "radius", F.inline(dims)).where((F.col("dim") == 0) | F.col("feature").isin(two))
    near = counts_within(values, 2 * total, slab).groupBy("feature", "dim").agg(F.avg(digamma(F.col("n"))).alias("mean"))
    near = near.groupBy("feature").agg(F.sum("mean").alias("near"))
    # all rows of a class have the same k and the same size
    big = sizes.where("size > 1").withColumn("k", F.least(F.lit(k), F.col("size") - 1))
    own = F.when(F.col("feature").isin(two), 0.0).otherwise(digamma(F.col("size")))
    sides = big.groupBy("feature").agg(F.sum("size").alias("n"), (
        F.sum(F.col("size") * (digamma(F.col("k")) - own)) / F.sum("size")).alias("side"))
    scores = sides.join(near, "feature").select("feature", F.greatest(
        digamma(F.col("n")) + F.col("side") - F.col("near"), F.lit(0.0)).alias("mutual_information"))
    listed = local_table(spark, [(f,) for f in rest], "feature string")
    done = listed.join(scores, "feature", "left").fillna(0.0)
    return done if counted is None else done.unionByName(counted)


ship_by_value(__name__)
