"""Packing of token sequences into windows of a fixed size.

Online and in bounded space: each task keeps a fixed number of open windows, puts a piece into the fullest that it fits, and
when it fits none closes the fullest of all and opens another. The windows that are still open at a task's end are pieces for
the next round, in groups of a bounded size, until one group is left, whose windows are the last. Texts are read once and
never shuffled; only piece records of the open windows move.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import materialize, ship_by_value, texts_in
from glosswork.llm.vocab import WordCoder

#: Open windows that one group of a merging round may get.
_GROUP = 4096
#: Windows in an Arrow batch of results.
_BATCH = 512


class Windows:
    """A fixed number of open windows with best-fit placing. A window is [tokens in it, its piece records]."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self._open: dict[int, list] = {}
        self._free: list[tuple[int, int]] = []  # (space, window), ascending
        self._next = 0

    def put(self, size: int, pieces: list[tuple]) -> Iterator[list]:
        """Place pieces of ``size`` tokens; gives the window that is closed by it, if any."""
        if size >= self.capacity:
            yield [size, pieces]
            return
        at = bisect_left(self._free, (size, -1))
        if at < len(self._free):
            space, key = self._free.pop(at)
        else:
            if len(self._free) == self.most:
                yield self._open.pop(self._free.pop(0)[1])
            space, key, self._next = self.capacity, self._next, self._next + 1
            self._open[key] = [0, []]
        window = self._open[key]
        window[1] += [(*p[:5], p[5] + window[0]) for p in pieces]
        window[0] += size
        if window[0] == self.capacity:
            yield self._open.pop(key)
        else:
            insort(self._free, (space - size, key))

    def rest(self) -> list[list]:
        return [self._open[key] for _, key in self._free]


def _schema(id_type: pa.DataType) -> pa.Schema:
    piece = pa.struct([("id", id_type), *((n, pa.int64()) for n in ("start", "length", "crc", "tokens", "offset"))])
    return pa.schema([("closed", pa.bool_()), ("size", pa.int64()), ("sequence", pa.int64()), ("pieces", pa.list_(piece))])


class _Out:
    """Numbers windows and makes Arrow batches of them."""

    def __init__(self, schema: pa.Schema, base: int):
        self.schema, self.base, self.count, self.rows = schema, base, 0, []

    def add(self, closed: bool, window: list) -> None:
        self.rows.append((closed, window[0], self.base + self.count, window[1]))
        self.count += 1

    def batch(self) -> pa.RecordBatch:
        closed, size, sequence, pieces = zip(*self.rows) if self.rows else ((), (), (), ())
        self.rows = []
        flat = [p for window in pieces for p in window]
        fields = self.schema.field("pieces").type.value_field.type
        columns = [pa.array([p[i] for p in flat], field.type) for i, field in enumerate(fields)]
        offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(fields)),
                                         type=self.schema.field("pieces").type)
        return pa.RecordBatch.from_arrays([pa.array(closed, pa.bool_()), pa.array(size, pa.int64()), pa.array(
            sequence, pa.int64()), lists], schema=self.schema)


def _merger(schema: pa.Schema, base: int, last: bool, capacity: int, most: int):
    """Packs the windows of a group anew, as if they were pieces, largest first."""
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        out, windows = _Out(schema, base + (key[0].as_py() << 32)), Windows(capacity, most)
        rows = sorted(group.select(["sequence", "size", "pieces"]).to_pylist(), key=lambda r: (-r["size"], r["sequence"]))
        for row in rows:
            for window in windows.put(row["size"], [tuple(p.values()) for p in row["pieces"]]):
                out.add(True, window)
        for window in windows.rest():
            out.add(last, window)
        return pa.Table.from_batches([out.batch()])

    return merge


def _rounds(first: DataFrame, schema: pa.Schema, ddl: str, capacity: int, most: int) -> DataFrame:
    """Merge the windows left open, round by round; all windows of all rounds, closed."""
    closed, number = [first.where("closed")], 0
    still = first.where("not closed")
    while True:
        number += 1
        groups = max(1, -(-still.count() // _GROUP))
        last = groups == 1
        merge = _merger(schema, number << 56, last, capacity, most)
        dealt = still.withColumn("group", F.pmod(F.xxhash64("sequence"), F.lit(groups)))
        merged = materialize(dealt.groupBy("group").applyInArrow(merge, ddl), "windows")
        closed.append(merged.where("closed"))
        if last:
            return reduce(DataFrame.unionAll, closed)
        still = merged.where("not closed")


def pack(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 1, open_windows: int = 64,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows: (id, start, length, crc, tokens, sequence, offset).

    A document is its ids under the word vocabulary of the tokenizers file at ``vocab_path``, then ``end_id``; it is cut at
    every ``capacity`` ids, so only its last piece is shorter. crc is that of the piece's ids as little-endian unsigned
    32-bit integers; offset is the piece's place in its window. A null or empty text is the end id alone. Repeated rows and
    null ids are packed like any others, so their pieces repeat. An empty table gives no pieces. Other columns are ignored.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    ddl = (f"closed boolean, size long, sequence long, pieces array<struct<id: {kind}, start: long, length: long, crc: long, "
           "tokens: long, offset: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, windows, out, end = WordCoder(vocab_path), Windows(capacity, open_windows), None, np.array([end_id], "<u4").tobytes()
        for batch, texts in texts_in(batches, "text"):
            if out is None:
                schema = _schema(batch.schema.field(0).type)
                out = _Out(schema, TaskContext.get().partitionId() << 32)
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])
                    for window in windows.put(length, [(key, start, length, crc, total, 0)]):
                        out.add(True, window)
            if len(out.rows) >= _BATCH:
                yield out.batch()
        if out is not None:
            for window in windows.rest():
                out.add(False, window)
            yield out.batch()

    first = materialize(wanted.mapInArrow(run, ddl), "windows")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _schema(to_arrow_type(wanted.schema["id"].dataType))
    windows = _rounds(first, schema, ddl, capacity, open_windows)
    return windows.select("sequence", F.explode("pieces").alias("p")).select("p.*", "sequence").select(
        "id", "start", "length", "crc", "tokens", "sequence", "offset")


ship_by_value(__name__)
