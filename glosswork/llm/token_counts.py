"""Token counts of whole texts without their ids.

A text is a row of pre-tokens, which the merges never cross, so its count is a sum over its pre-tokens. Documents are taken in
blocks of a bounded size. A block holds its distinct pre-tokens once and, for each document, their places and frequencies.
The blocks' pre-tokens are dealt and sorted, one row per block and pre-token, so even a pre-token of every document comes once
per block; where the string changes it is encoded for its number of pieces, and from there on only numbers move. They come back
to their blocks, and a document's count is the sum of pieces times frequency.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.bpe_tree import LONG, PART, Merges, concatenated, halves
from glosswork.llm.common import materialize, ship_by_value, text_of, texts_in
from glosswork.llm.vocab import REMEMBER, ByteCoder

#: Characters of text after which a block ends.
BLOCK = 1 << 24
#: How the vocabulary writes a word without and with a blank before it.
_BLANK = ("", "\u0120")


class _Block:
    """Documents with the frequencies of their pre-tokens, as places in the block's list of distinct ones."""

    def __init__(self, coder: ByteCoder, known: dict[str, tuple[str, ...]]):
        self._coder, self._known = coder, known
        self._places: dict[str, int] = {}
        # a chunk's place, or places if it is more than one pre-token
        self._chunks: dict[str, int | tuple[int, ...]] = {}
        self.size, self.documents = 0, []

    def _split(self, chunk: str) -> int | tuple[int, ...]:
        places, word = self._places, chunk[chunk.startswith(" "):]
        if word.isascii() and word.isalpha():  # a pre-token as it is, in every version of Unicode
            word = _BLANK[len(chunk) - len(word)] + word
            found = places.setdefault(word, len(places))
        else:
            parts = self._known.get(chunk)
            if parts is None:
                if len(self._known) > REMEMBER:
                    self._known.clear()
                parts = self._known[chunk] = tuple(part for part, _ in self._coder.library.pre_tokenizer.pre_tokenize_str(chunk))
            found = tuple(places.setdefault(part, len(places)) for part in parts)
            if len(found) == 1:
                found = found[0]
        self._chunks[chunk] = found
        return found

    def add(self, key, text: str) -> None:
        chunks, special = Counter(), 0
        for i, segment in enumerate(self._coder.segments(text)):
            if i % 2:
                special += 1
                continue
            for first, rest in self._coder.chunks(segment):
                chunks[first] += 1
                chunks.update([" " + word for word in rest])
        held: dict[int, int] = {}
        several = []
        for chunk, place, n in zip(chunks, map(self._chunks.get, chunks), chunks.values()):
            if place is None:
                place = self._split(chunk)
            if type(place) is int:
                held[place] = n  # no other chunk is this pre-token alone
            else:
                several.append((place, n))
        for found, n in several:
            for place in found:
                held[place] = held.get(place, 0) + n
        order = sorted(held)
        self.documents.append((key, len(text.encode("utf-8", "surrogatepass")), special, order, list(map(held.__getitem__, order))))
        self.size += len(text)

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        keys, sizes, special, places, counts = zip(*self.documents)
        columns = [pa.array(keys, kind), pa.array(sizes, pa.int64()), pa.array(special, pa.int64()), pa.array(map(len, places), pa.int64())]
        rows = pa.StructArray.from_arrays(columns, ["id", "n_bytes", "special", "size"])
        steps = [np.diff(np.array(p, "<u4"), prepend=np.array([0], "<u4")) for p in places]  # small numbers, which pack well
        packed = np.concatenate([*steps, *[np.array(c, "<u4") for c in counts]]) if places else np.zeros(0, "<u4")
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([list(self._places)], pa.list_(pa.string())), pa.ListArray.from_arrays(
                pa.array([0, len(rows)], pa.int32()), rows), pa.array([pa.Codec("zstd").compress(packed.tobytes(), asbytes=True)], pa.binary())],
            ["block", "pre_tokens", "documents", "counts"])


def _blocks(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known, number, block = ByteCoder(path), {}, TaskContext.get().partitionId() << 32, None
        kind = None
        for batch, texts in texts_in(batches, "text"):
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts):
                block = block or _Block(coder, known)
                block.add(key, text)
                if block.size >= size:
                    yield block.batch(number, kind)
                    block, number = None, number + 1
        if block is not None:
            yield block.batch(number, kind)

    return run


def _pieces(path: str):
    """The number of pieces of each pre-token, which come sorted; long ones by tree concatenation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(ByteCoder(path))
        last, size = None, 0
        for batch in batches:
            runs = batch.column(2).dictionary_encode()
            sizes = []
            for word in runs.dictionary.to_pylist():
                if word != last:
                    last, size = word, len(merges.encode(word)) if len(word) < LONG else len(concatenated(
                        [merges.encode(p) for p in halves(word, PART)], merges.encode, merges.text))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(sizes, np.int64)[
                runs.indices.to_numpy()] if sizes else np.zeros(0, np.int64))], ["block", "place", "pieces"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document of each block: special tokens, and pieces times frequency."""
    for batch in batches:
        for row in range(batch.num_rows):
            documents = batch.column(0).slice(row, 1).flatten()
            pieces = batch.column(2).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
            sizes = documents.field(3).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(sizes))
            total = int(ends[-1])
            packed = np.frombuffer(pa.Codec("zstd").decompress(batch.column(1)[row].as_py(), 8 * total, asbytes=True), "<u4").astype(np.int64)
            steps = np.cumsum(packed[:total])
            places = steps - np.repeat(np.append(0, steps)[ends[:-1]], sizes)
            sums = np.append(0, np.cumsum(pieces[places] * packed[total:]))[ends]
            special = documents.field(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([documents.field(0), documents.field(1), pa.array(special + np.diff(sums), pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, n_tokens) of each document: UTF-8 bytes, and tokens under the byte-level vocabulary at ``vocab_path``.

    The tokens are those of the tokenizers library without added special tokens; the string of a special token within a text
    is one token. A null or empty text has none. Repeated rows and null ids are rows like any others; an empty table gives
    none; other columns are ignored."""
    wanted = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    blocks = materialize(wanted.mapInArrow(_blocks(vocab_path, block), (
        f"block long, pre_tokens array<string>, documents array<struct<id: {kind}, n_bytes: long, special: long, size: long>>, "
        "counts binary")), "blocks")
    listed = blocks.select("block", F.posexplode("pre_tokens").alias("place", "pre_token"))
    counted = listed.repartition("pre_token").sortWithinPartitions("pre_token").mapInArrow(
        _pieces(vocab_path), "block long, place int, pieces long")
    numbers = materialize(counted.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("place", "pieces")))["pieces"].alias("pieces")), "pieces")
    # a block of empty texts has no pre-token
    held = blocks.select("block", "documents", "counts").join(numbers, "block", "left").select(
        "documents", "counts", F.coalesce("pieces", F.array().cast("array<long>")).alias("pieces"))
    return held.mapInArrow(_totals, f"id {kind}, n_bytes long, n_tokens long")


ship_by_value(__name__)
