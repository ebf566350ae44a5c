"""Byte-pair encoding and decoding, with tree concatenation for long unsplit text.

The splitting pattern cuts almost every text into short words. Where it doesn't (a long run without a cut), the run is halved
until the parts are short, the parts are encoded apart, and neighbours are joined pairwise, level by level: a window around
the join is encoded anew and grows until its first token is the left side's and its last token the right side's. Then every
two adjacent tokens of the result are adjacent in a correct encoding, which makes the whole correct, since a sequence of
tokens is the encoding of its text exactly if that holds for each adjacent pair.

Texts with a very long run are taken apart into rows, so that their parts are encoded by many tasks; a grouping by document
joins them. All other texts are encoded where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ship_by_value, text_of, texts_in
from glosswork.llm.vocab import ByteCoder

#: Characters from which on a chunk is encoded by halves, and the most bytes of a part.
LONG, PART = 2048, 1024
#: Characters without a blank from which on a text's parts are encoded in several tasks.
SPREAD = 1 << 17


def halves(text: str, most: int) -> list[str]:
    """The text halved until no part is longer than ``most``."""
    parts = [text]
    while len(parts[0]) > most or len(parts[-1]) > most:
        parts = [x for p in parts for x in ((p[:len(p) // 2], p[len(p) // 2:]) if len(p) > 1 else (p,))]
    return parts


def join(left: list[int], right: list[int], encode: Callable[[str], list[int]], text: Callable[[list[int]], str]) -> list[int]:
    """The encoding of two encoded neighbours together."""
    if not left or not right:
        return left + right
    a = b = 1
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = encode(text(left[-a:] + right[:b]))
        left_agrees = a == len(left) or window[0] == left[-a]
        right_agrees = b == len(right) or window[-1] == right[b - 1]
        if left_agrees and right_agrees:
            return left[:-a] + window + right[b:]
        a, b = a * (1 if left_agrees else 2), b * (1 if right_agrees else 2)


def concatenated(parts: list[list[int]], encode, text) -> list[int]:
    """Pairwise joins, level by level."""
    while len(parts) > 1:
        joined = [join(parts[i], parts[i + 1], encode, text) for i in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(parts) - len(parts) % 2:]
    return parts[0] if parts else []


class Merges:
    """The vocabulary's merges on text written in its byte alphabet."""

    def __init__(self, coder: ByteCoder):
        self._model = coder.library.model
        self._chars = {byte: char for char, byte in coder.alphabet.items()}
        self._token = {i: "".join(self._chars[b] for b in word) for i, word in coder.table.items()}

    def written(self, text: str) -> str:
        return "".join(map(self._chars.__getitem__, text.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> list[int]:
        return [token.id for token in self._model.tokenize(text)]

    def text(self, ids: list[int]) -> str:
        return "".join(map(self._token.__getitem__, ids))


def _words(coder: ByteCoder, chunk: str) -> Iterator[str]:
    """The parts that the vocabulary's splitting pattern makes of a chunk."""
    for _, (start, end) in coder.library.pre_tokenizer.pre_tokenize_str(chunk):
        yield chunk[start:end]


def encode_long(coder: ByteCoder, chunk: str) -> bytes:
    """A long chunk's ids: its words in a row, the long ones by tree concatenation."""
    merges, out = Merges(coder), []
    for word in _words(coder, chunk):
        parts = [merges.encode(p) for p in halves(merges.written(word), PART)]
        out.append(np.array(concatenated(parts, merges.encode, merges.text), "<u4").tobytes())
    return b"".join(out)


def _coder(path: str) -> ByteCoder:
    return ByteCoder(path, LONG, encode_long)


def _digest(coder: ByteCoder, ids: bytes) -> tuple[int, str, str]:
    decoded = coder.decode(ids).encode("utf-8", "surrogatepass")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


_RESULTS = {
    "ids": ("n_tokens long, ids binary", lambda coder, ids: (len(ids) // 4, ids)),
    "digest": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest),
}


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def encode(docs: DataFrame, vocab_path: str, result: str = "ids", id_col: str = "doc_id", text_col: str = "text",
           spread: int = SPREAD) -> DataFrame:
    """(id, n_tokens, ids) of each document, ids as little-endian unsigned 32-bit integers; with ``result="digest"`` in their
    place the hashes of the ids and of the text that they decode to.

    The ids are those of the tokenizers library without added special tokens; the strings of special tokens within a text
    are these tokens. A null text is empty and has no ids. Repeated rows and null ids are rows like any others; an empty table
    gives none; other columns are ignored."""
    ddl, made = _RESULTS[result]
    wanted = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    kinds = [pa.int64(), *([pa.binary()] if result == "ids" else [pa.string()] * 2)]
    names = ["id", *(c.split()[0] for c in ddl.split(", "))]
    unsplit = F.exists(F.split("text", " "), lambda run: F.char_length(run) >= spread)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocab_path)
        for batch, texts in texts_in(batches, "text"):
            rows = [made(coder, coder.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, kinds)], names)

    short = wanted.where((F.char_length("text") < spread) | ~unsplit).mapInArrow(here, f"id {kind}, {ddl}")
    long = wanted.where((F.char_length("text") >= spread) & unsplit)
    keyed = long.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")
    key = f"id {kind}, h1 long, h2 long"
    parts = keyed.mapInArrow(_apart(vocab_path), f"{key}, place long, inner boolean, part string, ids binary")
    # the parts of a text go to many tasks
    dealt = parts.repartition("id", "h1", "h2", "place").mapInArrow(_each(vocab_path), f"{key}, place long, inner boolean, ids binary")

    def gather(group_key: tuple, group: pa.Table) -> pa.Table:
        coder = _coder(vocab_path)
        merges, rows = Merges(coder), sorted(
            zip(*(group.column(c).to_pylist() for c in ("place", "inner", "ids"))), key=lambda r: r[0])
        copies = sum(r[0] == 0 for r in rows)  # equal rows of the table
        runs: list[list[list[int]]] = []
        for _, inner, ids in rows[::copies]:
            if not inner:
                runs.append([])
            runs[-1].append(np.frombuffer(ids, "<u4").tolist())
        ids = b"".join(np.array(concatenated(run, merges.encode, merges.text), "<u4").tobytes() for run in runs)
        out = [(group_key[0].as_py(), *made(coder, ids))] * copies
        return pa.table(dict(zip(names, _columns(out, [group.schema.field("id").type, *kinds]))))

    return short.unionByName(dealt.groupBy("id", "h1", "h2").applyInArrow(gather, f"id {kind}, {ddl}"))


def _apart(path: str):
    """Takes texts apart: stretches that are encoded at once, and the parts of long words. ``inner`` marks a part that
    continues the word of the part before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, "text"):
            for row, text in enumerate(texts):
                rows: list[tuple] = []

                def collect(coder: ByteCoder, chunk: str, rows: list = rows) -> bytes:
                    merges = Merges(coder)
                    for word in _words(coder, chunk):
                        for n, part in enumerate(halves(merges.written(word), 64 * PART)):
                            rows.append((n > 0, part, None))
                    return b""

                coder = ByteCoder(path, LONG, collect)
                for i, segment in enumerate(coder.segments(text)):
                    if i % 2:
                        rows.append((False, None, coder.encode(segment)))
                        continue
                    for first, words in coder.chunks(segment):
                        for n, word in enumerate([first, *words]):
                            ids = coder._ids(word if n == 0 else " " + word) if word or n else b""
                            if ids:
                                rows.append((False, None, ids))
                keys = [pa.array([batch.column(c)[row].as_py()] * len(rows), batch.column(c).type) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(len(rows)), pa.int64()), *_columns(
                    rows, [pa.bool_(), pa.string(), pa.binary()])], ["id", "h1", "h2", "place", "inner", "part", "ids"])

    return run


def _each(path: str):
    """Encodes the parts that are not encoded yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = None
        for batch in batches:
            merges = merges or Merges(ByteCoder(path))
            done = [ids if part is None else np.array(concatenated([merges.encode(p) for p in halves(part, PART)], merges.encode,
                                                                  merges.text), "<u4").tobytes()
                    for part, ids in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(done, pa.binary())],
                                             ["id", "h1", "h2", "place", "inner", "ids"])

    return run


def decode(coded: DataFrame, vocab_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """Add the texts of ids; null ids have a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteCoder(vocab_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = pa.array([None if x is None else coder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    rest = coded.drop(name)
    return rest.mapInArrow(run, rest.withColumn(name, F.lit(None).cast("string")).schema)


ship_by_value(__name__)
