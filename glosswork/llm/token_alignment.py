"""Alignment of two tokenizers' tokens on the same text.

Both vocabularies keep every byte, so a text's tokens are two rows of ascending byte ends, and aligning them is merging the two
rows. The merge is cut along its diagonals: a binary search finds where each diagonal crosses the path of the merge, so that
pieces of equal work come out whatever the tokens look like, and each piece is merged by itself. A piece gives the overlaps
between the ends that it holds, and the places where both sides end; stitched together in order, these places cut the tokens
into groups, also where a group spans several pieces.

How often an id pair is linked is counted over all documents. Documents are taken in blocks of bounded size, which hold each
pair once; counts are added and joined back per block and pair, so a pair of every document comes once per block. A block's
links are a table of documents by pairs, of which the cells that are not zero are kept; one block meets its counts at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import materialize, ship_by_value, text_of, texts_in
from glosswork.llm.vocab import ByteCoder

#: Characters of text that are aligned at a time, and those after which a block ends: its row stays well below a megabyte.
SLICE, BLOCK = 1 << 18, 1 << 20
#: Texts that are Python strings at a time.
_TEXTS = 64
#: Ends that one piece of a merge takes.
WORK = 1 << 16
#: Chunks whose tokens are remembered in a task; then the memory is emptied.
REMEMBER = 150_000
#: A blank after no blank and before a plain character: here the tokens of both sides end.
_CUT = re.compile(r"(?<=[^ ])(?= [!-~À-ɏ])")
_ODD_BLANK = re.compile(r" (?![!-~À-ɏ])")
_PLAIN_WORD = re.compile(r"[!-~À-ɏ][\n!-~À-ɏ]*")


# ---- the merge

def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals, ``work`` steps apart, cross the merge path: how many ends of each side come before each piece.

    Of equal ends that of the first side comes first. The last element is the end of both rows."""
    steps = len(a) + len(b)
    diagonal = np.append(np.arange(0, steps, work), steps)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = np.zeros(len(diagonal), bool)
        taken[open_] = a[middle[open_]] <= b[diagonal[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low, diagonal - low


def overlaps(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge: the numbers of the tokens that overlap up to each of its ends, and whether both end there.

    Between two neighbouring ends lies one token of each side, and no other stretch has the same two."""
    ends = np.concatenate([a[i[0]:i[1]], b[j[0]:j[1]]])
    ends.sort(kind="stable")  # two ascending rows: a merge
    before = max(a[i[0] - 1] if i[0] else -1, b[j[0] - 1] if j[0] else -1)
    ends = ends[np.diff(ends, prepend=before) > 0]  # an end that the piece before has from the other side is its own
    left, right = i[0] + np.searchsorted(a[i[0]:i[1]], ends), j[0] + np.searchsorted(b[j[0]:j[1]], ends)
    return left, right, (a[left] == ends) & (b[right] == ends)


def aligned(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two rows of ends with the same last end, and which of them close a group: the pieces, stitched."""
    at_a, at_b = crossings(a, b, work)
    pieces = [overlaps(a, b, i, j) for i, j in zip(zip(at_a[:-1].tolist(), at_a[1:].tolist()), zip(at_b[:-1].tolist(), at_b[1:].tolist()))]
    return tuple(np.concatenate(part) for part in zip(*pieces)) if pieces else (
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


# ---- the tokens

class PlainByteCoder(ByteCoder):
    """The strings of special tokens are text like any other."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self._special = None


class Coders:
    """Both sides' ids of chunks of text, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self._bytes = PlainByteCoder(byte_path)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self._pieces.id_to_piece(i) for i in range(self._pieces.get_piece_size())]
        self.piece_bytes = [bytes([int(name[3:5], 16)]) if self._pieces.is_byte(i) else name.replace("▁", " ").encode()
                            for i, name in enumerate(names)]
        self.a_sizes = np.zeros(max(self._bytes.table) + 1, np.int64)
        for i, token in self._bytes.table.items():
            self.a_sizes[i] = len(token)
        self.b_sizes = np.array([len(p) for p in self.piece_bytes], np.int64)
        self._known: dict[str, tuple[bytes, bytes] | None] = {}

    def _joined(self, words: list[str]) -> None:
        """Learn words without blanks: both sides end a token between any two of them, so they are encoded in a row."""
        text = " " + " ".join(words)
        want = text.encode()
        a = np.array(self._bytes._fast.encode_ordinary(text), "<u4")
        b = np.array(self._pieces.encode(text[1:]), "<u4")
        if b"".join(map(self.piece_bytes.__getitem__, b.tolist())) != want:
            return self._singly(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) if len(want) == len(text) else np.cumsum(
            [len(w.encode()) + 1 for w in words])
        cuts = [np.searchsorted(np.cumsum(sizes[ids]), ends) + 1 for sizes, ids in ((self.a_sizes, a), (self.b_sizes, b))]
        a, b = a.tobytes(), b.tobytes()
        i = j = 0
        for word, i_end, j_end in zip(words, (4 * cuts[0]).tolist(), (4 * cuts[1]).tolist()):
            self._known[word] = (a[i:i_end], b[j:j_end])
            i, j = i_end, j_end

    def _singly(self, words: list[str]) -> None:
        for word, b in zip(words, self._pieces.encode(words, num_threads=1)):
            a, want = self._bytes._ids(" " + word), (" " + word).encode()
            same = b"".join(map(self._bytes.table.__getitem__, np.frombuffer(a, "<u4").tolist())) == want and b"".join(
                map(self.piece_bytes.__getitem__, b)) == want
            self._known[word] = (a, np.array(b, "<u4").tobytes()) if same else None

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        if len(self._known) > REMEMBER:
            self._known = {}
        plain, other = [], []
        for word in set(words).difference(self._known):
            (plain if _PLAIN_WORD.fullmatch(word) else other).append(word)
        if plain:
            self._joined(plain)
        if other:
            self._singly(other)
        return self._known

    def encode(self, text: str) -> Iterator[tuple[bytes, bytes] | None]:
        """Both sides' ids of a blank and a text, in parts of about ``SLICE`` characters between which both sides end a token.
        None for a part that a side doesn't keep as it is."""
        text = " " + text
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            part = text[at:cut.start()] if cut else text[at:]
            at += len(part)
            words = [w[1:] for w in _CUT.split(part)] if _ODD_BLANK.search(part) else part[1:].split(" ")
            found = list(map(self._learn(words).__getitem__, words))
            yield None if None in found else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))


# ---- documents

def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below ``size``, with room for a separator, and how many digits each has."""
    names = [str(i).encode() for i in range(size)]
    width = max(map(len, names), default=1)
    return np.array([list(n.ljust(width + 1, b"\0")) for n in names], np.uint8).reshape(size, width + 1), np.array(list(map(len, names)))


class Writer:
    """Groups as text: ids of a side joined by commas, the sides by a bar, groups by semicolons."""

    def __init__(self, size: int):
        self._digits, self._lengths = _digits(size)
        width = self._digits.shape[1]
        self._filled = np.arange(width)[None, :] <= np.arange(width)[:, None]

    def write(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text, with a semicolon after each group, and where each group ends in it; groups end after so many ids of each side."""
        total = a_cut + b_cut
        a_last, b_last = a_cut + np.append(0, b_cut[:-1]) - 1, total - 1  # places of the last id of each side of a group
        first = np.zeros(len(a) + len(b), bool)
        starts, a_sizes = np.append(0, total[:-1]), np.diff(a_cut, prepend=0)
        first[:] = np.repeat(np.stack([np.ones(len(a_cut), bool), np.zeros(len(a_cut), bool)], 1).ravel(), np.stack(
            [a_sizes, total - starts - a_sizes], 1).ravel())
        ids = np.empty(len(first), np.int64)
        ids[first], ids[~first] = a, b
        separator = np.full(len(ids), ord(","), np.uint8)
        separator[a_last], separator[b_last] = ord("|"), ord(";")
        rows, lengths = self._digits[ids], self._lengths[ids]
        rows[np.arange(len(rows)), lengths] = separator
        return rows[self._filled[lengths]], np.cumsum(lengths + 1)[b_last]


@dataclass
class _Document:
    key: object
    a: int = 0
    b: int = 0
    groups: int = 0
    whole: bool = True
    digest: object = field(default_factory=hashlib.sha256)
    links: list = field(default_factory=list)


class _Block:
    """Documents with the numbers of their tokens, groups and links; links as places in the block's list of pairs."""

    def __init__(self, coders: Coders, writer: Writer):
        self._coders, self._writer = coders, writer
        self.documents: list[_Document] = []
        self._waiting: list[tuple[_Document, bytes, bytes]] = []
        self._held = self.size = 0

    def add(self, key, text: str) -> None:
        document = _Document(key)
        self.documents.append(document)
        self.size += len(text) + 64
        if not text:
            return
        first = len(self._waiting)
        for part in self._coders.encode(text):
            if part is None:  # the document has no tokens: nothing of it may stay
                document.whole = False
                del self._waiting[first:]
                return
            self._waiting.append((document, *part))
            self._held += len(part[0])
            if self._held >= 2 * SLICE:
                self._align()
                first = 0

    def _align(self) -> None:
        if not self._waiting:
            return
        coders, documents = self._coders, [w[0] for w in self._waiting]
        a, b = (np.frombuffer(b"".join([w[k] for w in self._waiting]), "<u4").astype(np.int64) for k in (1, 2))
        a_of, b_of = (np.cumsum([len(w[k]) // 4 for w in self._waiting]) for k in (1, 2))
        self._waiting, self._held = [], 0
        left, right, closes = aligned(np.cumsum(coders.a_sizes[a]), np.cumsum(coders.b_sizes[b]))
        pairs = a[left] << 32 | b[right]
        a_cut, b_cut = left[closes] + 1, right[closes] + 1
        text, ends = self._writer.write(a, b, a_cut, b_cut)
        # every part of a document ends with a group
        links_of = np.searchsorted(left, a_of)
        groups_of = np.searchsorted(a_cut, a_of) + 1
        start = [0, 0, 0, 0, 0]
        for k, document in enumerate(documents):
            end = [int(a_of[k]), int(b_of[k]), int(groups_of[k]), int(links_of[k]), int(ends[groups_of[k] - 1])]
            if document.groups:
                document.digest.update(b";")
            document.digest.update(text[start[4]:end[4] - 1])
            document.a += end[0] - start[0]
            document.b += end[1] - start[1]
            document.groups += end[2] - start[2]
            document.links.append(pairs[start[3]:end[3]])
            start = end

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        self._align()
        none = np.zeros(0, np.int64)
        links = [np.concatenate(d.links) if d.whole and d.links else none for d in self.documents]
        sizes, links = [len(x) for x in links], np.concatenate([none, *links])
        pairs, places, counts = np.unique(links, return_inverse=True, return_counts=True)
        cells, times = np.unique(np.repeat(np.arange(len(sizes)) * len(pairs), sizes) + places, return_counts=True)
        whole = [d.whole for d in self.documents]
        numbers = [[getattr(d, name) if w else 0 for d, w in zip(self.documents, whole)] for name in ("a", "b", "groups")]
        rows = pa.StructArray.from_arrays([
            pa.array([d.key for d in self.documents], kind), *[pa.array(x, pa.int64()) for x in [*numbers, sizes]],
            pa.array([d.digest.hexdigest() if w and d.a else "" for d, w in zip(self.documents, whole)])],
            ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), one(pa.array(pairs, pa.int64())), one(pa.array(counts, pa.int64())), one(rows),
            pa.array([len(cells)], pa.int64()), *[pa.array([packed(x)], pa.binary()) for x in (np.diff(cells, prepend=0), times)]],
            ["block", "pairs", "counts", "documents", "n_cells", "gaps", "times"])


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the greatest needs: the lowest byte of each, then the next of each, which are mostly zero."""
    kind = np.min_scalar_type(values.max(initial=0)).newbyteorder("<")
    return values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    width = len(data) // count
    return np.frombuffer(data, np.uint8).reshape(width, count).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def _blocks(byte_path: str, piece_path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, writer, block, kind = Coders(byte_path, piece_path), None, None, None
        writer, number = Writer(max(len(coders.a_sizes), len(coders.b_sizes))), TaskContext.get().partitionId() << 32
        parts = (batch.slice(at, _TEXTS) for batch in batches for at in range(0, batch.num_rows, _TEXTS))
        for batch, texts in texts_in(parts, "text"):
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts):
                block = block or _Block(coders, writer)
                block.add(key, text)
                if block.size >= size:
                    yield block.batch(number, kind)
                    block, number = None, number + 1
        if block is not None:
            yield block.batch(number, kind)

    return run


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _sums(block: pa.Table, numbers: pa.Table) -> pa.Table:
    """A row per document of a block: how many links are their B id's best, and the sum of the links' counts."""
    documents, n_cells, gaps, times = (block.column(name).combine_chunks() for name in ("documents", "n_cells", "gaps", "times"))
    documents, n_cells = documents.flatten(), n_cells[0].as_py()
    cells, times = np.cumsum(unpacked(gaps[0].as_py(), n_cells)), unpacked(times[0].as_py(), n_cells)
    width = max(1, numbers.num_rows)
    ends = np.searchsorted(cells, np.arange(len(documents) + 1) * width)
    place, sums = numbers.column("place").to_numpy(), []
    for name in ("best", "total"):
        of_place = np.zeros(width, np.int64)
        of_place[place] = numbers.column(name).to_numpy()
        sums.append(np.diff(np.append(0, np.cumsum(of_place[cells % width] * times))[ends]))
    return pa.table([*[documents.field(k) for k in range(5)], *[pa.array(x, pa.int64()) for x in sums], documents.field(5)],
                    ["id", *_COUNTS, "groups_sha256"])


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A is the byte-level vocabulary at ``byte_path`` on a blank and the text, B the piece vocabulary at ``piece_path``, which adds
    the blank itself; strings of special tokens are plain text. Groups end where tokens of both sides end. A link is a token of
    A and one of B whose bytes overlap; its count is the number of links of the same two ids in all documents, and it is a best
    one if no other A id has a greater count with its B id. The digest is of ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, or whose bytes a side doesn't keep (a text with U+2581), has no tokens: zeros and an empty
    digest. Repeated rows and null ids are rows like any others and count each; an empty table gives none; other columns are
    ignored."""
    wanted = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    blocks = materialize(wanted.mapInArrow(_blocks(byte_path, piece_path, block), (
        f"block long, pairs array<long>, counts array<long>, documents array<struct<id: {kind}, n_a: long, n_b: long, "
        "n_groups: long, n_links: long, groups_sha256: string>>, n_cells long, gaps binary, times binary")), "aligned")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select(
        "block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = materialize(listed.groupBy("pair").agg(F.sum("n").alias("total")).withColumn(
        "b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair_totals")
    judged = totals.join(totals.groupBy("b").agg(F.max("total").alias("most")), "b").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    numbers = listed.join(judged, "pair").select(F.col("block").alias("of"), "place", "total", "best").groupBy("of")
    held = blocks.select("block", "documents", "n_cells", "gaps", "times").groupBy("block")
    return held.cogroup(numbers).applyInArrow(_sums, f"id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string")


ship_by_value(__name__)
