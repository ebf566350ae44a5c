"""Ids of whole texts under public byte-pair vocabularies, equal to those of the tokenizers library.

A text is cut into chunks at places where the vocabulary's own splitting pattern always cuts, each distinct chunk is encoded
once, and a text's ids are its chunks' ids in a row. Plain chunks (Latin letters, with the marks that follow them) go through
the same merges as ranks in tiktoken, which is several times faster; all others go through the tokenizers library itself.
Everything here runs inside Spark tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from glosswork.llm.common import ship_by_value

#: Chunks whose ids are remembered in a task; then the memory is emptied.
REMEMBER = 600_000
#: Characters of a text that are cut into chunks at a time.
SLICE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[str, int], list[str], str]:
    """Tokens and their ids, the special tokens, and the end-of-word mark of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    return held["model"]["vocab"], [t["content"] for t in held["added_tokens"]], held["model"]["end_of_word_suffix"] or ""


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return coder


def pieces_of(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``size`` characters, each but the first beginning with a blank before a plain character."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


#: A blank before a character that is surely no white space in any Unicode version: every splitting pattern cuts before it.
_CUT = re.compile(r" (?=[!-~À-ɏ])")
_ODD_BLANK = re.compile(r" (?![!-~À-ɏ])")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")


class WordCoder:
    """A lower-case vocabulary with word ends, which drops white space."""

    def __init__(self, path: str):
        import tiktoken

        self._library = library(path)
        vocab, special, end = read_vocabulary(path)
        alphabet = byte_alphabet()
        # the end-of-word mark as a zero byte, which the words that come here don't have
        ranks = {bytes(alphabet[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end): i
                 for token, i in vocab.items() if token not in special}
        self._fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        if len(self._known) > REMEMBER:
            self._known, self._words = {}, {}
        words, cores = self._words, {}
        for chunk in chunks:
            core = chunk.rstrip(",.")
            if _LATIN_WORD.fullmatch(core):
                cores[chunk] = core.lower()
        new = list({core for core in cores.values() if core not in words})
        ids = np.array(self._fast.encode_ordinary("\0".join(new) + "\0") if new else [], "<u4")
        at = 0
        for core, end in zip(new, (np.flatnonzero(self._ends[ids]) + 1).tolist(), strict=True):
            words[core] = ids[at:end].tobytes()
            at = end
        rest = [chunk for chunk in chunks if chunk not in cores]
        rest += {chunk[len(core):] for chunk, core in cores.items()} - {""}
        by_library = {}
        for i in range(0, len(rest), 10_000):
            part = rest[i:i + 10_000]
            for chunk, found in zip(part, self._library.encode_batch_fast(part, add_special_tokens=False)):
                by_library[chunk] = np.array(found.ids, "<u4").tobytes()
        by_library[""] = b""
        for chunk in chunks:
            core = cores.get(chunk)
            self._known[chunk] = by_library[chunk] if core is None else words[core] + by_library[chunk[len(core):]]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            parts = []
            for piece in pieces_of(text):
                # these four end words for Python's split only
                chunks = [piece] if re.search("[\x1c-\x1f]", piece) else piece.split()
                new = {c for c in chunks if c not in self._known}
                if new:
                    self._learn(new)
                    new = {c for c in chunks if c not in self._known}
                    if new:  # the memory was emptied meanwhile
                        self._learn(new)
                parts.append(b"".join(map(self._known.__getitem__, chunks)))
            yield b"".join(parts)


#: White space, Latin letters and what a keyboard has: every implementation of the splitting pattern agrees on these.
_PLAIN = re.compile(r"[\n -~À-ɏ]*")


class ByteCoder:
    """A byte-level vocabulary, which keeps every byte of a text.

    Before a blank with a plain character after it the splitting pattern always cuts, so a text is a row of chunks that begin
    with a blank. ``long_chunk`` is called for chunks of at least ``long`` characters, if given."""

    def __init__(self, path: str, long: int = 0, long_chunk=None):
        import public_tokenizers
        import tiktoken

        self.library = library(path)
        vocab, special, _ = read_vocabulary(path)
        self.alphabet = byte_alphabet()
        self.table = {i: token.encode() if token in special else bytes(self.alphabet[c] for c in token)
                      for token, i in vocab.items()}
        for token in special:  # these may have ids of their own
            self.table[self.library.token_to_id(token)] = token.encode()
        ranks = {word: i for i, word in self.table.items() if word.decode("utf-8", "replace") not in special}
        self._fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self._known: dict[str, bytes] = {}
        self._long, self._long_chunk = long, long_chunk

    def _ids(self, chunk: str) -> bytes:
        if self._long and len(chunk) >= self._long:
            return self._long_chunk(self, chunk)
        if _PLAIN.fullmatch(chunk):
            ids = self._fast.encode_ordinary(chunk)
        else:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        if len(self._known) > REMEMBER:
            self._known = {}
        known = self._known
        for word in set(words).difference(known):
            known[word] = self._ids(" " + word)
        return known

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which are the odd elements."""
        return self._special.split(text) if self._special else [text]

    def chunks(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """For each part of a text without special tokens: its first chunk, and the others without their leading blank."""
        for piece in pieces_of(text):
            if _ODD_BLANK.search(piece):
                first, *words = _CUT_BEFORE.split(piece)
                yield first, [w[1:] for w in words]
            else:
                first, *words = piece.split(" ")
                yield first, words

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, segment in enumerate(self.segments(text)):
            if i % 2:
                out.append(np.array([self.library.token_to_id(segment)], "<u4").tobytes())
                continue
            for first, words in self.chunks(segment):
                if first:
                    out.append(self._ids(first))
                out += map(self._learn(words).__getitem__, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CUT_BEFORE = re.compile(r"(?= [!-~À-ɏ])")

ship_by_value(__name__)
