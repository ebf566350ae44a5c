"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word can be cut into pieces in many ways; its
probability in a language is the sum over all of them, found by the forward algorithm, and a text's is the product over its
words. The probabilities are learned by expectation-maximisation on all training texts: they are first reduced to a table of
(language, word, frequency), and each round is one pass over that table, in which every task finds the expected counts of pieces
in its words (forward and backward) and sends only these. What the driver holds is pieces x languages, however many texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import fresh, materialize, ship_by_value, texts_in

UNDETERMINED = "und"
#: A word: letters (and number signs that are letters to no one, which are then left out); a longer run is several words.
_WORD = re.compile(r"[^\W\d_]{1,64}")
#: Words that a task counts, and those whose scores it remembers, at a time.
COUNT, REMEMBER = 200_000, 500_000
#: Words that the forward algorithm takes at a time.
_WORDS = 10_000
_NEVER = -1e30


@dataclass(frozen=True)
class Learning:
    """rounds of expectation-maximisation from equal probabilities; prior: what is added to each expected count."""

    rounds: int = 2
    prior: float = 0.05


@dataclass(frozen=True)
class Model:
    """Languages in order, and the logarithm of each piece's probability in each (pieces x languages)."""

    path: str
    languages: list[str]
    log_p: np.ndarray


def words_in(text: str) -> list[str]:
    """The lower-case words of a text."""
    return _WORD.findall(text.lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


class Pieces:
    """The pieces of the vocabulary at a path, and the ways in which words can be cut into them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = vocabulary.get_piece_size()
        self.bytes, self.lengths = np.zeros(256, np.int64), np.zeros(self.size, np.int64)
        self._single, self._find = set(), ahocorasick.Automaton()
        for i in range(self.size):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i)) and (
                    piece == "▁" or _WORD.fullmatch(piece.removeprefix("▁"))):
                self._find.add_word(piece, i)
                self.lengths[i] = len(piece)
                if len(piece) == 1:
                    self._single.add(piece)
        self._find.make_automaton()

    def arcs(self, words: list[str]) -> Arcs:
        """All pieces at all places of some words, each with its mark of a beginning before it. A character that is no piece is
        made of its bytes."""
        text = "▁" + "▁".join(words)
        ends, pieces = np.fromiter(chain.from_iterable(self._find.iter(text)), np.int64).reshape(-1, 2).T
        lengths = self.lengths[pieces]
        extra = sorted(set(text) - self._single)
        if extra:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            codes = np.array(list(map(ord, extra)))
            at = np.flatnonzero(np.isin(points, codes))
            ends, lengths = np.append(ends, at), np.append(lengths, np.ones(len(at), np.int64))
            pieces = np.append(pieces, self.size + np.searchsorted(codes, points[at]))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes) - 1
        word = np.searchsorted(last, ends)
        place = ends - (last - sizes)[word]  # 1 for the mark
        order = np.lexsort((word, place))
        return Arcs(extra, word[order], place[order], lengths[order], pieces[order], sizes)

    def log_p(self, log_p: np.ndarray, extra: list[str]) -> np.ndarray:
        """The probabilities of pieces, and after them those of characters made of bytes."""
        made = [log_p[self.bytes[list(c.encode("utf-8", "surrogatepass"))]].sum(axis=0)[None] for c in extra]
        return np.concatenate([log_p, *made])


@dataclass(frozen=True)
class Arcs:
    """Pieces in words: word, the place where one ends, its length and number, in order of places and then words."""

    extra: list[str]
    word: np.ndarray
    place: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    sizes: np.ndarray

    @property
    def state(self) -> np.ndarray:
        """Where the places of each word begin in a row of all words' places from 0 on."""
        return np.append(0, np.cumsum(self.sizes + 1))

    def steps(self) -> list[tuple[slice, np.ndarray]]:
        """The arcs that end at each place, and the first one of each word among them."""
        bounds = np.append(np.flatnonzero(np.diff(self.place, prepend=0)), len(self.place))
        return [(slice(a, b), np.flatnonzero(np.diff(self.word[a:b], prepend=-1))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def forward(arcs: Arcs, top: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of the beginnings of each word, over all their segmentations, for several languages: the logarithm of the
    greatest, and each one's share of it. An arc's probabilities are given alike."""
    state = arcs.state
    scale, value = np.zeros(state[-1]), np.ones((state[-1], share.shape[1]))
    end = state[arcs.word] + arcs.place
    start = end - arcs.length
    for step, first in arcs.steps():
        reach = scale[start[step]] + top[step]
        most = np.maximum.reduceat(reach, first)
        weight = np.exp(reach - np.repeat(most, np.diff(first, append=len(reach))))
        summed = np.add.reduceat(value[start[step]] * share[step] * weight[:, None], first, axis=0)
        best = summed.max(axis=1)
        here = end[step][first]
        scale[here], value[here] = most + np.log(best), summed / best[:, None]
    return scale, value


def word_scores(arcs: Arcs, log_p: np.ndarray) -> np.ndarray:
    """The log probability of each word in each language (pieces x languages)."""
    top = log_p.max(axis=1)
    scale, value = forward(arcs, top[arcs.piece], np.exp(log_p - top[:, None])[arcs.piece])
    last = arcs.state[1:] - 1
    return scale[last, None] + np.log(np.maximum(value[last], 1e-300))


def expected(arcs: Arcs, log_p: np.ndarray, languages: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in each language, in words of one language and weight each."""
    own = log_p[arcs.piece, languages[arcs.word]]
    before, _ = forward(arcs, own, np.ones((len(own), 1)))
    state = arcs.state
    after, last = np.full(state[-1], _NEVER), state[1:] - 1
    after[last] = 0
    end = state[arcs.word] + arcs.place
    start = end - arcs.length
    for step, _ in reversed(arcs.steps()):  # no two arcs of a step have the same start
        after[start[step]] = np.logaddexp(after[start[step]], own[step] + after[end[step]])
    found = np.exp(before[start] + own + after[end] - before[last][arcs.word]) * weights[arcs.word]
    return np.bincount(arcs.piece * log_p.shape[1] + languages[arcs.word], found, log_p.size).reshape(log_p.shape)


def word_counts(training: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n) of all texts with a language, added up in the tasks before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, c in held.items() for word, n in c.items() if has_letter(word)]
            held.clear()
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                                              ["lang", "word", "n"])

        for batch, texts in texts_in(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                held.setdefault(lang, Counter()).update(words_in(text))
                if sum(map(len, held.values())) > COUNT:
                    yield out()
        yield out()

    rows = training.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang is not null and text is not null")
    counted = rows.mapInArrow(count, "lang string, word string, n long")
    return materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language_words")


def learn(training: DataFrame, path: str, lang_col: str = "lang", text_col: str = "text", plan: Learning = Learning()) -> Model:
    """The model of all rows with a language and a text with letters. Languages are the values found, in order; rows without one,
    repeated rows, null and empty texts need no care before. A table without such rows gives a model without languages."""
    words = word_counts(training, lang_col, text_col)
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]  # values of one label column
    pieces = Pieces(path)
    log_p = np.full((pieces.size, len(languages)), -np.log(pieces.size))

    def round_(log_p: np.ndarray) -> np.ndarray:
        number = {x: i for i, x in enumerate(languages)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter, total = Pieces(path), np.zeros(log_p.shape)
            for batch in batches:
                for at in range(0, len(batch), _WORDS):
                    part = batch.slice(at, _WORDS)
                    langs = np.array([number[x] for x in part.column(0).to_pylist()])
                    arcs = cutter.arcs(part.column(1).to_pylist())
                    found = expected(arcs, cutter.log_p(log_p, arcs.extra), langs, part.column(2).to_numpy().astype(np.float64))
                    total += found[:cutter.size]
                    for c, n in zip(arcs.extra, found[cutter.size:]):
                        np.add.at(total, cutter.bytes[list(c.encode("utf-8", "surrogatepass"))], n)
            piece, lang = total.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])],
                                             ["piece", "lang", "n"])

        counts = np.zeros(log_p.shape)
        summed = words.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        for r in summed.toLocalIterator():  # at most pieces x languages
            counts[r["piece"], r["lang"]] = round(r["n"], 6)  # the order of sums doesn't matter
        counts += plan.prior
        return np.log(counts / counts.sum(axis=0))

    for _ in range(plan.rounds if languages else 0):
        log_p = round_(log_p)
    return Model(path, languages, log_p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with the most probable language of each text and its probability among the languages, all equally likely before.

    Ties go to the first language in order. A text that is null or has no letter, and any text if no language was learned, is
    ``und`` with score 0. Columns named like the two new ones are replaced, others stay; an empty table gives none."""
    path, languages, log_p = model.path, model.languages, model.log_p
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    text = fresh(docs, "_text")
    wanted = docs.select(*kept, F.col(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known, table, ends = Pieces(path), {}, np.zeros((1024, len(languages))), 0

        def remember(new: list[str]) -> None:
            nonlocal table, ends
            if ends + len(new) > len(table):
                table = np.concatenate([table, np.zeros((max(len(new), len(table)), len(languages)))])
            known.update(zip(new, range(ends, ends + len(new))))
            real = [i for i, word in enumerate(new) if has_letter(word)]
            for at in range(0, len(real), _WORDS):
                arcs = cutter.arcs([new[i] for i in real[at:at + _WORDS]])
                table[ends + np.array(real[at:at + _WORDS])] = word_scores(arcs, cutter.log_p(log_p, arcs.extra))
            ends += len(new)

        for batch, texts in texts_in(batches, text):
            found, scores = [], []
            for at in range(0, len(texts), 512):
                lists = [words_in(t) for t in texts[at:at + 512]]
                if languages:
                    if ends > REMEMBER:
                        known, ends = {}, 0
                        table[:] = 0
                    remember(list({w for x in lists for w in x}.difference(known)))
                for words in lists:
                    real = any(map(has_letter, words))
                    if not (real and languages):
                        found.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = table[[known[w] for w in words]].sum(axis=0)
                    best = int(total.argmax())
                    found.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(found, pa.string()), pa.array(
                scores, pa.float64())], [*kept, lang, score])

    return wanted.mapInArrow(run, docs.select(kept).withColumns({lang: F.lit(""), score: F.lit(0.0)}).schema)


ship_by_value(__name__)
