import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glosswork.llm import token_alignment as ta
from glosswork.llm.queries import op13_token_alignment
from glosswork.llm.vocab import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def tokens(sides, text):
    """Both sides' (id, start, end) of a text, or nothing if a side loses bytes."""
    alphabet = byte_alphabet()
    a, b = sides
    if not text:
        return [], []
    out = []
    first = a.encode(" " + text, add_special_tokens=False)
    for ids, pieces in ((first.ids, [bytes(alphabet[c] for c in t) for t in first.tokens]), (
            (ids := b.encode(text)), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                                      for i, p in zip(ids, map(b.id_to_piece, ids))])):
        if b"".join(pieces) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i, p in zip(ids, pieces):
            side.append((i, at, at + len(p)))
            at += len(p)
        out.append(side)
    return out


def brute(sides, rows):
    """The digest rows, by comparing all tokens of a document that may overlap."""
    found, counts = [], Counter()
    for key, text in rows:
        a, b = tokens(sides, text or "")
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        counts.update(links)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, i, j = [], 0, 0
        for end in ends:
            first = i, j
            while i < len(a) and a[i][2] <= end:
                i += 1
            while j < len(b) and b[j][2] <= end:
                j += 1
            groups.append("|".join(",".join(str(x[0]) for x in side) for side in (a[first[0]:i], b[first[1]:j])))
        found.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(key, a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "") for key, a, b, g, links, text in found]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts():
    draw = random.Random(4)
    parts = ["the", "Verhältnis", "naïve", "日本語", "😀", "  ", " ", "\n", "\t", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "3.14", "don't",
             " ", " ", "x" * 70, "()", "\x00", "é", "́", "\r\n", "ﬁ", "ＡＢ", "​", "aaaa"]
    out = ["".join(draw.choice(["", " "]) + draw.choice(parts) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    return out + ["a", " ", "  ", " a ", "a▁b", "▁", "tail  ", "\n", "", None, "same", "same"]


def test_against_every_pair_of_tokens(make, sides):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = make([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, links string, block int")
    want = sorted(brute(sides, rows), key=str)
    assert collected(ta.align(df, A_PATH, B_PATH)) == want
    assert collected(ta.align(df.repartition(7), A_PATH, B_PATH, block=50)) == want


def test_query_over_the_whole_table(spark, sides, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op13_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collected(got) == sorted(brute(sides, rows), key=str)


def test_long_text_in_slices_and_many_pieces(make, sides, monkeypatch):
    draw = random.Random(8)
    text = " ".join("".join(draw.choice("abcdeéß") for _ in range(draw.randrange(1, 9))) for _ in range(9000))
    rows = [(1, text), (2, "y" * 5000), (3, text[:400] + "▁" + text), (4, text[::-1])]
    want = sorted(brute(sides, rows), key=str)
    df = make(rows, "doc_id long, text string")
    assert collected(ta.align(df, A_PATH, B_PATH)) == want
    monkeypatch.setattr(ta, "SLICE", 700)
    assert collected(ta.align(df, A_PATH, B_PATH)) == want


def test_pieces_have_equal_work_and_stitch_to_one_merge():
    rng = np.random.default_rng(1)
    for n, m, total in ((50, 70, 100), (1, 90, 90), (90, 1, 90), (64, 64, 64), (200, 3, 5000)):
        a, b = (np.append(np.sort(rng.choice(total - 1, k - 1, replace=False)) + 1 if k > 1 else np.zeros(0, int), total) for k in (n, m))
        b[-1] = a[-1]
        whole = [x.tolist() for x in ta.aligned(a, b, 1 << 30)]
        ends = sorted(set(a.tolist()) | set(b.tolist()))
        assert whole[0] == [int((a < e).sum()) for e in ends] and whole[1] == [int((b < e).sum()) for e in ends]
        assert whole[2] == [e in a and e in b for e in ends]
        for work in (1, 2, 7, 33):
            at_a, at_b = ta.crossings(a, b, work)
            assert set(np.diff(at_a + at_b)[:-1]) <= {work}
            assert [x.tolist() for x in ta.aligned(a, b, work)] == whole


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0


def test_numbers_in_few_bytes():
    for values in ([], [0], [0, 255], [256, 1, 0], [1 << 31, 5], [1 << 40, 0, 7]):
        held = ta.packed(np.array(values, np.int64))
        assert ta.unpacked(held, len(values)).tolist() == values
    assert len(ta.packed(np.array([255] * 100))) == 100


def test_what_a_task_holds_is_small_whatever_it_reads(monkeypatch):
    """A row of a block is below a megabyte, and few texts of a batch are Python strings at a time."""
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)
    draw, most, real = random.Random(6), [], ta.texts_in
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=1200)) for _ in range(600)]

    def texts_in(batches, column):
        for batch, found in real(batches, column):
            most.append(len(found))
            yield batch, found
    monkeypatch.setattr(ta, "TaskContext", Context)
    monkeypatch.setattr(ta, "texts_in", texts_in)
    batch = pa.record_batch({"id": list(range(600)), "text": texts})
    blocks = list(ta._blocks(A_PATH, B_PATH, ta.BLOCK)(iter([batch])))
    assert [d["id"] for b in blocks for d in b.column("documents")[0].as_py()] == list(range(600))
    assert len(blocks) > 2 and max(b.nbytes for b in blocks) < 1 << 20 and sum(most) == 600 and max(most) <= 64
