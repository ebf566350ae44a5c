import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glosswork.llm import packing, vocab

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Hello, World! it's I'LL 123 4", "ÉÀ ß ẞ Σας ΟΔΟΣ İstanbul  x y　z\x1cq\x85w", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>",
       "é äb", "\n\n\t tab\r\n", "日本語 テスト 😀😀", "x" * 5000, "don't, stop.,. ,., a.b,c", "퟿�", "1,000.50 ½ ² ǅ",
       " ".join(f"w{i}é" for i in range(3000)), "\0 a\0b", "nbsp , ,​."]


def want_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_those_of_the_library():
    got = [np.frombuffer(b, "<u4").tolist() for b in vocab.WordCoder(PATH).encode(ODD)]
    assert got == want_ids(ODD)


def test_memory_is_bounded_and_slices_agree(monkeypatch):
    monkeypatch.setattr(vocab, "REMEMBER", 5)
    monkeypatch.setattr(vocab, "SLICE", 7)
    monkeypatch.setattr(vocab.pieces_of, "__defaults__", (7,))
    got = [np.frombuffer(b, "<u4").tolist() for b in vocab.WordCoder(PATH).encode(ODD)]
    assert got == want_ids(ODD)


def check(rows, docs, capacity):
    """docs: id -> list of texts. Every id of every document is in one piece; windows are gapless and not over-full."""
    ids = {k: [[*x, 1] for x in want_ids([t or "" for t in v])] for k, v in docs.items()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["id"]].append((r["start"], r["length"], r["crc"], r["tokens"]))
    for k, many in ids.items():
        want = sorted((s, len(x[s:s + capacity]), zlib.crc32(np.array(x[s:s + capacity], "<u4").tobytes()), len(x))
                      for x in many for s in range(0, len(x), capacity))
        assert sorted(pieces.pop(k)) == want
    assert not pieces
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= capacity
    return len(windows)


@pytest.mark.parametrize("group", [4096, 8])
def test_packing_rounds(spark, make, monkeypatch, group):
    monkeypatch.setattr(packing, "_GROUP", group)
    texts = [None, "", *ODD, *[" ".join(["word"] * (i * 37 % 90)) for i in range(300)]]
    rows = [(i if i % 50 else None, t, 1, "s") for i, t in enumerate(texts)] + [(7, "again", 1, "s")] * 3
    docs = defaultdict(list)
    for i, t, *_ in rows:
        docs[i].append(t)
    df = make(rows, "doc_id long, text string, offset int, sequence string").repartition(13)
    got = packing.pack(df, PATH, capacity=64, open_windows=4).collect()
    n = check(got, docs, 64)
    assert n <= 1.2 * sum(r["length"] for r in got) / 64 + 3


def test_empty_table_and_text_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    got = packing.pack(spark.createDataFrame([("a", "x y")], "doc_id string, text string"), PATH).collect()
    assert [(r["id"], r["length"], r["offset"]) for r in got] == [("a", 3, 0)]


def test_windows_take_the_fullest_that_fits():
    w = packing.Windows(10, 2)
    p = [("a", 0, 0, 0, 0, 0)]
    assert not list(w.put(6, p)) and not list(w.put(7, p)) and not list(w.put(2, p))  # 6, 9
    closed = list(w.put(5, p))
    assert [x[0] for x in closed] == [9] and sorted(x[0] for x in w.rest()) == [5, 6]
    assert [x[0] for x in w.put(4, p)] == [10] and [x[0] for x in w.put(10, p)] == [10]


def test_query_packs_all_documents(spark, sf):
    from glosswork.llm import queries
    docs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        docs[r["doc_id"]].append(r["text"])
    rows = queries.QUERIES["op7_bounded_packing"](spark, sf).collect()
    rows = [{"id": r["doc_id"], "start": r["start"], "length": r["length"], "crc": r["ids_crc32"], "tokens": r["doc_tokens"],
             "sequence": r["sequence_id"], "offset": r["offset"]} for r in rows]
    n = check(rows, docs, 2048)
    assert n * 2048 <= 1.05 * sum(r["length"] for r in rows) + 2048
