import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glosswork.llm import bpe_tree, vocab
from glosswork.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
_DRAW = random.Random(3)
ODD = ["", " ", "  ", "a", "Hello, World! it's I'LL 123 4  x", "É À ß ẞ Σας 　z\x1cq\x85w", "<|endoftext|>x<|endoftext|> <|ENDOFTEXT|> <|endoftext|>",
       "é äb", "\n\n\t tab\r\n  end \n", "日本語 テスト 😀😀", "x" * 5000, "ab" * 3000 + " tail", "don't, stop.,. ,., a.b,c", "￿�",
       "".join(_DRAW.choice("abcdefgh") for _ in range(9000)), "日" * 4000, " " * 3000 + "x", "0123456789" * 900,
       "\0 a\0b", "nbsp , ,​.", "<|endoftext|>" * 3 + "y" * 2500]


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def want(texts):
    library = Tokenizer.from_file(PATH)
    return [(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(
        library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for ids in library_ids(texts)]


@pytest.fixture(scope="module")
def coder():
    return bpe_tree._coder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aabbcdé 1.'\n", max_size=200), st.integers(1, 9))
def test_joined_parts_are_the_encoding_of_the_whole(coder, text, most):
    merges = bpe_tree.Merges(coder)
    word = merges.written(text)
    parts = [merges.encode(p) for p in bpe_tree.halves(word, most)]
    assert bpe_tree.concatenated(parts, merges.encode, merges.text) == merges.encode(word)


@pytest.mark.parametrize("spread", [1 << 31, 1000])
def test_ids_are_those_of_the_library(make, monkeypatch, spread):
    texts = [*ODD, None]
    docs = make([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in bpe_tree.encode(docs, PATH, spread=spread).collect()}
    assert got == {i: (len(x), x) for i, x in enumerate(library_ids(texts))}
    digests = {r["id"]: tuple(r)[1:] for r in bpe_tree.encode(docs, PATH, result="digest", spread=spread).collect()}
    assert digests == dict(enumerate(want(texts)))


@pytest.mark.parametrize("spread", [bpe_tree.SPREAD, 1000])
def test_repeats_null_ids_and_empty_tables(make, spread):
    long = "ab" * 2000
    docs = make([(1, long), (1, long), (None, long), (None, "a b"), (2, None), (1, "a b")], "doc_id long, text string")
    n, m = (len(x) for x in library_ids([long, "a b"]))
    got = sorted(((r["id"], r["n_tokens"]) for r in bpe_tree.encode(docs, PATH, spread=spread).collect()), key=str)
    assert got == sorted([(1, n), (1, n), (None, n), (None, m), (2, 0), (1, m)], key=str)
    assert bpe_tree.encode(docs.where("doc_id = 9"), PATH, spread=spread).collect() == []


def test_runs_just_below_the_limit(make):
    text = "ab" * 65_000 + " " + "cd" * 65_000 + " " + "ab" * 100
    start = time.perf_counter()
    rows = bpe_tree.encode(make([(1, text)], "doc_id long, text string"), PATH).collect()
    assert rows[0]["n_tokens"] == len(library_ids([text])[0]) and time.perf_counter() - start < 8  # once over 10 seconds


def test_memory_is_bounded_and_slices_agree(monkeypatch):
    monkeypatch.setattr(vocab, "REMEMBER", 5)
    monkeypatch.setattr(vocab.pieces_of, "__defaults__", (7,))
    coder = bpe_tree._coder(PATH)
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in ODD] == library_ids(ODD)


def test_round_trip(make):
    docs = make([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, other int")
    back = bpe_tree.decode(bpe_tree.encode(docs, PATH), PATH)
    assert {r["id"]: r["text"] for r in back.collect()} == dict(enumerate(ODD))
    coded = make([(1, bytes(4 * [255]), None)], "k int, bad binary, ids binary")
    assert bpe_tree.decode(coded, PATH).collect()[0]["text"] is None


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r["doc_id"], *w) for r, w in zip(rows, want([r["text"] for r in rows])))
    assert sorted(tuple(r) for r in QUERIES["op3_tree_bpe"](spark, sf).collect()) == expected
