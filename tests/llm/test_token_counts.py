import public_tokenizers
import pytest
from test_bpe_tree import ODD
from tokenizers import Tokenizer

from glosswork.llm import token_counts
from glosswork.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("block", [1, 50, 1 << 22])
def test_counts_are_those_of_the_library(make, block):
    texts = [*ODD, None, ODD[3], ODD[3]]
    docs = make([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, pieces int, block string")
    got = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH, block=block).collect()}
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, want(texts)))}


def test_repeats_null_ids_and_empty_tables(make):
    docs = make([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 3, 2), (1, 3, 2), (None, 3, 2), (2, 0, 0), (None, 0, 0)], key=str)
    assert token_counts.count_tokens(docs.where("doc_id = 9"), PATH).collect() == []
    blank = token_counts.count_tokens(docs.where("text is null").drop("other"), PATH)
    assert sorted(r["n_tokens"] for r in blank.collect()) == [0, 0]


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_token_counts"](spark, sf).collect()
    numbers = dict(zip(texts, want(texts.values())))
    assert sorted(tuple(r) for r in rows) == sorted((k, len(t.encode()), numbers[k], numbers[k] > 1024) for k, t in texts.items())
