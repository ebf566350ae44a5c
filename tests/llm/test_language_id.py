import zlib
from collections import Counter
from math import exp, isclose, log

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from glosswork.llm import language_id as li
from glosswork.llm.queries import op11_language_id

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


@pytest.fixture(scope="module")
def pieces():
    return li.Pieces(PATH)


def cuts(word, names):
    """All segmentations of a word, one by one; a character that is no piece is itself."""
    def rest(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if text[:n] in names or n == 1:
                for tail in rest(text[n:]):
                    yield (text[:n], *tail)
    return list(rest("▁" + word))


def log_of(piece, names, column, cutter):
    return column[names[piece]] if piece in names else sum(column[cutter.bytes[b]] for b in piece.encode())


@pytest.fixture(scope="module")
def names():
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {vocabulary.id_to_piece(i): i for i in range(vocabulary.get_piece_size())
            if not vocabulary.is_byte(i) and not vocabulary.is_control(i) and not vocabulary.is_unknown(i)}


def test_sums_over_all_segmentations(pieces, names):
    words = ["the", "a", "unheit", "ñandú", "𐍈x", "日本", "qéq", "ъы"]
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(pieces.size), 3).T)
    arcs = pieces.arcs(words)
    got = li.word_scores(arcs, pieces.log_p(log_p, arcs.extra))
    for i, word in enumerate(words):
        for k in range(3):
            want = log(sum(exp(sum(log_of(p, names, log_p[:, k], pieces) for p in cut)) for cut in cuts(word, names)))
            assert isclose(got[i, k], want, rel_tol=1e-12)


def test_expected_counts(pieces, names):
    words, langs, weights = ["then", "ing", "éé", "𐍈x"], [0, 1, 0, 1], [1.0, 5.0, 2.0, 3.0]
    log_p = np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.size), 2).T)
    arcs = pieces.arcs(words)
    got = li.expected(arcs, pieces.log_p(log_p, arcs.extra), np.array(langs), np.array(weights))
    want = Counter()
    for word, k, weight in zip(words, langs, weights):
        chances = {cut: exp(sum(log_of(p, names, log_p[:, k], pieces) for p in cut)) for cut in cuts(word, names)}
        for cut, chance in chances.items():
            for p in cut:
                want[p, k] += weight * chance / sum(chances.values())
    for (p, k), n in want.items():
        at = names[p] if p in names else pieces.size + arcs.extra.index(p)
        assert isclose(got[at, k], n, rel_tol=1e-9)
    assert isclose(got.sum(), sum(want.values()), rel_tol=1e-9)


def test_rounds_raise_the_likelihood(make):
    df = make([(i, t, x, "", 0) for i, (t, x) in enumerate([("the thing there then", "en"), ("der die das Ding", "de")] * 3)], SCHEMA)
    cutter, fits = li.Pieces(PATH), []
    for rounds in (0, 1, 2, 4):
        model = li.learn(df, PATH, plan=li.Learning(rounds, 1e-9))
        arcs = cutter.arcs(["the", "thing", "there", "then"])
        fits.append(li.word_scores(arcs, model.log_p)[:, model.languages.index("en")].sum())
    assert fits == sorted(fits) and fits[1] > fits[0] + 10


def test_predictions_and_odd_rows(make, spark):
    train = make([(1, "the cat and the dog of the house", "en", "", 0), (2, "der Hund und die Katze im Haus", "de", "", 0), (3, None, "fr", "", 0),
                  (4, "les mots", None, "", 0), (4, "123 ½", "it", "", 0), (2, "der Hund und die Katze im Haus", "de", "", 0)], SCHEMA)
    model = li.learn(train, PATH)
    assert model.languages == ["de", "en"]
    rows = [(1, "THE house and", "xx", "", 0), (2, "die Katze", None, "", 0), (3, None, "en", "", 0), (4, "12 ½ ² -- 日", "", "", 0), (5, "½ 12 !", "", "", 0),
            (6, "", "", "", 0), (7, "日本語" * 300, "", "", 0), (8, "the" * 50_000, "", "", 0), (None, "Hund", "", "", 0), (None, "Hund", "", "", 0)]
    got = {}
    for r in li.predict(make(rows, SCHEMA), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (1, 2, 3, 5, 6)] == ["en", "de", "und", "und", "und"]
    assert all(got[i][0]["score"] == 0 for i in (3, 5, 6)) and len(got[None]) == 2 and got[None][0]["lang_pred"] == "de"
    assert got[4][0]["lang_pred"] in ("de", "en") and got[7][0]["lang_pred"] in ("de", "en") and got[8][0]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for r in got.values() for x in r) and got[1][0]["lang"] == "xx"
    empty = spark.createDataFrame([], SCHEMA)
    assert li.predict(empty, model).count() == 0
    none = li.learn(empty, PATH)
    assert {r["lang_pred"] for r in li.predict(make(rows, SCHEMA), none).collect()} == {"und"}


def test_held_out_accuracy_over_the_whole_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = op11_language_id(spark, sf)
    assert got.schema.simpleString() == "struct<doc_id:bigint,held_out:boolean,lang_pred:string,score:double>"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = got.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert len(held) > 200 and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.98 * len(held)
