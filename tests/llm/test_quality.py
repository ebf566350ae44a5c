import re
from collections import Counter

import pytest

from glosswork.llm import quality
from glosswork.llm.quality import Limits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    under = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under),
            n < 20 or 100 * len(under) > 30 * n)


def key(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\x0c\r").lower()))


def plain_kept(rows, limits):
    """rows: (host, text); whether each is kept and its text without frequent lines."""
    texts = {(h, t) for h, t in rows if t}
    per_host = Counter(h for h, _ in texts)
    of_line = Counter((h, k) for h, t in texts for k in {key(x) for x in t.split("\n") if len(WORD.findall(x)) >= limits.min_line_words})
    bad = {x for x, n in of_line.items() if n > limits.max_line_docs and n > limits.max_line_share * per_host[x[0]]}
    out = []
    for h, t in rows:
        left = "\n".join(x for x in (t or "").split("\n") if not (
            len(WORD.findall(x)) >= limits.min_line_words and (h, key(x)) in bad))
        n, *_, failed = plain(t)
        out.append((not failed and len(WORD.findall(left)) >= limits.min_kept_share * n, left if t is not None else None))
    return out


ODD = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "# $ <a> | & é\x0bß\x85z q",
       "l one\nl one\n\nl one \n", "\n \n", "w " * 7 + "end", " ".join(str(i % 12) for i in range(100)), "z" * 100_000,
       " ".join(str(i * 7919 % 5000) for i in range(6000)) + " 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"]
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics_of_odd_texts(make):
    df = quality.quality_digest(make([(i, "h", t) for i, t in enumerate(ODD)], "doc_id long, source string, text string"))
    got = [tuple(r[n] for n in NAMES) for r in df.orderBy("doc_id").collect()]
    assert got == [plain(t) for t in ODD]


@pytest.mark.parametrize("host", ["h", None])
def test_frequent_lines_go_and_depleted_documents_are_rejected(make, host):
    body = lambda i, n: " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(n))
    limits = Limits(max_line_docs=5, max_line_share=0.1)
    common = "Read More  about us 2024"
    rows = [(host, f"{body(i, 30)}\n{common}{i}") for i in range(12)]
    rows += [(host, "\n".join([common] * 8 + [body(50, 9)])), ("other", f"{body(60, 30)}\n{common}"), (host, None), (host, "")]
    rows += [(host, body(70, 40))] * 30  # copies: their own lines don't become frequent
    df = make([(i, h, t, 1, "q") for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, _host int, host string")
    got = quality.quality(df, limits).orderBy("doc_id").collect()
    assert [(r["quality"]["kept"], r["quality"]["text_left"]) for r in got] == plain_kept(rows, limits)
    assert got[0]["quality"]["lines_removed"] == 1 and got[12]["quality"]["kept"] is False and got[-1]["quality"]["kept"]
    assert set(df.columns) <= set(got[0].asDict())


def test_repeated_words_at_every_place(make):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:i] + ["r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "r9"] * 2 + base[i:]) for i in range(0, 40, 7)]
    df = quality.quality_digest(make([(i, "h", t) for i, t in enumerate(texts)], "doc_id long, source string, text string"))
    assert [r["n_repeat_words"] for r in df.orderBy("doc_id").collect()] == [plain(t)[4] for t in texts]


def test_empty_table(spark):
    assert quality.quality_digest(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_query_against_brute_force(spark, sf):
    from glosswork.llm import queries
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = plain_kept([(r["source"], r["text"]) for r in docs], Limits())
    want = {r["doc_id"]: (*plain(r["text"]), k) for r, (k, _) in zip(docs, kept)}
    got = queries.QUERIES["op2_line_quality"](spark, sf).collect()
    assert {r["doc_id"]: (*(r[n] for n in NAMES), r["kept"]) for r in got} == want and len(got) == len(want)
