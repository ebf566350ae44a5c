import random

import pytest

from glosswork.llm import passages
from glosswork.llm.line_dedup import Units
from glosswork.llm.queries import op8_line_dedup


def words(seed, n):
    draw = random.Random(seed)
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(999)}" for _ in range(n))


def brute(rows, size):
    """What stays: the words that are in no run of an earlier document."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        parts = text.split()
        runs = [tuple(w.lower() for w in parts[k:k + size]) for k in range(len(parts) - size + 1)]
        gone = {k + j for k, x in enumerate(runs) if x in seen for j in range(size)}
        out[i] = [w for k, w in enumerate(parts) if k not in gone]
        seen |= set(runs)
    return out


def test_passages_in_the_middle_of_lines(make):
    passage, longer, part = words(1, 51), words(2, 120), words(3, 50)
    rows = [(1, f"{words(4, 30)} {passage} {words(5, 20)}"), (2, f"{words(6, 9)}\t{passage.upper()} {words(7, 40)}\nlast line"),
            (3, f"{longer} {words(8, 30)} {part}"), (4, f"{words(9, 60)} {longer}"), (5, f"{words(10, 3)} {part} {words(11, 9)}"),
            (6, f"{words(12, 10)} {' '.join(longer.split()[20:90])} 😀 {passage} {words(13, 4)}"), (7, "la " * 200), (8, "")]
    got = {r["doc_id"]: r for r in passages.dedup(make(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 51)
    assert {i: r["text"].split() for i, r in got.items()} == want
    assert got[2]["text"] == f"{words(6, 9)}\t{words(7, 40)}\nlast line" and got[5]["text"] == rows[4][1] and got[7]["text"] == rows[6][1]
    assert [rows[1][1][s["start"]:s["end"]] for s in got[2]["cut"]] == [passage.upper()]


def with_units(rows, size, least):
    """As ``brute``, and without lines of at least ``least`` words that an earlier document or the same one has before."""
    seen, lines, out = set(), set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts, gone, at = (text or "").split(), set(), 0
        runs = [tuple(w.lower() for w in parts[k:k + size]) for k in range(len(parts) - size + 1)]
        gone = {k + j for k, x in enumerate(runs) if x in seen for j in range(size)}
        for line in (text or "").split("\n"):
            unit = tuple(line.lower().split())
            if len(unit) >= least:
                if unit in lines:
                    gone |= set(range(at, at + len(unit)))
                lines.add(unit)
            at += len(unit)
        out[i] = ([w for k, w in enumerate(parts) if k not in gone], len(parts) - len(gone))
        seen |= set(runs)
    return out


@pytest.mark.parametrize("least", [5, 51])
def test_units_and_passages_in_the_given_text(make, least):
    long, other = words(1, 60), words(2, 70)
    rows = [(1, f"{long}\n{words(3, 6)}\n{long.upper()}\n{words(4, 9)}"), (2, f"{words(3, 6)}\n{words(5, 20)} {other}"),
            (3, f"a {other} b\n{long}"), (4, f"{words(3, 6)}\nx"), (5, f"{words(3, 6)}\nx"), (6, f"{words(6, 80)}\n{words(3, 6)}"),
            (7, f"{words(6, 80)}\n{words(3, 6)}"), (8, None), (9, "")]
    df = make([(i, t, "e") for i, t in rows], "doc_id long, text string, _units string")
    want = with_units(rows, 51, least)
    for r in passages.dedup(df, units=Units("line", least)).collect():
        text = dict(rows)[r["doc_id"]]
        assert (r["text"] or "").split() == want[r["doc_id"]][0], r["doc_id"]
        kept = list(text or "")
        for span in r["cut"]:
            kept[span["start"]:span["end"]] = " " * (span["end"] - span["start"])
        assert "".join(kept).split() == want[r["doc_id"]][0] and r["_units"] == "e"


def test_query_over_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = with_units(rows, 51, 51)
    got = {r["doc_id"]: r for r in op8_line_dedup(spark, sf).collect()}
    assert {i: (r["text"] or "").split() for i, r in got.items()} == {i: w for i, (w, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    changed = sum(r["n_removed"] > 0 for r in got.values())
    assert 0 < changed < len(rows) / 3


def test_copies_in_many_documents_and_a_very_long_text(make, spark):
    long = words(1, 100_000)
    df = spark.range(2000).selectExpr("id as doc_id", f"'{words(2, 60)}' as text").unionByName(make(
        [(5000, long), (5001, "own " + long[: len(long) // 2])], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in passages.dedup(df).collect()}
    assert got[0]["text"] == words(2, 60) and all(got[i]["text"] == "" for i in range(1, 2000))
    assert got[5000]["text"] == long and got[5001]["text"].split()[0] == "own" and len(got[5001]["text"]) < 20


def test_every_overlap_of_many_texts(make):
    """Pieces of few sources, so that runs begin and end anywhere and earlier texts share only parts of them."""
    draw, sources = random.Random(3), [words(s, 300).split() for s in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(3):
            source, at = draw.choice(sources), draw.randrange(250)
            parts += source[at:at + draw.randrange(5, 80)] + words(1000 + i, 3).split()
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: r["text"].split() for r in passages.dedup(make(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 51)


def test_edge_rows(make, spark):
    both = words(1, 60)
    rows = [(None, both), (2, "x\n" + both), (2, "x\n" + both), (3, None), (3, both + "\ny")]
    got = passages.dedup(make(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted(
        [("None", ""), ("2", "x\n" + both), ("2", "x\n" + both), ("3", ""), ("3", "\ny")])
    assert passages.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_removes_them(spark, make, sf):
    import corpus_pipeline as pipeline
    passage = words(1, 70)
    rows = [(1, f"{words(2, 20)} {passage} end"), (2, f"{words(3, 20)} {passage} close")]
    df = make([(i, t, "en", "h", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.line_dedup_stage(spark, df, sf).collect()}
    assert got == {1: rows[0][1], 2: words(3, 20) + " close"}
