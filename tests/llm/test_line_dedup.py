import pytest

from glosswork.llm import line_dedup
from glosswork.llm.line_dedup import Units

A, B, C = "one two three four five", "Six seven  eight nine TEN", "alpha beta gamma delta epsilon zeta"


def brute(rows, units, separator):
    seen, out = set(), {}
    for key, text in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, cut, at = [], [], 0
        for u in (text or "").split(separator):
            n = " ".join(u.lower().split())
            if len(n.split()) >= units.min_words and n in seen:
                cut.append((at, at + len(u)))
            else:
                kept.append(u)
            if len(n.split()) >= units.min_words:
                seen.add(n)
            at += len(u) + len(separator)
        out[(key, text)] = (separator.join(kept) if text is not None else None, cut)
    return [out[r] for r in rows]


@pytest.mark.parametrize("kind,sep", [("line", "\n"), ("paragraph", "\n\n")])
def test_later_units_go(make, kind, sep):
    rows = [(5, f"{A}{sep}x y{sep}{B}"), (3, f"{C}{sep}{A.upper()} {sep}x y{sep}{C}"), (4, None), (6, ""), (7, f"{sep}{A}{sep}{sep}{B}{sep}"),
            (5, f"{A}{sep}x y{sep}{B}"), (None, f"😀é {C}{sep}{B}{sep}end"), (9, " \t "), (8, f"{B.replace('  ', ' ')}")]
    df = make([(k, t, "e", 1) for k, t in rows], "doc_id long, text string, _rank string, removed int")
    got = line_dedup.dedup(df, Units(kind, 5)).collect()
    key = lambda x: (str(x[0]), str(x[1]), str(x[2]))
    found = sorted(((r["doc_id"], r["text"], [(s["start"], s["end"]) for s in r["removed"]]) for r in got), key=key)
    want = sorted(((k, t, c) for (k, _), (t, c) in zip(rows, brute(rows, Units(kind, 5), sep))), key=key)
    assert found == want and "_rank" in got[0].asDict()


def test_offsets_are_those_of_the_original():
    text = f"{A}\n{B}\n{C}"
    left, cut = line_dedup.without(text, {1}, "\n")
    assert left == f"{A}\n{C}" and [text[c["start"]:c["end"]] for c in cut] == [B]


def test_a_line_in_very_many_documents(spark):
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('{A}\n', 'own words of number ', id, ' here now') as text")
    got = line_dedup.dedup(df)
    assert got.where("size(removed) = 1").count() == 2999 and got.where("doc_id = 0 and size(removed) = 0").count() == 1


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_line_and_a_long_text(make):
    line = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, line), (2, f"{A}\n" * 3000 + line)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(make(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == line and got[2]["text"] == A and len(got[2]["removed"]) == 3000  # the later ones, and the long line
