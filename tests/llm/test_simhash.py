import numpy as np
import xxhash

from glosswork.llm import simhash


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_matches_definition():
    for text in ["", " \t", "one", "Two words", "a b c d", "A b\x0bC d e f g h i a b c d e", "é É ß ẞ z z k l", "x " * 500]:
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text)


def test_long_text_in_slices(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(3000))
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "_SLICE", 100)
    assert simhash.fingerprint(text, 4) == whole


def test_masks_are_the_whole_ball():
    for n in (6, 8, 11):
        masks = simhash.masks_by_parity(n, 2)
        every = np.concatenate(list(masks.values()))
        assert len(every) == len(set(every.tolist())) == 1 + 64 + 64 * 63 // 2
        assert all(f.bit_count() <= 2 for f in masks)


def test_links_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)} | {0, 2**64 - 1, 1 << 63}
    for seed in list(fps)[:40]:  # chains and balls around them
        x = seed
        for _ in range(int(rng.integers(1, 12))):
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for count in (10, 10**6):
        links = simhash.fingerprint_links(df, 4, count)
        pairs = [(r["high"] % 2**64, r["low"] % 2**64) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 4 * len(fps) for a, b in pairs)
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(links).collect()}
        got = [roots.get(x, x) for x in fps]
        want = brute(list(range(len(fps))), fps)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(2000, 2400)] + [(5000, 4999)]
    df = spark.createDataFrame(path, "high long, low long")
    roots = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert len(set(roots.values())) == 3 and len(roots) == 301 + 401 + 2 - 3


def test_near_duplicates_with_nulls_ties_and_extra_columns(make):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(7, text, 1, 2), (3, text + " more", 1, 2), (None, text, 1, 2), (9, None, 1, 2), (8, "", 1, 2), (8, "", 1, 2), (1, "unlike any other", 1, 2)]
    got = simhash.near_duplicates(make(rows, "doc_id long, text string, fp int, component int"))
    assert sorted((str(r["id"]), str(r["component"])) for r in got.collect()) == sorted([
        ("7", "3"), ("3", "3"), ("None", "3"), ("9", "8"), ("8", "8"), ("8", "8"), ("1", "1")])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, sf):
    from glosswork.llm import queries
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{fp:016x}", c) for r, fp, c in zip(docs, fps, brute([r["doc_id"] for r in docs], fps))}
    got = queries.QUERIES["op9_simhash_components"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(want)
