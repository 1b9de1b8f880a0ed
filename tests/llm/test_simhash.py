import random
from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Row

from boundgraph.llm import simhash

SCHEMA = "doc_id long, text string, node string, f0 string"


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def sample():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ÀB", "Zz"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(60)]
    for _ in range(60):
        t = rng.choice(texts).split()
        if t:
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["", None, " \t\n", "one", "one two", "One  TWO", "x " * 30000, texts[0], texts[0]]
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "n", "f") for i, t in rows], SCHEMA)
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i]["f0"] % 2**64 == prints[i]
        assert got[i]["component"] == want[i]


def test_hot_bucket_is_split(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {i: base ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for i in range(400)}
    prints |= {1000 + i: base ^ (1 << i % 64) ^ (1 << (i * 7 + 1) % 64) for i in range(64)}
    one = {}
    for i, p in sorted(prints.items()):
        one.setdefault(p, i)
    nodes = spark.createDataFrame([Row(node=i, f0=p - 2**64 if p >= 2**63 else p) for p, i in one.items()])
    links = simhash.links(nodes, 3, simhash.exact_tables(1, 3, 400), block=16)
    found = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
    want = brute_components({i: p for p, i in one.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_rows_of_all_tables_are_never_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    schema = "node long, " + ", ".join(f"f{w} long" for w in range(4))
    rows = [(i, *map(int, rng.integers(-(2**62), 2**62, 4))) for i in range(500)]
    nodes = simhash.materialise(spark.createDataFrame(rows, schema), "nodes")  # small, and so its files say; 96 tables have 96 times the rows
    kept, plans = simhash.materialise, []
    monkeypatch.setattr(simhash, "materialise", lambda df, name="step": (plans.append((name, df._jdf.queryExecution().sparkPlan().toString())), kept(df, name))[1])
    simhash.links(nodes, 64, simhash.drawn_tables(4, 96, 16, 0.15, 500), 4).collect()
    assert [name for name, _ in plans] == ["blocks"] and "Broadcast" not in plans[0][1]


def test_tables_get_wider_and_stay_exact():
    rng = random.Random(7)
    for n, parts in ((1000, 4), (2**24, 4), (2**30, 5), (2**36, 6), (2**45, 8)):
        tables = simhash.exact_tables(1, 3, n)
        assert len(tables) == len(list(combinations(range(parts), 3))) and min(map(len, tables)) >= simhash.table_width(n, 1)
        for _ in range(300):
            apart = set(rng.sample(range(64), 3))
            assert any(not apart & set(t) for t in tables)
    few, many = (simhash.drawn_tables(4, 96, 16, 0.1515, n) for n in (10**5, 2**30))
    assert (len(few), len(few[0])) == (96, 16) and len(many[0]) == 22
    assert 1 - (1 - 0.8485**22) ** len(many) >= 1 - (1 - 0.8485**16) ** 96 - 1e-6


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, "a b c d e f"), (2, ""), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["id"] is None, r["id"], r["f0"] == 0, r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(False, 1, False, 1), (False, 1, True, 1), (False, 2, True, 1), (False, 3, False, 1), (True, None, False, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_wide_fingerprints_find_looser_copies(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(20):
        t = rng.choices(words, k=400)
        rows.append((2 * i, " ".join(t)))
        for at in rng.sample(range(400), 4):
            t[at] = "new"
        rows.append((2 * i + 1, " ".join(t)))
    got = {r["id"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=2, max_bits=24, tables=partial(simhash.drawn_tables, 2, 32, 16, 0.1)).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def brute_families(rows, shingle=5, similarity=0.8):
    """Components of rows by the Jaccard similarity of their sets of shingles."""
    sets = {i: {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited_families(rng, n=8, size=60):
    """Families of texts of 300 words, each with 2 to 5 words of one text changed."""
    rows = []
    for k in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for i in range(size):
            t = list(base)
            for at in rng.sample(range(300), rng.randint(2, 5)):
                t[at] = f"new{rng.randrange(10**9)}"
            rows.append((size * k + i, " ".join(t)))
    return rows


def test_a_refused_link_hides_no_other(spark):
    rows = edited_families(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.near_duplicates(docs, shingle=5, words=4, max_bits=64, tables=partial(simhash.drawn_tables, 4, 96, 16, 0.1515), similarity=0.8).collect()}
    want = brute_families(rows)
    print("components", len(set(got.values())), "of", len(set(want.values())))
    assert got == want


def test_large_families_are_split(spark):
    rows = edited_families(random.Random(6), 2, 40)
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 80)], "a long, b long")
    want = brute_families(rows)
    for grams, block in ((1 << 19, 2048), (2000, 2048), (1 << 19, 9)):
        links = simhash.alike(chain, docs, 0.8, 5, grams=grams, block=block)
        found = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_links_of_sets_connect_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 12))) for _ in range(rng.integers(1, 12))]
        a, b = simhash.similar_links(np.concatenate(sets), np.array([len(s) for s in sets]), 0.6)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))]
        roots = lambda p: simhash.local_roots(len(sets), iter([tuple(np.array(p, dtype=np.int64).reshape(-1, 2).T)])).tolist()
        assert roots(list(zip(a, b, strict=True))) == roots(pairs)


def test_repeated_lines_neither_make_nor_hide_copies(spark):
    rng = random.Random(9)
    drawn = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    line = drawn(9)
    rows = [(i, f"{f'{line} ' * 100}{drawn(50)}") for i in range(4)]  # much alike if shingles count as often as they occur
    for i in range(10, 30, 2):
        text = drawn(200).split()
        again = text[90:99]
        rows += [(i, " ".join(text)), (i + 1, " ".join(text[:99] + again * 10 + text[99:]))]
    rows += [(40, "a b c d e f a b c d e"), (41, "A b c d e f a b c d E"), (42, "a b c d e f a b c d e f a b c d e"), (43, None), (44, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, shingle=5, words=4, max_bits=64, tables=partial(simhash.drawn_tables, 4, 96, 16, 0.1515), similarity=0.8)
    assert found.columns == ["id", "f0", "f1", "f2", "f3", "component"]
    got = {r["id"]: r["component"] for r in found.collect()}
    want = brute_families([(i, (t or "").lower()) for i, t in rows])
    assert got == want and got[3] == 3 and got[11] == 10 and got[44] == 43


def test_different_texts_of_one_fingerprint_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    prints = spark.createDataFrame([(1, -1, 5, 5), (2, -1, 5, 5), (3, -1, 6, 6)], "id long, f0 long, s0 long, s1 long")
    kept, simhash.fingerprints = simhash.fingerprints, lambda *_: prints
    try:
        got = {r["id"]: r["component"] for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    finally:
        simhash.fingerprints = kept
    assert got == {1: 1, 2: 1, 3: 3}
