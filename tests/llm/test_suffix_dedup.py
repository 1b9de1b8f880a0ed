import random

import numpy as np
import pytest

from boundgraph.llm import suffix_dedup


def brute(rows, length):
    """By definition: every string of ``length`` bytes, its earliest start, and what later ones cover."""
    first = {}
    kept = [r for r in rows if r[0] is not None]
    for doc, text in sorted({(d, t or "") for d, t in kept}):
        b = text.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (doc, i))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        if doc is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < (doc, i):
                    gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def sample(seed, n=80):
    rng = random.Random(seed)
    alpha = "ab cdéfgh" if seed % 2 else "ab\x00"
    fresh = lambda k: "".join(rng.choices(alpha, k=k))
    passages = [fresh(rng.randint(30, 200)) for _ in range(6)]
    line = fresh(45)
    rows = []
    for i in range(n):
        parts = [fresh(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [rng.choice([p, p[cut:], p[:cut], line]), fresh(rng.randint(0, 60))]
        rows.append((i * 3, "".join(parts)))
    for i in range(10):
        base = rng.choice(rows[:n])[1]
        rows.append((1000 + i, base))
        if base:
            at = rng.randrange(len(base))
            rows.append((2000 + i, base[:at] + "Z" + base[at + 1 :]))
    rows += [(1, None), (2, ""), (4, "a" * 700), (5, "xy" * 300), (7, "a" * 39), (8, "a" * 40), (9, "a" * 41), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


def removed(spark, rows, length, crowd=suffix_dedup.CROWD):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, pos int")
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, length=length, crowd=crowd).collect()), key=str)


@pytest.mark.parametrize("seed,length,share,send,crowd", [(1, 40, 2.0, 200_000, 10**6), (2, 40, 2.0, 50, 3), (3, 40, 0.05, 50, 10**6), (4, 40, 0.05, 200_000, 5), (5, 100, 0.2, 300, 2), (6, 40, 2.0, 200_000, 1), (7, 32, 2.0, 100, 4)])
def test_matches_the_definition(spark, monkeypatch, seed, length, share, send, crowd):
    """share 0.05, or a small crowd, deals grams by windows; a small send makes many parcels."""
    monkeypatch.setattr(suffix_dedup, "SEND", send)
    grams = suffix_dedup.common_grams
    monkeypatch.setattr(suffix_dedup, "common_grams", lambda rows, n: grams(rows, n, share=share))
    rows = sample(seed)
    assert removed(spark, rows, length, crowd) == brute(rows, length)


def test_repeated_ids_and_no_rows(spark):
    text = "some words that come again and again, in one document or another, é"
    rows = [(1, text + "1"), (1, text + "1"), (1, text), (2, text), (3, "0" + text)]
    got = removed(spark, rows, 50)
    assert len(got) == 5
    by = {}
    for d, n, gone, _, _ in got:
        by.setdefault(d, []).append((n, gone))
    size = len(text.encode())
    one = sorted(by[1])
    assert sum(g > 0 for _, g in set(one)) == 1 and one[1] == one[2]  # of two texts under one id, one is first; equal rows are alike
    assert by[2] == [(size, size)] and by[3] == [(size + 1, size)]
    assert removed(spark, rows[:0], 50) == [] if rows[:0] else True
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_previous_smaller():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        pos, run = rng.integers(0, 12, n), np.sort(rng.integers(0, 6, n))
        want = [max([j for j in range(i) if run[j] == run[i] and pos[j] < pos[i]], default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(pos, run).tolist() == want
