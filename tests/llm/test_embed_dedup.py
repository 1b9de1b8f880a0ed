import math
import random

import numpy as np
import pytest

from boundgraph.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, copies int"


def brute(rows, cosine=0.98):
    ok = [i for i, (v, x, l) in enumerate(rows) if v is not None and l is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    links = {i: [] for i in range(len(rows))}
    root = {i: rows[i][0] for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].append(b)
    changed = True
    while changed:
        changed = False
        for a in ok:
            low = min([root[a], *(root[b] for b in links[a])])
            if low < root[a]:
                root[a], changed = low, True
    return sorted(((rows[i][0], len(links[i]), root[i]) for i in links), key=str)


def sample(seed, dim=16, n=300):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(0, i + 1) if rng.random() < 0.5 else i]
        x = x + rng.standard_normal(dim) * 0.04 * rng.integers(0, 4)
        rows.append((i, [float(c) for c in np.float32(x * rng.choice([1, 5]))], int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_matches_brute_force(spark, block):
    rows = sample(1) + [(1000 + i, [1.0] * 16, 1) for i in range(30)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(table, block=block).collect()), key=str)
    assert got == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [1.0, 2.0, 3.0]
    rows = [(1, x, 0), (2, x, None), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [nan, 1.0, 1.0], 0), (6, [inf, 1.0, 1.0], 0), (7, [None, 1.0, 1.0], 0), (8, x, 0), (8, x, 0), (None, x, 0), (9, [], 0), (10, [1.0, 2.0], 0), (11, [2.0, 4.0, 6.0], 0), (12, [1e-30, 2e-30, 3e-30], 0)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(table).collect()), key=str)
    want = []
    for v, e, l in rows:
        linked = e in (x, [2.0, 4.0, 6.0], [1e-30, 2e-30, 3e-30]) and v is not None and l == 0
        want.append((v, 4, 1) if linked else (v, 0, v))
    assert got == sorted(want, key=str)
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0
