import numpy as np

from boundgraph.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int, score string"


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        a = np.array(x, dtype=np.float32).astype(float)
        found = sorted(((-(a * np.array(y, dtype=np.float32).astype(float)).sum(), i) for i, y in rows if i != q and len(y) == len(x)))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def searched(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q, found in out.items():
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        out[q] = [x[1:] for x in found]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 48)) * rng.uniform(0.5, 2, (3000, 1)) + 0.3
    x[100:140] = x[100]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 0, 0, 0, "s") for i, v in rows], SCHEMA)
    got = searched(ann.search(table, table.where("vec_id % 100 = 0"), k=20, block=700))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 20 * len(want)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda t: (-t[1], t[0]))
        for i, s in found:
            assert abs(s - (np.float32(x[q]).astype(float) * np.float32(x[i]).astype(float)).sum()) < 1e-9
    assert [i for i, _ in got[100][:5]] == [i for i, _ in want[100][:5]]


def test_clusters_need_few_lists(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((60, 32)) * 3)[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 32)) * 0.2
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 0, 0, 0, "s") for i, v in rows], SCHEMA)
    got = searched(ann.search(table, table.where("vec_id % 50 = 0"), k=10))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(f) == 10 for f in got.values()) and hits >= 0.97 * 10 * len(want)


def test_error_scale_covers_the_error():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 100)), rng.standard_normal((20, 100))
    mean, turn = x.mean(axis=0), ann.rotation(100)
    guess, error = ann.Codes(x, mean, turn).estimates(ann.Asked(q, turn), np.arange(20))
    off = np.abs(guess - q @ x.T) / error
    assert (off < 2.5).mean() > 0.97 and (off > 0.3).mean() > 0.2


def test_repeated_rows_and_equal_vectors(spark):
    """Rows of one id many times over, and crowds of equal vectors, leave all other candidates in place."""
    rng = np.random.default_rng(5)
    rows = [(3, [float(c) for c in np.float32(rng.standard_normal(8) * 9)])] * 25
    rows += [(i, [float(c) for c in np.float32(rng.standard_normal(8))]) for i in range(100, 158)]
    rows += [(i, [2.0] * 8) for i in range(200, 260)] + [(20, [5.0] * 8), (20, [-5.0] * 8), (40, [2.0] * 8)]
    table = spark.createDataFrame([(i, v, 0, 0, 0, "s") for i, v in rows], SCHEMA)
    asked = sorted({(i, tuple(v)) for i, v in rows if i % 20 == 0})
    got = searched(ann.search(table, table.where("vec_id % 20 = 0"), k=20, bound=100.0, reach=1.0))
    every = sorted({(i, tuple(v)) for i, v in rows})
    for q in {i for i, _ in asked}:
        found = {(i, float((np.array(v) * np.array(a)).sum())) for j, a in asked if j == q for i, v in every if i != q}
        assert got[q] == sorted(found, key=lambda t: (-t[1], t[0]))[:20]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [5.0]), (9, [])]
    table = spark.createDataFrame([(i, v, 0, 0, 0, "s") for i, v in rows], SCHEMA)
    got = searched(ann.search(table, table.where("vec_id % 4 = 0")))
    assert got == {0: [(1, 2.0), (2, 2.0)]}
    assert ann.search(table.limit(0), table.limit(0)).count() == 0
