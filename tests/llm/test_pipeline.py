import random

import numpy as np
import pytest

import corpus_pipeline
from boundgraph.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    docs, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.25
        text = rng.choices(words, k=rng.randint(60, 200))
        if bad:
            text[rng.randrange(len(text))] = "rubbish"
            text += ["rubbish"]
        docs.append([i, " ".join(text), "en", "hot" if rng.random() < 0.5 else rng.choice("ab"), 0])
        if i < 200:
            labels.append((i, int(not bad), 0))
    good = [d for d in docs if "rubbish" not in d[1]]
    for k in range(40):
        base = good[k]
        near = base[1].split()
        near[k % len(near)] = "changed"
        docs.append([1000 + k, " ".join(near) if k % 2 else base[1], *base[2:]])
    good[60][1] += " write to someone@mail.example.org or +1 (565) 555-5579"
    docs += [[5000, None, None, None, None], [5001, "", "en", "a", 0], [None, "text without id " + " ".join(words[:50]), "en", "a", 5]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d[:4], len(d[1] or "")) for d in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_every_stage_does_its_part(spark, tables):
    folder, docs = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources", "best-fit packing"]
    text = {d[0]: d[1] or "" for d in docs}

    kept = stages["quality classifier"](spark, frame, folder)
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    wrong = [i for i in text if i is not None and i < 2000 and (i in ids) == ("rubbish" in text[i])]
    assert len(wrong) <= 4

    single = stages["SimHash near-dedup"](spark, frame, folder)
    assert single.columns == columns
    left = {r["doc_id"] for r in single.collect()}
    assert {i for i in text if i is not None} - left == {1000 + k for k in range(40)} | {5001}  # the empty text is a copy of the null one
    for k in range(40):
        assert any(jaccard(text[1000 + k], text[i]) >= 0.8 for i in left if i is not None and i < 300)

    masked = {r["doc_id"]: r for r in stages["PII"](spark, frame, folder).collect()}
    hit = [i for i, r in masked.items() if r["text"] != (text[i] if i != 5000 else None)]
    assert len(hit) == 1 and "write to [EMAIL] or [PHONE]" in masked[hit[0]]["text"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in masked.values()) and len(masked) == len(docs)

    mixed = stages["mixing sources"](spark, frame, folder)
    assert mixed.columns == columns
    tokens_of = lambda df: {r["source"]: r["n"] for r in df.selectExpr("source", "size(split(text, ' ')) n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    was, now = tokens_of(frame), tokens_of(mixed)
    assert now["hot"] / sum(v for v in now.values() if v) < was["hot"] / sum(v for v in was.values() if v)

    packed = stages["best-fit packing"](spark, frame, folder).collect()
    own = tokens.encoder(tokens.default_path())
    assert sum(r["length"] for r in packed) == sum(len(own.ids(d[1])) + 1 for d in docs)


def test_run_applies_all_stages(spark, tables):
    folder, _ = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1].tolist()] and ends[-1] <= corpus_pipeline.CAPACITY
    assert 150 < len(rows) < 400


def test_no_documents(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def copies_at(rng, n, changed, first=0):
    """``n`` texts of 270 shingles and a copy of each in which ``changed`` words, more than five apart, are others."""
    rows = []
    for i in range(n):
        t = [f"w{rng.randrange(5000)}" for _ in range(274)]
        rows.append((first + 2 * i, " ".join(t)))
        for k in range(changed):
            t[10 + 40 * k] = f"new{i}x{k}"
        rows.append((first + 2 * i + 1, " ".join(t)))
    return rows


def test_near_duplicates_at_the_least_similarity(spark):
    rng = random.Random(3)
    rows = copies_at(rng, 300, 6) + copies_at(rng, 100, 5, 1000) + copies_at(rng, 40, 7, 2000)
    text = dict(rows)
    assert jaccard(text[0], text[1]) == 0.8 and 0.8 < jaccard(text[1000], text[1001]) < 0.85 and jaccard(text[2000], text[2001]) < 0.8
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    gone = set(text) - left
    print("recall", sum(i < 1000 for i in gone) / 300, sum(1000 <= i < 2000 for i in gone) / 100)
    assert sum(i < 1000 for i in gone) >= 0.97 * 300 and sum(1000 <= i < 2000 for i in gone) >= 99
    assert all(i % 2 for i in gone) and not any(i >= 2000 for i in gone)
