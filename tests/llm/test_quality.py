import math
import random
import zlib

import numpy as np
import pytest

from boundgraph.llm import quality


def make(rng, good, meta_tells):
    words = [f"w{i}" for i in range(200)]
    text = rng.choices(words, k=rng.randint(20, 80))
    if not good:
        text[rng.randrange(len(text))] = rng.choice(["awful,", "Dreadful"])
    source = ("fine" if good else "spam") if meta_tells and rng.random() < 0.9 else "any"
    return " ".join(text), source


def corpus(n, seed, meta_tells=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text, source = make(rng, good, meta_tells)
        rows.append((i, text, "en", source, len(text), good))
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long, good boolean"


def frames(spark, rows, labelled):
    docs = spark.createDataFrame(rows, DOCS)
    return docs, docs.where(f"doc_id < {labelled}").select(docs["doc_id"].alias("id"), docs["good"].cast("int").alias("good"))


@pytest.mark.parametrize("meta_tells", [True, False])
def test_held_out_accuracy(spark, meta_tells):
    rows = corpus(1200, 1, meta_tells)
    docs, labels = frames(spark, rows, 500)
    model = quality.train(docs, labels)
    got = {r["id"]: r for r in quality.score(docs, model).collect()}
    right = [got[r[0]]["keep"] == r[5] for r in rows[500:]]
    assert np.mean(right) > 0.97
    assert sorted(r["doc_id"] for r in quality.kept(docs, model).collect()) == sorted(i for i, r in got.items() if r["keep"])
    assert quality.kept(docs, model).columns == docs.columns
    again = {r["id"]: r["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(5), labels)).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in got)


def test_views_teach_each_other():
    """Few labels show the metadata's meaning; the text view learns the word from what the metadata view is sure of."""
    rng = random.Random(3)

    def features(rows):
        found = [quality.text_features(r[1]) for r in rows]
        text = quality._sparse([np.unique([quality.word_hash(w) for w in ws]) for ws, _ in found], np.zeros((len(rows), quality.SHAPES)))
        return text, quality._sparse([np.unique(quality.meta_features(r[2], r[3], 0)) for r in rows], np.zeros((len(rows), 1)))

    def rows(n, word):
        out = []
        for _ in range(n):
            good = rng.random() < 0.5
            out.append((0, "plain " + ("" if good or rng.random() > word else "zzbad "), "en", "fine" if good else "spam", 0, good))
        return out

    first, pool, new = rows(300, 0.03), rows(2000, 1.0), rows(400, 1.0)
    y = np.array([r[5] for r in first], dtype=float)
    want = np.array([r[5] for r in new])
    x = features(new)[0]
    alone = quality.co_train(*features(first), y, *features(pool), rounds=0)
    together = quality.co_train(*features(first), y, *features(pool))
    assert ((together.text.raw(x) > 0) == want).mean() > 0.95 > ((alone.text.raw(x) > 0) == want).mean()


def test_edge_rows(spark):
    rows = [(1, None, None, None, None, True), (None, "", "en", "s", -5, None), (2, "x " * 50000, "en", "s", 1, False), (2, "x", "en", "s", 1, True)]
    docs, labels = frames(spark, rows, 0)
    for known in (labels, docs.selectExpr("doc_id id", "cast(good as int) good")):
        got = quality.score(docs, quality.train(docs, known)).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    model = quality.train(docs, labels)
    assert all(r["keep"] for r in quality.score(docs, model).collect()) and quality.kept(docs, model).count() == 4
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    assert quality.score(docs.select("doc_id", "text"), model).count() == 4


def plainly(model, text, lang, source, n_chars):
    """The score of one document, feature by feature."""
    words, shape = quality.text_features(text)
    raw = sum(model.text.w[zlib.crc32(w.encode()) % 2**quality.TEXT_BITS] for w in words) + sum((x - m) / d * v for x, m, d, v in zip(shape, model.text.mean, model.text.deviation, model.text.d, strict=True)) + model.text.b
    size = int(2 * math.log2(1 + max(n_chars or 0, 0)))
    named = {zlib.crc32(x.encode()) % 2**quality.META_BITS for x in (f"l:{lang}", f"s:{source}", f"ls:{lang}:{source}", f"n:{size}", f"n3:{size // 3}")}
    other = sum(model.meta.w[i] for i in named) + (0 - model.meta.mean[0]) / model.meta.deviation[0] * model.meta.d[0] + model.meta.b
    logits = [model.text.slope * raw + model.text.shift, model.meta.slope * other + model.meta.shift]
    return 1 / (1 + math.exp(-(logits[0] * model.weights[0] + logits[1] * model.weights[1] + model.bias)))


def test_scores_are_those_of_a_plain_sum_and_the_pool_is_unlabelled(spark, monkeypatch):
    rows = corpus(500, 6)
    rows += [(900, None, None, None, None, True), (901, "", "en", "any", 0, True), (902, "w1 " * 30000, "en", "any", 90000, True)]
    docs, labels = frames(spark, rows, 300)
    drawn, sample = [], quality._sample
    monkeypatch.setattr(quality, "_sample", lambda rows, ids: drawn.append({r["id"] for r in ids.select("id").collect()}) or sample(rows, ids))
    model = quality.train(docs, labels)
    assert drawn[0] == set(range(300)) and drawn[1] == {r[0] for r in rows} - set(range(300))
    got = {r["id"]: r for r in quality.score(docs, model).collect()}
    for i, text, lang, source, n_chars, _ in rows:
        assert abs(got[i]["score"] - plainly(model, text, lang, source, n_chars)) < 1e-6
        assert got[i]["keep"] == (got[i]["score"] >= 0.5)
