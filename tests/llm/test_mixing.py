import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boundgraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        lang = rng.choice(["en", "de", None]) if source != "a" else "fr"
        text = " ".join(rng.choices(["x", "yy", "zzz"], k=rng.randint(0, 60)))
        rows.append((i, text, lang, source, 0, "old"))
        if rng.random() < 0.4:
            labels.append((i, {"hot": "web", "a": "books", "b": "code", "c": "books", None: "web"}[source] if rng.random() < 0.9 else "code"))
    return rows, labels


def classify(rows, labels):
    """The same classifier in numpy, document by document: domains, and whole numbers in proportion to the posteriors."""
    named = dict(labels)
    domains = sorted(set(named.values()))
    hashed = lambda x, *more: xxhash.xxh64_intdigest(x, *more)
    words = [sorted({_signed(hashed(w.encode(), 42)) % mixing.BUCKETS for w in (r[1] or "").lower().split()}) for r in rows]
    meta = [(r[2], str(int(math.floor(math.log2(len(r[1] or "") + 1))))) for r in rows]
    own = {i: domains.index(named[r[0]]) for i, r in enumerate(rows) if r[0] in named}
    fold = {i: _signed(hashed(b"fold", hashed((rows[i][0]).to_bytes(8, "little", signed=True), 42))) % 4 for i in own}
    split = len(set(f > 0 for f in fold.values())) > 1
    train = [i for i in own if fold[i] > 0] if split else list(own)
    n_k = len(domains)
    total = np.bincount([own[i] for i in train], minlength=n_k)
    base = np.tile(np.log(total + 0.5), (len(rows), 1))
    for f in range(2):
        seen = {}
        for i in train:
            if meta[i][f] is not None:
                seen.setdefault(meta[i][f], np.zeros(n_k))[own[i]] += 1
        whole = sum(seen.values(), np.zeros(n_k)) + 0.5 * (len(seen) + 1)
        for i in range(len(rows)):
            if meta[i][f] in seen:
                base[i] += np.log((seen[meta[i][f]] + 0.5) / whole)
    count = np.zeros((mixing.BUCKETS, n_k))
    for i in train:
        count[words[i], own[i]] += 1
    told = np.log((count + 0.5) / (total + 1))
    told -= told.mean(axis=1, keepdims=True)
    of_all = count.sum(axis=1, keepdims=True)
    expected = of_all * total / total.sum()
    chi = ((count - expected) ** 2 / np.where(expected > 0, expected, 1)).sum(axis=1)
    tells = (of_all[:, 0] >= 5) & (chi > n_k - 1 + 5 * math.sqrt(2 * (n_k - 1)))
    known = [[b for b in w if tells[b]] for w in words]
    said = np.stack([told[w].sum(axis=0) / math.sqrt(max(1, len(w))) for w in known])

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    held = [i for i in own if fold[i] == 0]
    likely = lambda w: np.mean([np.log(softmax(base + w * said)[i, own[i]]) for i in held])
    factor = max(mixing.FACTORS, key=lambda w: (likely(w), -w)) if split and tells.any() else 0.0
    p = softmax(base + factor * said)
    whole = np.floor(p * max(mixing.GRAIN, 4 * n_k) + 0.5)
    for i, k in own.items():
        whole[i] = np.arange(n_k) == k
    return domains, whole


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(rows, labels, weights):
    """Classifier and descent in numpy, document by document, without cells."""
    domains, whole = classify(rows, labels)
    p = whole / whole.sum(axis=1, keepdims=True)
    tokens = np.array([len((r[1] or "").split()) for r in rows], dtype=float)
    w = tokens / tokens.sum()
    share = w @ p
    target = share**weights / (share**weights).sum() if isinstance(weights, float) else np.array([weights.get(d, 0) for d in domains]) / sum(weights.values())
    x = np.ones(len(rows))
    for _ in range(20000):  # plain steps, without momentum, to the end
        residual = ((w * x) @ p - target) / share
        new = np.maximum(0, x - (p @ residual + 1e-6 * (x - 1)) / (1 + 1e-6))
        if np.abs(new - x).max() < 1e-12:
            break
        x = new
    return domains, tokens, p, target, x


@pytest.mark.parametrize("weights", [0.5, {"web": 1.0, "books": 1.0, "code": 2.0}, {"web": 1.0, "books": 3.0}])
def test_matches_brute_force(spark, weights):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix(docs, spark.createDataFrame(labels, "id long, domain string"), weights).collect()}
    _, tokens, p, target, x = brute(rows, labels, weights)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i]["n_tokens"] == tokens[i]
        assert got[i]["rate"] >= 0
        assert got[i]["copies"] in (math.floor(got[i]["rate"]), math.floor(got[i]["rate"]) + 1)
    best = (tokens * x) @ p / tokens.sum()
    mine = np.array([got[i]["rate"] for i in range(len(rows))])
    reached = (tokens * mine) @ p / tokens.sum()
    error = lambda a: float((((a - target) ** 2) / np.maximum((tokens / tokens.sum()) @ p, 1e-12)).sum())
    assert np.abs(reached - best).max() < 3e-3 and error(reached) <= error(best) + 5e-5  # the true optimum; the descent ends after STEPS steps
    if isinstance(weights, float):
        assert np.abs(best - target).max() < 1e-3


def test_text_alone_tells_the_domain(spark):
    """Domains that only words tell: unlabelled documents get them, and the mix reaches the targets."""
    rng = random.Random(8)
    common, own = [f"c{i}" for i in range(200)], {d: [f"{d}{i}" for i in range(40)] for d in ("law", "code", "news")}
    rows, labels, truth = [], [], {}
    for i in range(900):
        d = rng.choice(["law", "law", "law", "law", "code", "news"])
        text = rng.choices(common, k=30) + rng.choices(own[d], k=6)
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", rng.choice("ab"), 0, "x"))
        truth[i] = d
        if i % 3 == 0:
            labels.append((i, d))
    docs, labelled = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "id long, domain string")
    seen, domains = mixing.membership(docs, labelled)
    best = {r["doc_id"]: domains[int(np.argmax(r["__p"]))] for r in seen.collect()}
    assert np.mean([best[i] == truth[i] for i in range(900) if i % 3]) > 0.97
    mixed = mixing.mix(docs, labelled, {"law": 1.0, "code": 1.0, "news": 1.0}).collect()
    total = Counter()
    for r in mixed:
        total[truth[r["doc_id"]]] += r["rate"] * r["n_tokens"]
    shares = {d: v / sum(total.values()) for d, v in total.items()}
    assert all(abs(v - 1 / 3) < 0.06 for v in shares.values()), shares


def test_words_that_tell_nothing_are_not_believed(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"c{k}" for k in range(300)], k=40)), "en", "s", 0, "x") for i in range(600)]
    labels = [(i, rng.choice(["a", "a", "a", "b"])) for i in range(0, 600, 2)]
    seen, domains = mixing.membership(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "id long, domain string"))
    share = [r["__p"][0] / sum(r["__p"]) for r in seen.where("doc_id % 2 = 1").collect()]
    assert 0.65 < np.mean(share) < 0.85 and np.std(share) < 0.15


def test_rounding_is_right_on_average_and_repeats(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 4 == 0, "s").otherwise("t").alias("source"), F.lit(3).alias("n_chars"))
    labels = docs.selectExpr("doc_id id", "source domain")
    mixed = mixing.mix(docs, labels, {"s": 1.0, "t": 1.0})
    mean = {r["source"]: (r["r"], r["c"]) for r in mixed.groupBy("source").agg(F.avg("rate").alias("r"), F.avg("copies").alias("c")).collect()}
    for rate, copies in mean.values():
        assert abs(rate - copies) < 0.03
    assert abs(mean["s"][0] - 2) < 0.01
    again = mixing.resample(docs, labels, {"s": 1.0, "t": 1.0})
    assert again.columns == docs.columns
    assert again.count() == mixed.agg(F.sum("copies")).first()[0]
    clashing = docs.selectExpr("*", "'r' rate", "'c' copies", "'n' n_tokens", "'p' p", "1 nth")
    again = mixing.resample(clashing, labels, {"s": 1.0, "t": 1.0})
    assert again.columns == clashing.columns and again.where("rate = 'r' and copies = 'c' and n_tokens = 'n' and p = 'p' and nth = 1").count() == again.count() > 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "r"), (1, "", "en", "s", 0, "r"), (None, "a b", "en", "s", 3, "r"), (2, "a " * 40000, "en", None, 3, "r")], SCHEMA)
    none = spark.createDataFrame([], "id long, domain string")
    assert [r["rate"] for r in mixing.mix(docs, none).collect()] == [1.0] * 4
    one = spark.createDataFrame([(1, "d"), (1, "c"), (None, "e"), (2, None)], "id long, domain string")
    got = mixing.mix(docs, one).collect()
    assert len(got) == 4 and sorted(r["n_tokens"] for r in got) == [0, 0, 2, 40000]
    assert mixing.mix(docs.limit(0), one).count() == 0
    empty = docs.where("doc_id = 1")
    assert [r["rate"] for r in mixing.mix(empty, one).collect()] == [1.0, 1.0]
