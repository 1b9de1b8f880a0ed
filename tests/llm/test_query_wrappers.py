"""The thin queries: names, types, hexadecimal digits and order, against plain Python over small tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from boundgraph.llm import queries, tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    docs = [(i, t, "en", rng.choice("ab"), len(t)) for i, t in enumerate(texts)] + [(70, None, None, None, None), (71, texts[0], "en", "a", 5), (72, f"lead {texts[1]} tail", "en", "b", 6)]
    nprng = np.random.default_rng(31)
    base = nprng.standard_normal((40, 16))
    near = base[:10] + nprng.standard_normal((10, 16)) * 0.01
    vectors = [(i, [float(c) for c in np.float32(v)], i % 2 if i < 40 else (i - 40) % 2) for i, v in enumerate(np.concatenate([base, near]))] + [(60, None, 0), (61, [0.0] * 16, 0), (62, [1.0] * 16, None)]
    path = str(tmp_path_factory.mktemp("wrapped"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 != 0, 0) for i in range(40)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, docs, vectors


def test_scores_and_rates(spark, folder):
    path, docs, _ = folder
    one = queries.op1_co_training(spark, path)
    assert one.columns[0] == "doc_id" and one.count() == len(docs)
    two = queries.op2_soft_mixing(spark, path).collect()
    assert sorted(str(r["doc_id"]) for r in two) == sorted(str(d[0]) for d in docs) and all(r["rate"] >= 0 for r in two)
    assert {r["doc_id"]: r["n_tokens"] for r in two} == {d[0]: len((d[1] or "").split()) for d in docs}


def test_fingerprints(spark, folder):
    path, docs, _ = folder

    def digits(text):
        w = (text or "").split()
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return f"{sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)):016x}"

    got = {r["doc_id"]: r for r in queries.op4_simhash_pivots(spark, path).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {d[0]: digits(d[1]) for d in docs}
    assert got[71]["component_id"] == 0


def test_tokens_and_pieces(spark, folder):
    path, docs, _ = folder
    plain = Tokenizer.from_file(tokens.default_path())
    length = {d[0]: len(plain.encode(d[1] or "", add_special_tokens=False).ids) for d in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_separator_scan(spark, path).collect()} == length
    five = queries.op5_best_fit_packing(spark, path).collect()
    assert {r["doc_id"]: r["length"] for r in five} == {i: n + 1 for i, n in length.items()} and {r["start"] for r in five} == {0}


def test_vectors(spark, folder):
    path, _, vectors = folder
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in vectors if v and any(v) and label is not None}
    label = {i: x for i, _, x in vectors}
    linked = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98} for i in unit}
    got = {r["vec_id"]: r for r in queries.op6_pivot_permutations(spark, path).collect()}
    assert len(got) == len(vectors)
    for i in got:
        assert got[i]["n_links"] == len(linked.get(i, ())) and got[i]["component_id"] == min([i, *linked.get(i, ())]) and got[i]["kept"] == (got[i]["component_id"] == i)
    seven = queries.op7_one_bit_codes(spark, path)
    assert seven.columns == ["query_id", "rank", "vec_id", "score"]
    whole = {i: np.float32(v).astype(float) for i, v, _ in vectors if v and any(v)}
    rows = seven.collect()
    assert {r["query_id"] for r in rows} == {0, 20, 40} and all(abs(r["score"] - whole[r["query_id"]] @ whole[r["vec_id"]]) < 1e-9 and r["query_id"] != r["vec_id"] for r in rows)
    assert all(sum(r["query_id"] == q for r in rows) == 20 for q in (0, 20, 40))


def test_what_stays(spark, folder):
    path, docs, _ = folder
    got = {r["doc_id"]: r for r in queries.op10_longest_previous_factors(spark, path).collect()}
    text = {d[0]: (d[1] or "").encode() for d in docs}
    assert {i: r["n_bytes"] for i, r in got.items()} == {i: len(t) for i, t in text.items()}
    assert got[71]["n_removed"] == (len(text[0]) if len(text[0]) >= 100 else 0)
    assert got[1]["kept_sha256"] == hashlib.sha256(text[1]).hexdigest() and got[70]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
