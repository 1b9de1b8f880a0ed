import random

import numpy as np
import pytest

from boundgraph.llm import token_files, tokens


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 22])
def test_scan_of_any_blocks(spark, tmp_path, block_bytes):
    rng = random.Random(block_bytes)
    want = []
    for name in ("a", "b", "c", "d", "e"):
        ids = [rng.choice([7, 1, 2, 3, 65535]) for _ in range(0 if name == "d" else rng.randint(1, 300 if block_bytes > 2 else 60))]
        if name == "e":
            ids = [1] * 50
        np.array(ids, dtype="<u2").tofile(tmp_path / name)
        lengths, n = [], 0
        for i in ids:
            if i == 7:
                lengths.append(n)
                n = 0
            else:
                n += 1
        if n:
            lengths.append(n)
        want += [(f"file://{tmp_path}/{name}", k, x) for k, x in enumerate(lengths)]
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in "abcde"], "file string")
    assert sorted(tuple(r) for r in token_files.scan(files, eod=7, block_bytes=block_bytes).collect()) == want


def test_counts_are_the_tokenizers(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Bée", "x1", "<|endoftext|>", "\n"], k=rng.randint(0, 200))), "f") for i in range(60)]
    rows += [(60, None, "f"), (61, "", "f"), (61, "twice", "f"), (None, "none", "f"), (62, "long " * 30000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    own = tokens.encoder(tokens.default_path(), spelled=True)
    got = sorted(((r["id"], r["n_tokens"]) for r in token_files.count(docs, block_bytes=1000).collect()), key=str)
    assert got == sorted(((i, len(own.ids(t))) for i, t, _ in rows), key=str)
    assert token_files.count(docs.limit(0)).count() == 0
