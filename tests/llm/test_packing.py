import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from boundgraph.llm import packing, tokens


def brute_bfd(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def test_room_tree_finds_the_tightest():
    rng = random.Random(1)
    tree, rooms = packing.RoomTree(37), []
    for _ in range(400):
        if rooms and rng.random() < 0.5:
            tree.add(rooms.pop(rng.randrange(len(rooms))), -1)
        else:
            rooms.append(rng.randint(0, 37))
            tree.add(rooms[-1], 1)
        need = rng.randint(0, 37)
        assert tree.tightest(need) == min((r for r in rooms if r >= need), default=None)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rooms = {}
    for length, first, n, bin_from, offset in packing.plan(counts, capacity).tolist():
        assert n > 0
        for i in range(n):
            rooms.setdefault(bin_from + i, []).append((offset, length))
    assert sum(map(len, rooms.values())) == len(lengths)
    used = []
    for placed in rooms.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
        used.append(capacity - end)
    assert sorted(used) == sorted(brute_bfd(lengths, capacity))


@pytest.mark.parametrize("spelled", [False, True])
def test_encoder_equals_tokenizers(spelled):
    own, plain = tokens.encoder(tokens.default_path(), spelled), Tokenizer.from_file(tokens.default_path())
    if spelled:
        plain.encode_special_tokens = True
    rng = random.Random(3)
    alpha = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "!", "...", "\xa0", "\x85", "’", "€", "\x1c", "中", "😀", "\x00", "A", "<|endoftext|>", "ª", "̂", "​"]
    for _ in range(2000):
        text = "".join(rng.choices(alpha, k=rng.randint(0, 12)))
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.ids(None).tolist() == []
    assert (own.ids("a<|endoftext|>b").tolist() == [64, 50256, 65]) != spelled


def test_documents_round_trip(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "a<|endoftext|>b", "é ü 中", "word " * 9000] + [" ".join(rng.choices(["of", "thing", "x1", "É"], k=rng.randint(0, 900))) for _ in range(40)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, "", 0), (None, "no id", 0)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), capacity=512).collect()
    plain = Tokenizer.from_file(tokens.default_path())  # untouched, as the query's contract names it
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
    assert len(by_seq) == len(brute_bfd([r["length"] for r in got], 512))
    for i, text in enumerate(texts[2:], 2):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted((r for r in got if r["id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 512 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["id"] is None for r in got) == 1 and sum(r["id"] == 0 for r in got) == 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
