import hashlib
import random
import re
import time

import numpy as np

from boundgraph.llm import pii, queries
from boundgraph.llm.tagger import SYMBOLS, Tagger

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    alpha = ["1", "22", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "é", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "\n", "0", "٣", "+1 (565) 555-5579"]
    for _ in range(30000):
        text = "".join(rng.choices(alpha, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_very_long_runs_take_linear_time():
    began = time.time()
    for text in ("1" * 300000, "a" * 300000, "1." * 150000, "+1" * 150000, "a@" * 150000, "1 " * 150000, "+1((" * 80000, "a.b" * 100000 + "@"):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_gradient():
    rng = np.random.default_rng(0)
    tagger = Tagger(5, 4, 3, dtype=np.float64)
    ids, gold = rng.integers(0, SYMBOLS, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grad = tagger.loss(ids, gold)
    for k, v in tagger.w.items():
        at = tuple(rng.integers(0, s) for s in v.shape) if k != "e" else (ids[1, 2], 1)
        was = v[at]
        v[at] = was + 1e-5
        up = tagger.loss(ids, gold)[0]
        v[at] = was - 1e-5
        down = tagger.loss(ids, gold)[0]
        v[at] = was
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6, k


def test_tagger_on_held_out_spans_and_long_texts():
    ids, tags = pii.training_set([], size=4000)
    tagger = Tagger(2 * len(pii.KINDS) + 1)
    tagger.fit(ids[:3400], tags[:3400], steps=240)
    assert (tagger.decode(ids[3400:]) == tags[3400:]).all(axis=1).mean() > 0.85
    filler = "lorem ipsum dolor sit amet " * 4000
    text = f"{filler}call (415) 555-2671 now {filler} year 1999 {filler}"
    base, added = pii.spans_of([text, None, ""], tagger)
    assert base == [[], [], []] and added[1] == added[2] == []
    assert [(k, text[s:e]) for k, s, e in added[0]] == [("phone", "(415) 555-2671")]


def test_query_and_edge_rows(spark, tmp_path):
    rows = [(1, "mail a.b@c.de, 1.2.3.4 and é +1 (565) 555-5579", 5), (2, None, 6), (2, "", 7), (None, "x@y.zz", 8), (3, "4111 1111 1111 1111", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, id int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in queries.op9_pii_tagger(spark, str(tmp_path)).collect()}
    want = set()
    for i, text, _ in rows:
        spans = brute(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.add((i, *(sum(k == kind for k, _, _ in spans) for kind in pii.KINDS), hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert got == want


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd or 1.2.3.4!", "s"), (2, None, "s"), (3, "none", None)], "doc_id long, text string, source string")
    tagger = Tagger(9)
    tagger.w["c"][0] = 50
    assert [tuple(r) for r in pii.redact(docs, tagger).orderBy("doc_id").collect()] == [(1, "to [EMAIL] or [IP]!", "s"), (2, None, "s"), (3, "none", None)]
    assert pii.redact(docs.limit(0), tagger).count() == 0
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_spelled_addresses_without_digits():
    tagger = Tagger(2 * len(pii.KINDS) + 1)
    tagger.fit(*pii.training_set([]), steps=240)
    filler = "lorem ipsum dolor sit amet " * 9
    spelled = ["jane.doe [at] mail.example.org", "jane.doe(at)mail.example.org", "kim_lee at site dot example dot com", "jane (at) example dot org", "jane.doe\uff20mail.example.org"]
    _, added = pii.spans_of([f"{filler}write to {x} for more {filler}" for x in spelled], tagger)
    hits = [x for x, own in zip(spelled, added, strict=True) if [(k, f"{filler}write to {x} for more {filler}"[s:e]) for k, s, e in own] == [("email", x)]]
    print("found", hits)
    assert hits == spelled
    plain = ["we met at noon. Then we left the house", "she works at home. The dog is old", f"look at this. It is fine {filler}", "he stayed at school.\nThen he went"]
    assert pii.spans_of(plain, tagger)[1] == [[], [], [], []]


def test_whole_texts_show_nothing_that_windows_leave_out():
    """A span needs a digit, an at-sign or a spelled one, so windows around these find what a reading of every character finds."""
    tagger = Tagger(2 * len(pii.KINDS) + 1)
    tagger.fit(*pii.training_set([]), steps=240)
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    filler = lambda: " ".join(rng.choices(words, k=rng.randint(20, 60)))
    texts = [" ".join([filler(), *(x for _ in range(3) for x in (pii._written(rng.choice(pii.KINDS), None, rng), filler()))]) for _ in range(60)] + [filler() for _ in range(60)]
    base = [pii.base_spans(t) for t in texts]
    some, every = pii.added_spans(texts, base, tagger), pii.added_spans(texts, base, tagger, everywhere=True)
    assert sum(map(len, some)) > 20 and sum(sorted(a) != sorted(b) for a, b in zip(some, every, strict=True)) <= 2


def test_windows_cover_all_that_may_be_an_address():
    rng = random.Random(12)
    bits = ["a", "jane.doe", "x-y", " at ", "[at]", "( at )", "{at", " dot ", "[dot]", ".", " ", "at", "é", ", ", "w" * 40]
    for _ in range(20000):
        text = "".join(rng.choices(bits, k=rng.randint(3, 9)))
        found = set(pii.windows(text).tolist())
        for m in re.finditer(r"(?<![\w.%+-])[\w.%+-]{1,40} ?(?:[(\[{] ?at ?[)\]}]| at ) ?[\w-]+(?:(?:\.| \. | ?[(\[{] ?dot ?[)\]}] ?| dot )[\w-]+)+", text):
            assert pii._valid("email", m[0])
            assert all(k // 32 * 32 in found and k // 32 * 32 - 32 in found for k in range(*m.span())), repr(text)
