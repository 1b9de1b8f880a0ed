"""Personal data: exact patterns, and a character BiLSTM-CRF that adds what they miss.

Base spans follow four fixed patterns, leftmost and without overlap per kind.  The
tagger is trained in numpy on the driver from labelled spans: those that the patterns
find in a bounded sample of the documents, the same contexts with the span written
in another way (no ``+``, dots between digits, ``(at)`` ...), and look-alikes that are
nobody's data.  It reads windows of ``WINDOW`` characters around digits, at-signs and what
may be an address with a spelled at-sign; a span without any of these would be refused as none
of the kinds.  Neighbouring windows overlap by half and every character takes its tag from
the window that it stands in most centrally.  Of a possible address with a spelled at-sign
all is taken if half of it is marked.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release
from .tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
#: Documents (drawn by hash of their id) and spans of each that training takes at most.
SAMPLE_DOCS, SAMPLE_SPANS = 6000, 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
#: At-signs beyond ASCII, which are read as @; the rest of an address from a spelled at-sign on, and its first part's characters.
_ATS = {0xFF20: "@", 0xFE6B: "@"}
_SPELLED = re.compile(r"(?=( ?(?:[\uFF20\uFE6B]|[(\[{] ?at ?[)\]}]| at ) ?[\w-]++(?:(?:\.| \. | ?[(\[{] ?dot ?[)\]}] ?| dot )[\w-]++)+))")
_USER = re.compile(r"[\w.%+-]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by the patterns, kinds as in ``KINDS``, then by start.

    Every pattern is searched in linear time: an e-mail's local part is the run before
    an at-sign, and runs of digits are never tried again from within.
    """
    out: list[tuple[str, int, int]] = []
    if not text or not _TRIGGER.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _DIGITS.findall(m[0])) <= 19 and _luhn("".join(d))]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def windows(text: str, everywhere: bool = False) -> np.ndarray:
    """Starts of the windows to read; a multiple of half a window each, so that they overlap by half.

    With ``everywhere`` they cover the whole text, not only where something stands that a span needs.
    """
    half = WINDOW // 2
    if everywhere:
        return np.arange(-1, len(text) // half + 1) * half
    at = np.flatnonzero(_is_trigger(text))
    if not len(at):
        return at
    lo, hi = np.maximum(at - 24, 0) // half - 1, (at + 24) // half
    found = np.unique(np.concatenate([lo + i for i in range(int((hi - lo).max()) + 1)]))
    return found * half


def spelled(text: str) -> list[tuple[int, int]]:
    """Where an address with a spelled at-sign may stand, from its first part on; that has ``WINDOW`` characters at most."""
    out = []
    for m in _SPELLED.finditer(text):
        start, least = m.start(), max(0, m.start() - WINDOW)
        while start > least and _USER.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((start, m.end(1)))
    return out


def _is_trigger(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = (codes - 48 < 10) | (codes == 64)
    for start, end in spelled(text):
        found[start:end] = True
    return found


def _cut(ids: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.int64)
    part = ids[max(start, 0) : start + WINDOW]
    out[max(-start, 0) : max(-start, 0) + len(part)] = part
    return out


def _valid(kind: str, text: str) -> bool:
    """Whether what the tagger marked can be read as this kind at all."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:[@\uFF20\uFE6B]|[(\[{] ?at ?[)\]}]| at ) ?[\w-]+(?:(?:\.| \. | ?[(\[{] ?dot ?[)\]}] ?| dot )[\w-]+)+", text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(_small, parts)) and not re.search("[A-Za-z]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits) and not re.search("[A-Za-z]", text)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ()./+-]", text)


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger, everywhere: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger that no base span overlaps, for every text."""
    places = [(i, int(s)) for i, text in enumerate(texts) for s in windows(text, everywhere)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not places:
        return out
    coded = {i: symbols(texts[i].translate(_ATS)) for i in {i for i, _ in places}}
    tags = np.concatenate([tagger.decode(np.stack([_cut(coded[i], s) for i, s in places[at : at + 512]])) for at in range(0, len(places), 512)])
    quarter, whole = WINDOW // 4, {}
    for (i, start), own in zip(places, tags, strict=True):
        whole.setdefault(i, {})[start] = own
    for i, found in whole.items():
        text, marks = texts[i], {}
        for start, own in found.items():
            lo = 0 if start - WINDOW // 2 not in found else quarter
            hi = WINDOW if start + WINDOW // 2 not in found else WINDOW - quarter
            for k in np.flatnonzero(own[lo:hi]) + lo:
                if 0 <= start + k < len(text):
                    marks[start + int(k)] = int(own[k])
        taken = [(s, e) for _, s, e in base[i]]
        whole_ones = [("email", s, e) for s, e in spelled(text) if 2 * sum(marks.get(k) in (1, 2) for k in range(s, e)) >= e - s]
        for kind, s, e in [*whole_ones, *_runs(marks)]:
            while s < e and text[s] in " .,;:-\n\t":
                s += 1
            while e > s and text[e - 1] in " .,;:-\n\t":
                e -= 1
            if e > s and all(e <= a or b <= s for a, b in taken) and _valid(kind, text[s:e]):
                taken.append((s, e))
                out[i].append((kind, s, e))
    return out


def _runs(marks: dict[int, int]) -> list[tuple[str, int, int]]:
    """Spans from tags: ``2 k + 1`` begins the kind ``k``, ``2 k + 2`` goes on with it."""
    out: list[list] = []
    for at in sorted(marks):
        kind = (marks[at] - 1) // 2
        if marks[at] % 2 or not out or out[-1][2] != at or out[-1][0] != kind:
            out.append([kind, at, at + 1])
        else:
            out[-1][2] = at + 1
    return [(KINDS[k], s, e) for k, s, e in out]


def _card(rng: random.Random) -> str:
    digits = "".join(rng.choices("0123456789", k=15))
    return next(d for x in "0123456789" if _luhn(d := digits + x))


def _name(rng: random.Random) -> str:
    """A short made-up word."""
    return "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "y"]) for _ in range(rng.randint(1, 3)))


def _user(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return "".join(rng.choices("abcdefghijklmnop.0123456789_", k=rng.randint(3, 10))).strip(".") or "me"
    return _name(rng) + rng.choice(["", "", f".{_name(rng)}", f"_{_name(rng)}", f"-{_name(rng)}"])


def _host(rng: random.Random) -> str:
    label = lambda: rng.choice([_name(rng), _name(rng), "example", "site", "web", "mail", f"mail{rng.randint(0, 9)}"])
    return ".".join([*(label() for _ in range(rng.randint(1, 2))), rng.choice(["com", "org", "net", "de", "io", "edu"])])


def _written(kind: str, span: str | None, rng: random.Random) -> str:
    """A span of a kind, drawn anew or ``span`` itself written in another way."""
    if kind == "email":
        user, host = span.split("@", 1) if span else (_user(rng), _host(rng))
        spelled = host.replace(".", rng.choice([" dot ", " [dot] ", "(dot)"]))
        return rng.choice([f"{user}@{host}"] * 2 + [f"{user} @ {host}", f"{user}(at){host}", f"{user} [at] {host}"] + [f"{user} at {host.replace('.', ' dot ')}"] * 2 + [f"{user} (at) {spelled}", f"{user} [at] {spelled}"])
    if kind == "ip":
        parts = span.split(".") if span else [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([".".join(parts)] * 4 + [" . ".join(parts), "[.]".join(parts)])
    if kind == "card":
        d = "".join(_DIGITS.findall(span)) if span else _card(rng)
        return rng.choice(["{0}", "{0}", "{1} {2} {3} {4}", "{1}-{2}-{3}-{4}", "{1}.{2}.{3}.{4}", "{1}/{2}/{3}/{4}"]).format(d, d[:4], d[4:8], d[8:12], d[12:])
    d = "".join(_DIGITS.findall(span))[-10:] if span else "".join(rng.choices("0123456789", k=10))
    return rng.choice(["+1 ({0}) {1}-{2}", "+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "001 {0} {1} {2}", "+49 {0} {1}{2}", "1-{0}-{1}-{2}"]).format(d[:3], d[3:6], d[6:])


def _like(rng: random.Random) -> str:
    """Something with digits, an at-sign or the word at that is nobody's data."""
    if rng.random() < 0.25:
        end = rng.choice([". ", ".\n", ", ", " "])
        return f"{_name(rng)} {rng.choice(['at', 'at', 'at the', 'looked at'])} {_name(rng)}{end}{rng.choice([_name(rng), _name(rng).capitalize()])} {_name(rng)}"
    hexa = "".join(rng.choices("0123456789abcdef", k=rng.randint(12, 40)))
    return rng.choice([f"password={hexa}", f'token = "{hexa}"', "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16)), f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1900, 2030)}", f"{rng.randint(0, 999)},{rng.randint(0, 999):03}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", f"@{''.join(rng.choices('abcdef', k=5))}", f"CC BY-NC {rng.randint(1, 4)}.0", f"{rng.randint(0, 99)}%", hexa, f"{rng.randint(0, 10**8)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"])


def training_set(contexts: list[tuple[str, str, str, str]], size: int = 6000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled spans ``(kind, before, span, after)``; without any, from drawn ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rng.randint(1, 9))) for _ in range(400)]
    ids, tags = [], []
    for n in range(size):
        if contexts and n % 4:
            kind, before, span, after = rng.choice(contexts)
        else:
            kind, span = rng.choice(KINDS), None
            before, after = " ".join(rng.choices(words, k=14)) + " ", rng.choice([" ", ", ", ". ", ".\n"]) + " ".join(rng.choices(words, k=14))
        like = rng.random() < 0.35
        text = _like(rng) if like else _written(kind, span, rng)
        whole, at = before + text + after, len(before)
        start = at - rng.randint(2, WINDOW - min(len(text), WINDOW - 4) - 2)
        tag = np.zeros(len(whole) + 2 * WINDOW, dtype=np.int64)
        if not like:
            tag[WINDOW + at : WINDOW + at + len(text)] = 2 * KINDS.index(kind) + 2
            tag[WINDOW + at] -= 1
        ids.append(_cut(symbols(whole), start))
        tags.append(tag[WINDOW + start : 2 * WINDOW + start])
    return np.stack(ids), np.stack(tags)


def labelled_spans(docs: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, str, str, str]]:
    """Base spans with their surroundings from at most ``sample_docs`` documents, drawn by hash of the id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t[max(0, s - WINDOW) : s], t[s:e], t[e : e + WINDOW]) for t in batch["text"] if t for k, s, e in base_spans(t)[:SAMPLE_SPANS] if e - s < WINDOW]
            yield pd.DataFrame(rows, columns=["kind", "before", "span", "after"], dtype="object")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    drawn = rows.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    found = rows.join(F.broadcast(drawn.distinct()), "id", "left_semi").mapInPandas(run, "kind string, before string, span string, after string")
    return sorted(tuple(r) for r in found.orderBy(F.xxhash64("kind", "before", "span", "after")).limit(4 * sample_docs).collect())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 240) -> Tagger:
    """A tagger for these documents; the same documents give the same one."""
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(*training_set(labelled_spans(docs, id_col, text_col)), steps=steps)
    release()
    return tagger


def spans_of(texts: list[str | None], tagger: Tagger | None) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and added spans of every text; null texts are empty."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return base, added_spans(whole, base, tagger) if tagger else [[] for _ in whole]


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)`` for every row: arrays of ``(kind, start, end)`` in code points, end exclusive.

    ``spans`` has the base spans and those that the tagger adds, by kind as in ``KINDS``, then start.
    Null and empty texts have none; null ids and repeated rows are kept; extra columns are ignored.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def listed(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in sorted(x, key=lambda y: (KINDS.index(y[0]), y[1]))] for x in rows], pa.list_(one))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                base, added = spans_of(part.column(1).to_pylist(), tagger)
                yield pa.RecordBatch.from_arrays([part.column(0), listed(base), listed([b + a for b, a in zip(base, added, strict=True)])], names=["id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, base {kind}, spans {kind}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` masked; all other columns and null texts stay as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column(place).to_pylist()
                base, added = spans_of(texts, tagger)
                new = [masked(t, b + a) if b or a else t for t, b, a in zip(texts, base, added, strict=True)]
                yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
