"""Quality by co-training: a classifier of the text and one of the page metadata teach each other.

Both start from the same labelled rows.  In every round each view, calibrated on
held-out rows, labels those rows of an unlabelled pool that it is sure of, and the
*other* view learns from them.  In the end both calibrated views are combined by a
logistic model fitted on the held-out rows, and every document is scored.

Fitting takes bounded samples (``LABELLED`` and ``POOL`` documents, drawn by hash of
the id); scoring reads every document whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release

#: Labelled documents and documents of the unlabelled pool that fitting takes at most.
LABELLED, POOL = 12000, 4000
#: Hashed features of each view, by bits; rounds, and the calibrated probability that counts as sure.
TEXT_BITS, META_BITS, ROUNDS, SURE = 18, 10, 4, 0.97
#: A word counts as a feature if its chi-square against the labels is at least this.
CHI_SQUARE = 16.0
SHAPES = 9
#: Features that are counted in one step.
SLICE = 1 << 19
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b".,;:'\"!?()-"
_EDGE = ".,;:!?\"'()"
_PLAIN = _LOWER + _UPPER + _DIGIT + _SPACE + _MARKS + bytes(range(128, 256))


def text_features(text: str | None) -> tuple[set[str], list[float]]:
    """The different lower-case words of a whole text, and ``SHAPES`` numbers on its form."""
    raw = (text or "").encode()
    words = (text or "").lower().split()
    different = {w.strip(_EDGE) for w in set(words)}
    n, m = len(raw) + 1.0, len(words) + 1.0
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    odd = len(raw.translate(None, _PLAIN))
    upper, lines = without(_UPPER), raw.count(b"\n") + 1
    repeated = lines - len(set(raw.split(b"\n")))
    return different, [math.log1p(odd), odd / n, upper / n, without(_DIGIT) / n, without(_MARKS) / n, len(different) / m, n / m / 10, math.log1p(m) / 10, repeated / lines]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hashed metadata: language, source, both, and length on a log scale."""
    size = int(2 * math.log2(1 + max(n_chars or 0, 0)))
    return [zlib.crc32(x.encode()) & (1 << META_BITS) - 1 for x in (f"l:{lang}", f"s:{source}", f"ls:{lang}:{source}", f"n:{size}", f"n3:{size // 3}")]


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode()) & (1 << TEXT_BITS) - 1


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


def _sums(index: np.ndarray, n: int, weights: Callable[[slice], np.ndarray] | None = None) -> np.ndarray:
    """``np.bincount`` in slices, so that no copy of all features in another type is made."""
    out = np.zeros(n)
    for at in range(0, len(index), SLICE):
        part = slice(at, at + SLICE)
        out += np.bincount(index[part], weights=weights(part) if weights else None, minlength=n)
    return out


@dataclass
class Sparse:
    """Rows of binary features ``columns`` (with row numbers) and of dense ones."""

    rows: np.ndarray
    columns: np.ndarray
    dense: np.ndarray

    def take(self, which: np.ndarray) -> Sparse:
        place = np.full(len(self.dense), -1, dtype=np.int32)
        place[which] = np.arange(len(which), dtype=np.int32)
        kept = place[self.rows] >= 0
        return Sparse(place[self.rows[kept]], self.columns[kept], self.dense[which])

    def plus(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate([self.rows, other.rows + np.int32(len(self.dense))]), np.concatenate([self.columns, other.columns]), np.concatenate([self.dense, other.dense]))


class View:
    """A logistic model over one view's features, with its calibration."""

    def __init__(self, bits: int, dense: int):
        self.w, self.d, self.b = np.zeros(1 << bits), np.zeros(dense), 0.0
        self.mean, self.deviation = np.zeros(dense), np.ones(dense)
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: Sparse, y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 5e-5) -> View:
        n, width = len(y), len(self.w)
        seen = _sums(x.columns, width)
        good = _sums(x.columns, width, lambda part: y[x.rows[part]])
        share = y.mean()
        expected = seen * share
        chi = (good - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - seen / (n + 1e-9)) + 1e-9, 1e-9)
        used = (chi >= CHI_SQUARE) & (seen >= 3)
        kept = used[x.columns]
        rows, columns = x.rows[kept], x.columns[kept]
        self.mean, self.deviation = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
        dense = (x.dense - self.mean) / self.deviation
        self.w[:], self.d[:], self.b = 0, 0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        moments: dict[str, list] = {k: [0.0, 0.0] for k in "wdb"}
        for step in range(1, steps + 1):
            miss = _logistic(np.bincount(rows, weights=self.w[columns], minlength=n) + dense @ self.d + self.b) - y
            grads = {"w": np.bincount(columns, weights=miss[rows], minlength=width) / n + decay * self.w, "d": dense.T @ miss / n + decay * self.d, "b": miss.mean()}
            for k, g in grads.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
                setattr(self, k, getattr(self, k) - change)
        return self

    def raw(self, x: Sparse) -> np.ndarray:
        return _sums(x.rows, len(x.dense), lambda part: self.w[x.columns[part]]) + (x.dense - self.mean) / self.deviation @ self.d + self.b

    def calibrate(self, x: Sparse, y: np.ndarray) -> View:
        """Platt scaling on rows that the weights were not fitted on."""
        w, b = _platt(self.raw(x)[:, None], y)
        self.slope, self.shift = float(w[0]), float(b)
        return self

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return self.slope * raw + self.shift


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Nonnegative weights and a bias for ``z``, by Newton steps on smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _logistic(a @ w)
        grad = a.T @ (p - target) / len(y) + 1e-4 * w
        curve = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a / len(y) + 1e-4 * np.eye(len(w))
        move = np.linalg.solve(curve, grad)
        w = w - move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], w[-1]


@dataclass
class Model:
    """Both views and how they are combined; ``constant`` is set where labels gave nothing to fit."""

    text: View
    meta: View
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def combined(self, text_raw: np.ndarray, meta_raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views, and the score."""
        if self.constant is not None:
            same = np.full(len(text_raw), self.constant)
            return same, same, same
        a, b = self.text.logit(text_raw), self.meta.logit(meta_raw)
        return _logistic(a), _logistic(b), _logistic(np.stack([a, b], axis=1) @ self.weights + self.bias)


def co_train(text: Sparse, meta: Sparse, y: np.ndarray, pool_text: Sparse, pool_meta: Sparse, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Fit both views on three quarters of the labelled rows and what they teach each other; calibrate on the rest."""
    n = len(y)
    if n < 8 or y.min() == y.max():
        return Model(View(1, SHAPES), View(1, 1), np.zeros(2), 0.0, constant=float(y.mean()) if n else 1.0)
    held, own = np.arange(n) % 4 == 3, np.arange(n) % 4 != 3
    if y[own].min() == y[own].max() or y[held].min() == y[held].max():
        held = own = np.ones(n, dtype=bool)
    held, own = np.flatnonzero(held), np.flatnonzero(own)
    views = {"text": View(TEXT_BITS, SHAPES), "meta": View(META_BITS, 1)}
    data, pool = {"text": text, "meta": meta}, {"text": pool_text, "meta": pool_meta}
    taught: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, dtype=int), np.zeros(0)) for k in views}

    def fitted(k: str) -> View:
        rows, labels = taught[k]
        x = data[k].take(own)
        if len(rows):
            x = x.plus(pool[k].take(rows))
        return views[k].fit(x, np.concatenate([y[own], labels])).calibrate(data[k].take(held), y[held])

    for _ in range(rounds):
        said = {}
        for k in views:
            view = fitted(k)
            p = _logistic(view.logit(view.raw(pool[k]))) if len(pool[k].dense) else np.zeros(0)
            said[k] = (np.flatnonzero((p >= sure) | (p <= 1 - sure)), p)
        now = {k: (said[o][0], (said[o][1][said[o][0]] > 0.5).astype(float)) for k, o in (("text", "meta"), ("meta", "text"))}
        if all(np.array_equal(now[k][0], taught[k][0]) and np.array_equal(now[k][1], taught[k][1]) for k in views):
            break
        taught = now
    for k in views:
        fitted(k)
    logits = np.stack([views[k].logit(views[k].raw(data[k].take(held))) for k in ("text", "meta")], axis=1)
    weights, bias = _platt(logits, y[held])
    return Model(views["text"], views["meta"], weights, float(bias))


def _sparse(lists: list[np.ndarray], dense: np.ndarray) -> Sparse:
    sizes = [len(x) for x in lists]
    columns = np.concatenate([*lists, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    return Sparse(np.repeat(np.arange(len(lists), dtype=np.int32), sizes), columns, dense)


def _columns(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    kinds = {"id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(F.col(names.get(k, k)).cast(t).alias(k) if names.get(k, k) in docs.columns else F.lit(None).cast(t).alias(k) for k, t in kinds.items()))


def _sample(rows: DataFrame, ids: DataFrame) -> tuple[Sparse, Sparse, np.ndarray]:
    """Features of the rows whose ids a bounded table holds, by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                words, shape = text_features(r.text)
                meta = np.unique(meta_features(r.lang, r.source, None if pd.isna(r.n_chars) else int(r.n_chars)))
                out.append((r.id, r.good, np.unique([word_hash(w) for w in words]).astype("<i4").tobytes(), np.array(shape, dtype="<f8").tobytes(), meta.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "good", "words", "shape", "meta"])

    # Features come as packed bytes in Arrow batches: four bytes for each, on the driver too.
    found = rows.join(F.broadcast(ids), "id").mapInPandas(run, "id long, good double, words binary, shape binary, meta binary").toArrow().sort_by("id")
    packed = lambda name, kind: [np.frombuffer(x.as_buffer(), dtype=kind) for x in found.column(name)]
    shape = np.array(packed("shape", "<f8"), dtype=float).reshape(-1, SHAPES)
    return _sparse(packed("words", "<i4"), shape), _sparse(packed("meta", "<i4"), np.zeros((found.num_rows, 1))), found.column("good").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, names: dict[str, str] | None = None, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Co-train on ``labels(id, good)``, ``good`` 0 or 1, and on unlabelled documents.

    An id labelled twice is good only if all its labels say so; null ids and labels are left out.
    The pool holds no labelled document, so held-out rows are never learned from.
    """
    rows = _columns(docs, names or {"id": "doc_id"})
    known = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").cast("double").alias("good"))
    known = known.join(rows.select("id").where("id is not null").distinct(), "id", "left_semi")
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    others = rows.select("id").where("id is not null").distinct().join(known.select("id"), "id", "left_anti").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(pool).select("id", F.lit(0.0).alias("good"))
    text, meta, y = _sample(rows, drawn)
    pool_text, pool_meta, _ = _sample(rows, others)
    model = co_train(text, meta, y, pool_text, pool_meta)
    del text, meta, pool_text, pool_meta
    release()
    return model


class _Weights(dict):
    """Weights by word, looked up once per word."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = float(self.w[word_hash(word)])
        return out


class _Scorer:
    """A model at work in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.weight = _Weights(model.text.w).__getitem__

    def __call__(self, texts: list, langs: list, sources: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, meta = self.model.text, self.model.meta
        if self.model.constant is not None:
            return self.model.combined(np.zeros(len(texts)), np.zeros(len(texts)))
        found = [text_features(t) for t in texts]
        shapes = np.array([s for _, s in found]).reshape(-1, SHAPES)
        raw = np.array([sum(map(self.weight, w)) for w, _ in found], dtype=float) + (shapes - text.mean) / text.deviation @ text.d + text.b
        other = np.array([meta.w[np.unique(meta_features(*m))].sum() for m in zip(langs, sources, sizes, strict=True)], dtype=float)
        return self.model.combined(raw, other - meta.mean / meta.deviation @ meta.d + meta.b)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, names: dict[str, str] | None = None) -> DataFrame:
    """``(id, p_text, p_meta, score, keep)`` for every row; ``keep``: the score is at least ``threshold``.

    Null and empty texts and null metadata have features of their own; null ids and repeated
    rows are kept; metadata columns that are missing count as null; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p_text, p_meta, both = scorer(*(part.column(i).to_pylist() for i in range(1, 5)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p_text), pa.array(p_meta), pa.array(both), pa.array(both >= threshold)], names=["id", "p_text", "p_meta", "score", "keep"])
        del scorer
        release()

    return _columns(docs, names or {"id": "doc_id"}).mapInArrow(run, "id long, p_text double, p_meta double, score double, keep boolean")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5, names: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    names = names or {}
    place = [docs.columns.index(names.get(k, k)) if names.get(k, k) in docs.columns else None for k in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns = [part.column(i).to_pylist() if i is not None else [None] * part.num_rows for i in place]
                yield part.filter(pa.array(scorer(*columns)[2] >= threshold))
        del scorer
        release()

    return docs.mapInArrow(run, docs.schema)
