"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.  That is to say: position
``i`` has a longest previous factor of at least ``length`` -- the longer of what it
shares with the previous and with the next smaller position in suffix order.

Suffixes that share ``length`` bytes have to meet in one task, without moving every
suffix there.  Every window of ``length`` bytes is therefore assigned the places of its
least 32-byte grams (in an order by hash); equal windows have equal such grams at equal
places, so only suffixes around occurrences of the same gram, its *anchors*, can match.

1. Anchors are dealt by gram.  Those alone with their gram are done; of anchors whose
   whole surroundings are equal, all but the first are covered and the first stands for all.
2. The surroundings of what is left are fetched and dealt by gram again.  For every
   distance to the left of the gram the suffixes are brought in suffix order, and
   previous and next smaller positions show what has an earlier match.
   Grams that a bounded sample shows in a large share of the documents, and those of more than
   ``CROWD`` anchors that are left, are dealt by whole windows instead, so that no task gets the
   surroundings of all occurrences of a common line; equal windows are neighbours in suffix order, and
   the first of them is the previous smaller position of all others.
3. What is covered goes back to the documents.

Nothing is approximate but hashes of 64 bits standing for grams and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

GRAM = 32
#: Documents of the sample that finds common grams, the share of documents that makes one common, and how many there are at most.
SAMPLE_DOCS, COMMON_SHARE, MOST_COMMON = 4000, 0.01, 16384
#: Anchors with one gram and different surroundings that meet in suffix order; more are dealt by windows.
CROWD = 20_000
#: Bytes of text for each bucket that anchors are dealt to, and the fewest buckets.
BUCKET_BYTES, FEWEST = 1_500_000, 16
#: Anchors that a task collects before it sends them off.
SEND = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every position."""
    n = len(b) - 7
    word = b[:n].astype(np.uint64)
    for k in range(1, 8):
        word |= b[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    m = len(b) - GRAM + 1
    h = word[:m] * np.uint64(0x9E3779B97F4A7C15)
    for at, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(31)
        h += word[at : at + m] * np.uint64(factor)
    return _mixed(h)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(h: np.ndarray, length: int, common: np.ndarray) -> np.ndarray:
    """Positions of the grams that are least in some window; common grams come after all others."""
    w = length - GRAM + 1
    order = h >> np.uint64(1)
    if len(common):
        order = np.where(_among(h, common), order | np.uint64(1 << 63), order)
    least = _sliding(order, w, np.minimum)
    edge = np.zeros(w - 1, dtype=np.uint64)
    return np.flatnonzero(order == _sliding(np.concatenate([edge, least, edge]), w, np.maximum))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def surroundings(h: np.ndarray, at: np.ndarray, n: int, side: int) -> np.ndarray:
    """A hash of the bytes within ``side`` of each anchor's gram, as far as the text goes."""
    left, right = np.minimum(at, side), np.minimum(n - GRAM - at, side)
    out = _mixed(left.astype(np.uint64) * np.uint64(1000003) + right.astype(np.uint64))
    for step in [*range(-side, side, GRAM), side]:
        part = h[np.clip(at + step, at - left, at + right)]
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def previous_smaller(pos: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each place of an order, the nearest earlier place of the same run with a smaller ``pos``, or -1.

    By least values over 1, 2, 4 .. places: each place skips the longest stretches before it that hold nothing smaller.
    """
    n = len(pos)
    first = np.ones(n, dtype=bool)
    first[1:] = run[1:] != run[:-1]
    number = np.cumsum(first)
    value = number * (int(pos.max(initial=0)) + 1) + pos  # whatever stands in an earlier run is smaller
    longest = int(np.bincount(number).max(initial=1))
    least = [value]  # least[k][i]: over the places i, i - 1, .. of 2 ** k
    while 2 ** len(least) <= longest:
        step = 2 ** (len(least) - 1)
        least.append(np.concatenate([np.full(step, -1), np.minimum(least[-1][step:], least[-1][:-step])]) if step < n else np.full(n, -1))
    found = np.arange(n) - 1
    for k in range(len(least) - 1, -1, -1):
        clear = found >= 0
        clear[clear] = least[k][found[clear]] >= value[clear]
        found = np.where(clear, found - 2**k, found)
    return np.where((found >= 0) & (number[found] == number), found, -1)


def earlier_matches(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance to the left at which a suffix of row ``i`` has an earlier match, or (1, 0).

    Rows of a group have the same gram, ``left`` (nearest byte first) and ``right`` what stands beside it,
    ``n_left`` and ``n_right`` bytes long, both of the same width ``side``; ``pos`` ranks the rows by where
    they start.  A match has ``side`` bytes beside the gram.
    """
    side = left.shape[1]
    n = len(group)
    lo, hi = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return lo, hi
    wide = -(-side // 8) * 8
    words = np.zeros((n, wide), dtype=np.uint8)
    words[:, :side] = right
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort((n_right, *keys.T[::-1], group))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    # What suffixes that begin with the gram share with the one before them in suffix order.
    same = right[order[1:]] == right[order[:-1]]
    shared = np.where(same.all(axis=1), side, same.argmin(axis=1))
    shared = np.concatenate([[-1], np.where(group[order[1:]] == group[order[:-1]], shared, -1)])
    before = np.unique(group, return_inverse=True)[1].astype(np.int64)
    live = np.arange(n)
    for distance in range(side + 1):
        if distance:  # suffixes that begin one byte further left: by that byte, then as before
            live = live[n_left[live] >= distance]
            key = before[live] * 256 + left[live, distance - 1]
            _, named, times = np.unique(key, return_inverse=True, return_counts=True)
            live, named = live[times[named] > 1], named[times[named] > 1]
            before = np.zeros(n, dtype=np.int64)
            before[live] = named
        if not len(live):
            break
        rest = side - distance
        fit = live[n_right[live] >= rest]
        alike = np.cumsum(shared < rest)
        suffix = fit[np.argsort(before[fit] * (n + 1) + rank[fit], kind="stable")]
        if len(suffix) < 2:
            continue
        apart = np.ones(len(suffix), dtype=bool)
        apart[1:] = (before[suffix[1:]] != before[suffix[:-1]]) | (alike[rank[suffix[1:]]] != alike[rank[suffix[:-1]]])
        run = np.cumsum(apart)
        times = np.bincount(run)[run]
        suffix, run = suffix[times > 1], run[times > 1]
        if not len(suffix):
            continue
        p = pos[suffix]
        has = (previous_smaller(p, run) >= 0) | (previous_smaller(p[::-1], run[::-1]) >= 0)[::-1]
        hit = suffix[has]
        lo[hit] = np.where(hi[hit] >= lo[hit], np.minimum(lo[hit], distance), distance)
        hi[hit] = distance
    return lo, hi


_ANCHOR = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("twin", "<i4"), ("pos", "<i4")])
_PLACE = np.dtype([("doc", "<i8"), ("twin", "<i4"), ("from", "<i4"), ("to", "<i4")])
_WINDOW = np.dtype([("w", "<u8"), ("doc", "<i8"), ("twin", "<i4"), ("pos", "<i4")])
_FOUND = "doc long, twin int, code long, ask boolean"


def _packed(x: np.ndarray) -> bytes:
    """Columns of a record array one after the other: they compress better than rows."""
    return b"".join(np.ascontiguousarray(x[n]).tobytes() for n in x.dtype.names)


def _unpacked(blobs: list, kind: np.dtype) -> np.ndarray:
    sizes = [len(b) // kind.itemsize for b in blobs]
    out, at = np.empty(sum(sizes), dtype=kind), 0
    for blob, n in zip(blobs, sizes, strict=True):
        place = 0
        for name in kind.names:
            own = kind[name]
            out[name][at : at + n] = np.frombuffer(blob, dtype=own.base, count=n * own.itemsize // own.base.itemsize, offset=place).reshape(n, *own.shape) if n else out[name][at : at + n]
            place += n * own.itemsize
        at += n
    return out


def _dealt(bucket: np.ndarray, x: np.ndarray, buckets: int) -> dict[int, bytes]:
    """Record arrays by bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return {k: _packed(x[order[ends[k] : ends[k + 1]]]) for k in range(buckets) if ends[k] < ends[k + 1]}


def _of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _repeats(x: np.ndarray, keys: list[str]) -> np.ndarray:
    """Which rows have an earlier row (by document, then place) with the same keys; ``x`` in any order."""
    order = np.lexsort((x["pos"], x["twin"], x["doc"], *(x[k] for k in keys[::-1])))
    y = x[order]
    new = np.ones(len(y), dtype=bool)
    new[1:] = np.any([y[k][1:] != y[k][:-1] for k in keys], axis=0)
    first = y[np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))]
    later = (y["doc"] != first["doc"]) | (y["twin"] != first["twin"]) | (y["pos"] != first["pos"])
    out = np.zeros(len(x), dtype=bool)
    out[order] = later
    return out


def _rows(doc: np.ndarray, twin: np.ndarray, lo: np.ndarray, hi: np.ndarray, ask: bool) -> pa.Table:
    return pa.table({"doc": pa.array(doc), "twin": pa.array(twin), "code": pa.array(lo.astype(np.int64) << 32 | hi.astype(np.int64)), "ask": pa.array(np.full(len(doc), ask))})


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` for every row: sizes in UTF-8 bytes, and the bytes that stay.

    * Null texts are empty.  Texts shorter than ``length`` keep everything.
    * Rows without an id keep everything and are nobody's earlier text.
    * Rows that share id and text are one document, each with its result; rows that share an id but not
      the text are documents of their own, in an order by hash of the text.
    * An empty table gives an empty table; extra columns are ignored.
    """
    if length < GRAM:
        raise ValueError(f"length has to be {GRAM} at least")
    side = length - GRAM
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = materialise(rows.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("shared")), "shared-ids")
    if shared.isEmpty():
        rows = rows.withColumn("twin", F.lit(0))
    else:
        rows = rows.join(shared, "doc", "left").select("doc", "text", F.when(F.col("shared"), F.hash("text")).otherwise(0).alias("twin"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(FEWEST, total // BUCKET_BYTES)
    common = common_grams(rows, length)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list]]:
        for doc, text, twin, *more in zip(*batch.columns, strict=True):
            b = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
            if doc.is_valid and len(b) >= length:
                yield doc.as_py(), twin.as_py(), b, more

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def sent() -> pa.RecordBatch:
            x = np.concatenate(waiting)
            again = _repeats(x, ["h", "s"])
            known = x[again]
            place = np.empty(len(known), dtype=_PLACE)
            place["doc"], place["twin"], place["from"], place["to"] = known["doc"], known["twin"], known["pos"] - side, known["pos"] + length
            first = x[~again]
            to = _of(np.where(_among(first["h"], common), _mixed(first["h"] ^ first["s"]), first["h"]), buckets)
            a, b = _dealt(to, first, buckets), _dealt(_of(place["doc"].astype(np.uint64), buckets), place, buckets)
            keys = sorted({*a, *b})
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([a.get(k, b"") for k in keys]), pa.array([b.get(k, b"") for k in keys])], names=["bucket", "anchors", "places"])

        for batch in batches:
            for doc, twin, b, _ in read(batch):
                h = gram_hashes(b)
                at = anchors(h, length, common)
                x = np.empty(len(at), dtype=_ANCHOR)
                x["h"], x["s"], x["doc"], x["twin"], x["pos"] = h[at], surroundings(h, at, len(b), side), doc, twin, at
                waiting.append(x)
                n += len(x)
                if n >= SEND:
                    yield sent()
                    waiting, n = [], 0
        if waiting:
            yield sent()

    def meet(group: pa.Table) -> pa.Table:
        x = _unpacked([b.as_buffer() for b in group.column("anchors")], _ANCHOR)
        place = _unpacked([b.as_buffer() for b in group.column("places")], _PLACE)
        _, which, times = np.unique(x["h"], return_inverse=True, return_counts=True)
        hot = _among(x["h"], common)
        x = x[(times[which] > 1) | hot]
        again = _repeats(x, ["h", "s"])
        known, first = x[again], x[~again]
        _, which, times = np.unique(first["h"], return_inverse=True, return_counts=True)
        hot, times = _among(first["h"], common), times[which]
        asks = (times > 1) | hot
        ask, whole = first[asks], ((times > crowd) | hot)[asks]
        return pa.concat_tables([
            _rows(place["doc"], place["twin"], np.maximum(place["from"], 0), place["to"], False),
            _rows(known["doc"], known["twin"], np.maximum(known["pos"] - side, 0), known["pos"] + length, False),
            _rows(ask["doc"], ask["twin"], whole, ask["pos"], True),
        ])

    found = materialise(rows.select("doc", "text", "twin").mapInArrow(deal, "bucket int, anchors binary, places binary").groupBy("bucket").applyInArrow(meet, _FOUND), "anchors")
    segment = np.dtype([("h", "<u8"), ("doc", "<i8"), ("twin", "<i4"), ("pos", "<i4"), ("nl", "u1"), ("nr", "u1"), ("left", "u1", (side,)), ("right", "u1", (side,))]) if 0 < side < 256 else np.dtype([("h", "<u8"), ("doc", "<i8"), ("twin", "<i4"), ("pos", "<i4"), ("nl", "<i4"), ("nr", "<i4"), ("left", "u1", (side,)), ("right", "u1", (side,))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, whole, n = [], [], 0

        def sent() -> pa.RecordBatch:
            x, w = np.concatenate([np.empty(0, segment), *plain]), np.concatenate([np.empty(0, _WINDOW), *whole])
            later = _repeats(w, ["w"])
            known = w[later]
            place = np.empty(len(known), dtype=_PLACE)
            place["doc"], place["twin"], place["from"], place["to"] = known["doc"], known["twin"], known["pos"], known["pos"] + length
            w, place = w[~later], _joined(place)
            parts = _dealt(_of(x["h"], buckets), x, buckets), _dealt(_of(w["w"], buckets), w, buckets), _dealt(_of(place["doc"].astype(np.uint64), buckets), place, buckets)
            keys = sorted({k for p in parts for k in p})
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([p.get(k, b"") for k in keys], pa.binary()) for p in parts)], names=["bucket", "segments", "windows", "places"])

        for batch in batches:
            for doc, twin, b, (codes,) in read(batch):
                code = np.unique(codes.values.to_numpy())
                code = code[(code & 0x7FFFFFFF) <= len(b) - GRAM]
                at, hot = code & 0x7FFFFFFF, code >> 32 > 0
                h = gram_hashes(b)
                own = at[~hot]
                x = np.empty(len(own), dtype=segment)
                wide = np.concatenate([np.zeros(side, np.uint8), b, np.zeros(side, np.uint8)])
                views = np.lib.stride_tricks.sliding_window_view(wide, side)
                x["h"], x["doc"], x["twin"], x["pos"] = h[own], doc, twin, own
                x["nl"], x["nr"] = np.minimum(own, side), np.minimum(len(b) - GRAM - own, side)
                x["left"], x["right"] = views[own][:, ::-1], views[own + side + GRAM]
                plain.append(x)
                if hot.any():
                    starts = np.unique((at[hot][:, None] - np.arange(side + 1)).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(b) - length)]
                    w = np.empty(len(starts), dtype=_WINDOW)
                    w["w"], w["doc"], w["twin"], w["pos"] = h[starts], doc, twin, starts
                    for step in [*range(GRAM, side, GRAM), side]:
                        w["w"] = _mixed(w["w"] * np.uint64(0x9E3779B97F4A7C15) + h[starts + step])
                    whole.append(w)
                    n += len(w)
                n += len(x)
                if n >= SEND:
                    yield sent()
                    plain, whole, n = [], [], 0
        if n:
            yield sent()

    def match(group: pa.Table) -> pa.Table:
        x = _unpacked([b.as_buffer() for b in group.column("segments")], segment)
        w = _unpacked([b.as_buffer() for b in group.column("windows")], _WINDOW)
        place = _unpacked([b.as_buffer() for b in group.column("places")], _PLACE)
        order = np.lexsort((x["pos"], x["twin"], x["doc"]))
        x = x[order]
        new = np.ones(len(x), dtype=np.int64)
        new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["twin"][1:] != x["twin"][:-1]) | (x["pos"][1:] != x["pos"][:-1])
        lo, hi = earlier_matches(x["h"], x["left"], x["right"], x["nl"].astype(np.int64), x["nr"].astype(np.int64), np.cumsum(new))
        hit = hi >= lo
        known = w[_repeats(w, ["w"])]
        return pa.concat_tables([
            _rows(place["doc"], place["twin"], place["from"], place["to"], False),
            _rows(x["doc"][hit], x["twin"][hit], (x["pos"] - hi)[hit], (x["pos"] - lo + length)[hit], False),
            _rows(known["doc"], known["twin"], known["pos"], known["pos"] + length, False),
        ])

    asked = found.where("ask").groupBy("doc", "twin").agg(F.collect_list("code").alias("codes"))
    more = rows.join(asked, ["doc", "twin"]).select("doc", "text", "twin", "codes").mapInArrow(fetch, "bucket int, segments binary, windows binary, places binary").groupBy("bucket").applyInArrow(match, _FOUND)
    covered = found.where("not ask").select("doc", "twin", "code").union(more.select("doc", "twin", "code")).groupBy("doc", "twin").agg(F.collect_list("code").alias("codes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out = []
            for at in range(batch.num_rows):
                b = np.frombuffer(batch.column("text")[at].as_buffer() or b"", dtype=np.uint8)
                codes = batch.column("codes")[at]
                if not codes.is_valid:
                    out.append((len(b), 0, 0, b.tobytes()))
                    continue
                c = codes.values.to_numpy()
                edge = np.bincount(np.minimum(c >> 32, len(b)), minlength=len(b) + 1) - np.bincount(np.minimum(c & 0x7FFFFFFF, len(b)), minlength=len(b) + 1)
                gone = np.cumsum(edge)[:-1] > 0
                out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), b[~gone].tobytes()))
            sizes = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(s, pa.int64()) for s in sizes[:3]), pa.array(sizes[3], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(covered, ["doc", "twin"], "left").select("doc", "text", "codes").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _joined(place: np.ndarray) -> np.ndarray:
    """Places with those that overlap or touch in a document made one."""
    x = place[np.lexsort((place["from"], place["twin"], place["doc"]))]
    if not len(x):
        return x
    start = np.ones(len(x), dtype=bool)
    start[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["twin"][1:] != x["twin"][:-1]) | (x["from"][1:] > x["to"][:-1])  # all are equally long, so the last end is the largest
    at = np.flatnonzero(start)
    out = x[at]
    out["to"] = x["to"][np.append(at[1:], len(x)) - 1]
    return out


def common_grams(rows: DataFrame, length: int, sample_docs: int = SAMPLE_DOCS, share: float = COMMON_SHARE, most: int = MOST_COMMON) -> np.ndarray:
    """Sorted hashes of the grams that anchor at least ``share`` of a sample of ``sample_docs`` documents, drawn by hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                b = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                if len(b) >= length:
                    h = gram_hashes(b)
                    found = np.unique(h[anchors(h, length, np.zeros(0, np.uint64))])
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    drawn = rows.select("doc").where("doc is not null").distinct().orderBy(F.xxhash64("doc"), "doc").limit(sample_docs)
    n = drawn.count()
    grams = rows.join(F.broadcast(drawn), "doc", "left_semi").select("text").mapInArrow(run, "h long").groupBy("h").count()
    top = grams.where(F.col("count") >= max(4, share * n)).orderBy(F.desc("count"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64))
